"""XES documents as event tables and back, and CSV.

Spark's XML source splits a document at its traces; there is no pushdown, so convert a log to Parquet once if it is read often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("string", "date", "int", "float", "boolean", "id")
_ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_EVENT = T.StructType([T.StructField(k, _ATTRIBUTES) for k in KINDS])
TRACE = T.StructType([T.StructField("string", _ATTRIBUTES), T.StructField("event", T.ArrayType(_EVENT))])


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """case_id, pos, activity, ts, attrs (all attributes as text): a row for each event, with or without a namespace.

    The case id is the trace's first string attribute ``concept:name``, null if there is none; an event attribute ``case_id`` takes its place.
    Of repeated keys in an event the last counts, within one kind of element. Nested attributes are ignored; traces without events have no rows.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").option("ignoreNamespace", "true").schema(TRACE).load(path)
    case = F.try_element_at(F.filter(F.coalesce("string", F.array().cast(_ATTRIBUTES)), lambda a: a["_key"] == "concept:name"), F.lit(1))["_value"]
    e = traces.select(case.alias("trace_id"), F.posexplode("event").alias("pos", "event"))
    entries = F.concat(*[F.coalesce(F.col(f"event.{k}"), F.array().cast(_ATTRIBUTES)) for k in KINDS])
    e = e.withColumn("entries", F.filter(entries, lambda a: a["_key"].isNotNull()))
    last = F.expr("filter(entries, (x, i) -> not exists(slice(entries, i + 2, size(entries)), y -> y._key = x._key))")
    e = e.withColumn("attrs", F.map_from_entries(F.transform(last, lambda a: F.struct(a["_key"], a["_value"]))))
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    return e.select(F.coalesce(get("case_id"), "trace_id").alias("case_id"), "pos", get("concept:name").alias("activity"), F.try_to_timestamp(get("time:timestamp")).alias("ts"), "attrs")


def write_xes(events: DataFrame, path: str) -> None:
    """events (case_id, activity, ts, and optionally attrs) as traces in order of ts; one file a partition."""
    one = lambda k, v: F.struct(F.lit(k).alias("_key"), v.cast("string").alias("_value"))
    more = F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: ~k.isin("concept:name", "time:timestamp"))), lambda x: F.struct(x["key"].alias("_key"), x["value"].alias("_value"))) if "attrs" in events.columns else F.array().cast(_ATTRIBUTES)
    event = F.struct(F.concat(F.array(one("concept:name", F.col("activity"))), more).alias("string"), F.array(one("time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))).alias("date"))
    order = [c for c in ("ts", "event_id", "pos", "activity") if c in events.columns]
    steps = F.array_sort(F.collect_list(F.struct(*order, event.alias("event"))))
    traces = events.groupBy("case_id").agg(steps.alias("steps"))
    traces = traces.select(F.array(one("concept:name", F.col("case_id"))).alias("string"), F.transform("steps", lambda s: s["event"]).alias("event"))
    traces.write.format("xml").option("rowTag", "trace").option("rootTag", 'log xes.version="1.0"').mode("overwrite").save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and no index; a folder of files."""
    df.write.option("header", True).mode("overwrite").csv(path)
