"""Object-centric logs: tables as Parquet, and the JSON form of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.stage import small, staged

SECTIONS = ("ocel:events", "ocel:objects")
JSON = "`ocel:events` map<string, struct<`ocel:activity`: string, `ocel:timestamp`: string, `ocel:omap`: array<string>, `ocel:vmap`: map<string, string>>>, `ocel:objects` map<string, struct<`ocel:type`: string, `ocel:ovmap`: map<string, string>>>"


def write_ocel(events: DataFrame, objects: DataFrame, relations: DataFrame, path: str) -> None:
    """Three tables; objects and relations in a folder for each type."""
    events.write.mode("overwrite").parquet(f"{path}/events")
    objects.write.partitionBy("type").mode("overwrite").parquet(f"{path}/objects")
    relations.write.partitionBy("type").mode("overwrite").parquet(f"{path}/relations")


def read_ocel_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("events", "objects", "relations"))


def save_ocel(events: DataFrame, objects: DataFrame, relations: DataFrame, name: str, buckets: int = 64) -> None:
    """Four tables of the catalogue, bucketed and sorted: events and relations by eid, objects and relations once more by oid.

    Joins and lists on those ids then read buckets side by side and move no rows. Use about one bucket for each 128 MB of relations. If one id has a large part of all relations, read with
    ``spark.sql.sources.bucketing.enabled`` false: then its bucket is divided like any other file.
    """
    for df, table, key in ((events, "events", "eid"), (relations, "relations", "eid"), (objects, "objects", "oid"), (relations, "object_relations", "oid")):
        df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(f"{name}_{table}")


def load_ocel(spark: SparkSession, name: str, by: str = "eid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, objects, relations as save_ocel wrote them; relations by eid or by oid."""
    return spark.table(f"{name}_events"), spark.table(f"{name}_objects"), spark.table(f"{name}_{'relations' if by == 'eid' else 'object_relations'}")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, value: documents cut after each closing brace, by splits of their bytes; with the number of quotes, and of braces opened if the piece begins outside (or inside) a string."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # no quote in it ends a string
    opened = lambda text: count(F.regexp_replace(text, r'"[^"]*("|\z)', ""), "{")
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    return staged(text.select("*", count(plain, '"').alias("quotes"), opened(plain).alias("open_outside"), opened(F.concat(F.lit('"'), plain)).alias("open_inside")), "ocel-pieces")


def _carried(totals: DataFrame, columns: dict[str, F.Column]) -> DataFrame:
    """For each split, what the splits of its file before it add up to, column after column: a row for each split."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    for name, value in columns.items():
        totals = totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    return small(staged(totals.select("file", "block", *columns), "ocel-splits"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Each record of the documents, as a document with this record only.

    Whether a split begins inside a string, and how deep, follows from what all splits before it add up to, under either assumption; no split waits for another. Pieces up to the end of a record then have
    its number, and are put together; what precedes a record (the end of a section, the start of the next) stays with it.
    """
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    opened = lambda inside: F.when(inside == 0, F.col("open_outside")).otherwise(F.col("open_inside"))
    change = lambda inside: opened(inside) - ((inside + F.col("quotes")) % 2 == 0).cast("int")
    at = sofar("quotes").alias("at")
    pieces = _pieces(spark, path)
    numbers = pieces.select("file", "block", "seq", "quotes", "open_outside", "open_inside", at)
    totals = numbers.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum(change(F.col("at") % 2)).alias("even"), F.sum(change((F.col("at") + 1) % 2)).alias("odd"))
    carry = _carried(totals, {"quotes_before": F.col("quotes"), "depth_before": F.when(F.col("quotes_before") % 2 == 0, F.col("even")).otherwise(F.col("odd"))})
    inside = (F.col("at") + F.col("quotes_before")) % 2
    deep = pieces.withColumn("at", at).join(carry, ["file", "block"]).select("file", "block", "seq", "value", opened(inside).alias("opened"), change(inside).alias("change"), "depth_before")
    deep = deep.withColumn("depth", F.col("depth_before") + sofar("change"))
    high = F.col("depth") + F.col("opened")
    flags = deep.withColumns({"ends": ((high == 3) & (F.col("change") < F.col("opened"))).cast("int"), "begins": ((F.col("depth") <= 1) & (high >= 2)).cast("int")})
    flags = flags.withColumns({"record": sofar("ends"), "section": sofar("begins")}).where("depth > 0 OR opened > 0")
    flags = staged(flags.drop("opened", "depth_before"), "ocel-deep")
    totals = flags.groupBy("file", "block").agg(F.sum("ends").alias("ends"), F.sum("begins").alias("begins"))
    carry = _carried(totals, {"records_before": F.col("ends"), "sections_before": F.col("begins")})
    flags = flags.join(carry, ["file", "block"]).withColumns({"record": F.col("record") + F.col("records_before"), "section": F.col("section") + F.col("sections_before")})
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "value", "depth", "change", "section", "begins")))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    found = flags.groupBy("file", "record").agg(parts.alias("parts")).select(
        "file", first["depth"].alias("depth"), first["section"].alias("section"), (last["section"] + last["begins"]).alias("then"), (last["depth"] + last["change"]).alias("after"), F.array_join(F.transform("parts", lambda x: F.concat(x["value"], F.lit("}"))), "").alias("text")
    )
    found = staged(found, "ocel-records")
    whole = lambda name: F.concat(F.when(F.col("depth") > 0, F.concat(F.lit('{"'), name, F.lit('": {'))).otherwise(""), F.regexp_replace("text", r"^\s*,", ""), F.repeat(F.lit("}"), F.col("after").cast("int")))
    keys = F.map_keys(F.map_filter(F.from_json(whole(F.lit("other")), "map<string,string>"), lambda k, v: v.startswith("{")))
    opening = found.where("then > section").select("file", F.col("then").alias("section"), F.try_element_at(keys, F.lit(-1)).alias("name"))
    opening = small(staged(opening.where(F.col("name").isin(*SECTIONS)), "ocel-sections"))
    return found.join(opening, ["file", "section"], "left").select(F.from_json(whole(F.coalesce("name", F.lit("other"))), JSON).alias("doc")).select("doc.*")


def read_ocel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, objects, relations of JSON documents, one a file. A large document is read by many tasks, by splits of its bytes; only a record is ever held whole.

    Records without content, or null, are rows with nulls; a repeated id is repeated; empty documents have no rows. Lists of objects beside the sections must not hold further objects, as this format has none.
    """
    doc = _records(spark, path)
    e = doc.select(F.explode("ocel:events").alias("eid", "e")).select("eid", F.col("e.`ocel:activity`").alias("activity"), F.to_timestamp("e.`ocel:timestamp`").alias("ts"), F.col("e.`ocel:omap`").alias("omap"), F.col("e.`ocel:vmap`").alias("vmap"))
    objects = doc.select(F.explode("ocel:objects").alias("oid", "o")).select("oid", F.col("o.`ocel:type`").alias("type"), F.col("o.`ocel:ovmap`").alias("ovmap"))
    relations = e.select("eid", F.explode("omap").alias("oid")).join(objects.select("oid", "type"), "oid", "left").select("eid", "oid", "type")
    return e.drop("omap"), objects, relations
