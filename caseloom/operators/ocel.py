"""Object-centric logs: events (eid), objects (oid, type) and the relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_objects(events: DataFrame, relations: DataFrame) -> DataFrame:
    """eid, n, objects: the objects of each event, as a sorted list."""
    found = events.select("eid").join(relations.select("eid", "oid"), "eid")
    lists = found.groupBy("eid").agg(F.array_sort(F.collect_set("oid")).alias("objects"))
    return lists.select("eid", F.size("objects").cast("bigint").alias("n"), "objects")


def object_events(lists: DataFrame) -> DataFrame:
    """The inverse of event_objects."""
    return lists.select("eid", F.explode("objects").alias("oid"))


def flatten_ocel(events: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """A log whose cases are the objects of one type; an event with several of them occurs in each case."""
    return relations.where(F.col("type") == kind).select("eid", F.col("oid").alias("case_id")).join(events, "eid")


def enrich(events: DataFrame, relations: DataFrame, objects: DataFrame, kind: str, attributes: list[str]) -> DataFrame:
    """Events with the attributes of their objects of one type; events without one stay."""
    named = relations.where(F.col("type") == kind).select("eid", "oid").join(objects.select("oid", *attributes), "oid", "left")
    return events.join(named, "eid", "left")


def orphan_objects(objects: DataFrame, relations: DataFrame) -> DataFrame:
    return objects.select("oid", "type").join(relations.select("oid"), "oid", "left_anti")


def objects_per_event(relations: DataFrame, parts: int | None = None) -> DataFrame:
    """type, objects, events: how many events have so many objects of the type. Relations, then different ones by event, are dealt into so many parts (None: as Spark divides them)."""
    dealt = lambda df, *by: df.repartition(parts, *by) if parts else df
    different = dealt(relations.select("eid", "type", "oid"), "eid", "type", "oid").distinct()
    n = dealt(different, "eid", "type").groupBy("eid", "type").agg(F.count("oid").alias("objects"))
    return n.groupBy("type", "objects").agg(F.count(F.lit(1)).alias("events"))


def log_summary(events: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: counts, sorted types and activities, first and last time."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    e = events.agg(F.count(F.lit(1)).alias("events"), listed("activity").alias("activities"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    o = objects.agg(F.count(F.lit(1)).alias("objects"), listed("type").alias("types"))
    return e.crossJoin(o).crossJoin(relations.agg(F.count(F.lit(1)).alias("relations")))  # one row each


def to_value_map(df: DataFrame, prefix: str = "ocel:", into: str = "vmap") -> DataFrame:
    """All columns whose names don't begin with the prefix, as a map of text without nulls."""
    own = [c for c in df.columns if c.startswith(prefix)]
    pairs = [x for c in df.columns if c not in own for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    packed = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*[F.col(f"`{c}`") for c in own], packed.alias(into))
