"""Event logs over the given tables, as DataFrames and as the same common table expressions in SQL.

The columns that operators expect: case_id, activity, ts_us (completion, microseconds), start_us, resource, pool,
event_id (with ts_us the order of events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.stage import parts

DAY = 86_400_000_000
HOUR = 3_600_000_000
SPLIT = "1998-06-01"


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is what one user does in a day; value is the duration in seconds; k names the resource."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.unix_micros(ts).alias("ts_us"),
        (F.unix_micros(ts) - F.round(F.col("value") * 1e6).cast("bigint")).alias("start_us"),
        k.alias("resource"),
        (k.cast("bigint") % 3).alias("pool"),
        "value",
        "event_id",
        ts.alias("ts"),
    )


E_SQL = """E AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS activity, epoch_us(ts) AS ts_us,
  epoch_us(ts) - CAST(round(value * 1e6) AS BIGINT) AS start_us, json_extract_string(props, '$.k') AS resource,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS pool, value, event_id FROM events)"""


def partial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with gaps: a fifth of the resources is missing, and each seventh event has a day for its time and no duration."""
    k, day = F.col("resource").cast("bigint"), F.col("event_id") % 7 == 0
    at = F.when(day, F.floor(F.col("ts_us") / DAY) * DAY).otherwise(F.col("ts_us"))
    return event_log(spark, sf_dir).withColumns({"resource": F.when(k % 5 != 0, F.col("resource")), "start_us": F.when(day, at).otherwise(F.col("start_us")), "ts_us": at})


PARTIAL_SQL = E_SQL.replace("E AS (", "E0 AS (", 1) + f""", E AS (SELECT case_id, activity, CASE WHEN event_id % 7 = 0 THEN ts_us // {DAY} * {DAY} ELSE ts_us END AS ts_us,
  CASE WHEN event_id % 7 = 0 THEN ts_us // {DAY} * {DAY} ELSE start_us END AS start_us, CASE WHEN CAST(resource AS BIGINT) % 5 != 0 THEN resource END AS resource, pool, value, event_id FROM E0)"""


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is an order, an event one of its line items; the log before 1998-06-01 is log0, from then on log1."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        micros(F.col("l_shipdate")).alias("ts_us"),
        F.col("l_suppkey").alias("resource"),
        (F.col("l_linenumber") * F.lit(10**14) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).cast("bigint").alias("event_id"),
        F.when(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz"), "log0").otherwise("log1").alias("log"),
    )


L_SQL = f"""L AS (SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS activity, epoch_us(l_shipdate) AS ts_us, l_suppkey AS resource,
  CAST(l_linenumber AS BIGINT) * 100000000000000 + l_partkey * 1000000 + l_suppkey AS event_id,
  CASE WHEN l_shipdate < TIMESTAMP '{SPLIT}' THEN 'log0' ELSE 'log1' END AS log FROM lineitem)"""


def relation_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts to group an object log's relations in, by rows (Parquet's footers tell them)."""
    return parts(spark, 2 * table(spark, sf_dir, "orders").count() + table(spark, sf_dir, "lineitem").count())


def object_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, objects and relations: orders with their customers and parts."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    eid = F.concat(F.lit("e_"), F.col("o_orderkey").cast("string"))
    events = orders.select(eid.alias("eid"), F.col("o_orderpriority").alias("activity"), micros(F.col("o_orderdate")).alias("ts_us"))
    oid = lambda kind, c: F.concat(F.lit(f"{kind[0]}_"), F.col(c).cast("string")).alias("oid")
    none = lambda name: F.lit(None).cast("string").alias(name)
    objects = (
        orders.select(oid("order", "o_orderkey"), F.lit("order").alias("type"), F.col("o_totalprice").alias("price"), none("segment"), none("brand"))
        .unionAll(table(spark, sf_dir, "customer").select(oid("customer", "c_custkey"), F.lit("customer"), F.lit(None).cast("double"), F.col("c_mktsegment"), none("brand")))
        .unionAll(table(spark, sf_dir, "part").select(oid("part", "p_partkey"), F.lit("part"), F.col("p_retailprice"), none("segment"), F.col("p_brand")))
    )
    keys = ("l_orderkey", "l_partkey")
    different = items.select(*keys).repartition(parts(spark, items.count()), *keys).distinct()
    relations = (
        orders.select(eid.alias("eid"), oid("order", "o_orderkey"), F.lit("order").alias("type"))
        .unionAll(orders.select(eid, oid("customer", "o_custkey"), F.lit("customer")))
        .unionAll(different.select(F.concat(F.lit("e_"), F.col("l_orderkey").cast("string")), oid("part", "l_partkey"), F.lit("part")))
    )
    return events, objects, relations


O_SQL = """OE AS (SELECT 'e_' || o_orderkey AS eid, o_orderpriority AS activity, epoch_us(o_orderdate) AS ts_us FROM orders),
OO AS (SELECT 'o_' || o_orderkey AS oid, 'order' AS type, o_totalprice AS price, NULL::VARCHAR AS segment, NULL::VARCHAR AS brand FROM orders
  UNION ALL SELECT 'c_' || c_custkey, 'customer', NULL, c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'p_' || p_partkey, 'part', p_retailprice, NULL, p_brand FROM part),
R AS (SELECT 'e_' || o_orderkey AS eid, 'o_' || o_orderkey AS oid, 'order' AS type FROM orders
  UNION ALL SELECT 'e_' || o_orderkey, 'c_' || o_custkey, 'customer' FROM orders
  UNION ALL SELECT DISTINCT 'e_' || l_orderkey, 'p_' || l_partkey, 'part' FROM lineitem)"""
