"""Resources: what they do, how busy they are, and how cases meet on them. Events without resource are those of the resource null, in all of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.log import DAY, same_key_join
from caseloom.operators.windows import in_case, previous, running_sum


def resource_activity_mix(log: DataFrame, by: str = "resource") -> DataFrame:
    """Share of each activity in what a resource (or pool) does."""
    n = log.groupBy(by, "activity").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def resource_workload(log: DataFrame, width: int = DAY) -> DataFrame:
    """resource, bucket, events, cases, busy_us; busy time is divided over the buckets it covers, events count in the last of them.

    A bucket's end belongs to it for what began before; an event without duration counts in the bucket that begins then. Events that end before they start count where they start.
    """
    first, last = F.floor(F.col("start_us") / width), F.floor((F.col("ts_us") - 1) / width)
    parts = log.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    busy = F.least("ts_us", (F.col("bucket") + 1) * width) - F.greatest("start_us", F.col("bucket") * width)
    own = F.col("bucket") == F.greatest(first, last)
    return parts.groupBy("resource", "bucket").agg(F.sum(own.cast("bigint")).alias("events"), F.countDistinct(F.when(own, F.col("case_id"))).alias("cases"), F.sum(busy).cast("bigint").alias("busy_us"))


def pool_utilisation(log: DataFrame) -> DataFrame:
    """pool, members, busy_s, utilisation of all members' time, and the largest and smallest member's busy time."""
    member = log.groupBy("pool", "resource").agg(F.sum(F.col("ts_us") - F.col("start_us")).alias("busy"), F.min("start_us").alias("a"), F.max("ts_us").alias("b"))
    span = (F.max("b") - F.min("a")) * F.count(F.lit(1))
    return member.groupBy("pool").agg(
        F.count(F.lit(1)).alias("members"), F.round(F.sum("busy") / 1e6, 6).alias("busy_s"), F.round(F.sum("busy") / F.nullif(span, F.lit(0)), 6).alias("utilisation"), F.round(F.max("busy") / 1e6, 6).alias("most_s"), F.round(F.min("busy") / 1e6, 6).alias("least_s")
    )


def touched_buckets(spans: DataFrame, level: str) -> DataFrame:
    """A row for each bucket that start_us to ts_us touches, where buckets of a level are 4 to the power of it microseconds wide."""
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(level) * 2)
    return spans.withColumn("width", width).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_us") / F.col("width")), F.floor(F.greatest(F.col("ts_us") - 1, "start_us") / F.col("width")))))


def overlapping_cases(log: DataFrame, on: str = "resource") -> DataFrame:
    """Pairs of events of different cases that hold the same resource at once; intervals are half-open. An event without duration overlaps those that began before and end after it, by 0; events
    without case, or that end before they start, overlap nothing. The resource null is one resource.

    An interval's level is the first power of four microseconds that holds it, so it touches two buckets of that width at most: there it is held, a month like a minute. It looks for others in the
    buckets of its own and each longer level that occurs in the log, so the join is on equal keys, and a pair is kept in the bucket of its later start only. What a bucket compares is in proportion to
    what it returns, as a held interval covers more than an eighth of its one or two buckets.
    """
    e = log.select(F.col(on).alias("on"), "case_id", "event_id", "start_us", "ts_us").where("start_us <= ts_us").withColumn("level", F.ceil(F.log(4.0, F.greatest(F.col("ts_us") - F.col("start_us"), F.lit(1)))).cast("int"))
    levels = e.agg(F.collect_set("level")).scalar()  # 32 numbers at most
    held = touched_buckets(e, "level")
    seek = touched_buckets(e.withColumn("at", F.explode(levels)).where("at >= level"), "at")
    own = ("case_id", "event_id", "start_us", "ts_us")
    a = seek.select("on", F.col("at").alias("level"), "bucket", "width", F.col("level").alias("level_a"), *[F.col(c).alias(f"{c}_a") for c in own])
    b = held.select("on", "level", "bucket", *[F.col(c).alias(f"{c}_b") for c in own])
    late = F.greatest("start_us_a", "start_us_b")
    once = (F.col("event_id_a") < F.col("event_id_b")) | (F.col("level_a") < F.col("level")) & (F.col("event_id_a") != F.col("event_id_b"))
    p = same_key_join(a, b, ["on", "level", "bucket"]).where(once & (F.col("case_id_a") != F.col("case_id_b")) & (F.col("start_us_a") < F.col("ts_us_b")) & (F.col("start_us_b") < F.col("ts_us_a")) & (F.col("bucket") == F.floor(late / F.col("width"))))
    return p.select(F.col("on").alias(on), F.least("event_id_a", "event_id_b").alias("event_a"), F.greatest("event_id_a", "event_id_b").alias("event_b"), late.alias("from_us"), (F.least("ts_us_a", "ts_us_b") - late).alias("overlap_us"))


def resource_contention(log: DataFrame, width: int = DAY) -> DataFrame:
    """resource, bucket, pairs that overlap, waiting time before events."""
    pairs = overlapping_cases(log).groupBy("resource", F.floor(F.col("from_us") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))
    wait = F.greatest(F.col("start_us") - F.lag("ts_us").over(in_case()), F.lit(0))
    waits = log.withColumn("wait", wait).groupBy("resource", F.floor(F.col("ts_us") / width).alias("bucket")).agg(F.coalesce(F.sum("wait"), F.lit(0)).alias("wait_us"))
    return same_key_join(waits, pairs, ["resource", "bucket"], "full").na.fill(0, ["pairs", "wait_us"])


def batching(log: DataFrame, least: int = 2, within: int = 7_200_000_000) -> DataFrame:
    """Batches: events of at least so many cases on one resource with one activity, each start within so long of the one before.

    Starts are compared, and batches numbered, within days and with what the days before carry over, so a busy resource is not ordered by one task.
    """
    key, order = ["resource", "activity"], ("start_us", "event_id")
    e = previous(log.select(*key, *order, "case_id"), key, ["start_us"], order)
    e = e.withColumn("new", F.coalesce((F.col("start_us") - F.col("prev_start_us") > within).cast("int"), F.lit(1)))
    e = running_sum(e, key, "new", "batch", order)
    b = e.groupBy(*key, "batch").agg(F.min("start_us").alias("from_us"), F.max("start_us").alias("to_us"), F.count(F.lit(1)).alias("events"), F.countDistinct("case_id").alias("cases"))
    return b.where(F.col("cases") >= least).drop("batch")


def shift_context(state_runs: DataFrame, contention: DataFrame, active: DataFrame, residual: DataFrame) -> DataFrame:
    """Each change of state (not the first run) with contention and waiting on the resource, active cases and the arrivals beyond what was expected in that bucket, and the first three over their means."""
    change = state_runs.where("run > 1").select("resource", F.col("enter").alias("bucket"), "state")
    base = contention.agg(F.avg("pairs").alias("base_pairs"), F.avg("wait_us").alias("base_wait")).crossJoin(active.agg(F.avg("active").alias("base_active")))
    out = change.join(contention, ["resource", "bucket"], "left").join(active.select("bucket", "active"), "bucket", "left").join(residual.select("bucket", "residual"), "bucket", "left")
    out = out.na.fill(0, ["pairs", "wait_us", "active"]).na.fill(0.0, ["residual"]).crossJoin(F.broadcast(base))  # one row
    over = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    return out.select("resource", "bucket", "state", "pairs", "wait_us", "active", F.round("residual", 4).alias("residual"), over("pairs", "base_pairs").alias("pairs_lift"), over("wait_us", "base_wait").alias("wait_lift"), over("active", "base_active").alias("active_lift"))
