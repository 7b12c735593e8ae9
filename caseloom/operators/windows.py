"""Steps within cases, resources and the whole log, without a window over all events in one task.

Events without case id belong to no case: they stay, with nulls for what only a case has. Events without resource are those of the resource null. Columns named __bucket, __prev, __carry and the like are these functions' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.log import DAY, ORDER, STRETCH, apart, cases, same_key_join
from caseloom.operators.stage import staged


def in_case() -> Window:
    return Window.partitionBy("case_id", apart()).orderBy(*ORDER)


def of_case(x: Column) -> Column:
    return F.when(F.col("case_id").isNotNull(), x)


def previous(df: DataFrame, key: list[str], values: list[str], order: tuple[str, ...] = ORDER, width: int = DAY, prefix: str = "prev_") -> DataFrame:
    """Each row's values in the row before it, of the same key; null for the first.

    Rows are ordered within time buckets; the first of a bucket gets the last of the bucket before it that has rows, from a table with
    one row for each key and bucket. So neither the whole log nor a busy resource is ordered by one task.
    """
    df = df.withColumn("__bucket", F.floor(F.col(order[0]) / width))
    pair = F.struct(*values)
    ends = df.groupBy(*key, "__bucket").agg(F.max_by(pair, F.struct(*order)).alias("__last"))
    ends = ends.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*key).orderBy("__bucket"))).drop("__last")
    inside = F.lag(pair).over(Window.partitionBy(*key, "__bucket").orderBy(*order))
    out = df.withColumn("__prev", inside).transform(same_key_join, ends, [*key, "__bucket"], "left")
    got = F.coalesce("__prev", "__carry")
    return out.withColumns({f"{prefix}{v}": got[v] for v in values}).drop("__bucket", "__prev", "__carry")


def running_sum(df: DataFrame, key: list[str], value: str, into: str, order: tuple[str, ...] = ORDER, width: int = DAY) -> DataFrame:
    """The sum of value over a key's rows up to each row: within time buckets, plus what earlier buckets hold."""
    df = df.withColumn("__bucket", F.floor(F.col(order[0]) / width))
    held = df.groupBy(*key, "__bucket").agg(F.sum(value).alias("__carry"))
    held = held.withColumn("__carry", F.sum("__carry").over(Window.partitionBy(*key).orderBy("__bucket")) - F.col("__carry"))
    inside = F.sum(value).over(Window.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__own", inside).transform(same_key_join, held, [*key, "__bucket"]).withColumn(into, F.col("__own") + F.col("__carry")).drop("__bucket", "__own", "__carry")


def time_since_previous(log: DataFrame) -> DataFrame:
    """gap_us: time since the event before in the case; null for the first and for events without case."""
    return log.withColumn("gap_us", F.col("ts_us") - F.lag("ts_us").over(in_case()))


def elapsed_in_case(log: DataFrame) -> DataFrame:
    return log.withColumn("elapsed_us", of_case(F.col("ts_us") - F.min("ts_us").over(Window.partitionBy("case_id", apart()))))


def prefix(log: DataFrame, k: int = 10) -> DataFrame:
    """The event's place in its case, and the last k activities up to it."""
    return log.withColumns({"idx": of_case(F.row_number().over(in_case())), "prefix": of_case(F.array_join(F.collect_list("activity").over(in_case().rowsBetween(1 - k, 0)), ">"))})


def prefix_nodes(log: DataFrame) -> DataFrame:
    """The events of cases, with idx, node and parent: node names the sequence of the case's activities up to the event, so that equal sequences have equal names.

    The names come by prefix doubling, not by strings that would take the square of a case's length: after k rounds an event knows the last 2^k activities up to itself (fewer at the
    case's start), and each round joins two such stretches end to end. So a case of n events takes log2(n) windows over the same order, and 32 digits an event. Names are
    128-bit hashes. parent is null for a case's first event; a null activity is one like any other.
    """
    w = in_case()
    out = cases(log).withColumns({"idx": F.row_number().over(w), "node": F.md5(F.coalesce(F.concat(F.lit("="), F.col("activity").cast("string")), F.lit("")))})
    longest = cases(log).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    reach = 1
    while reach < longest:
        before = F.lag("node", reach).over(w)
        out = out.withColumn("node", F.when(before.isNull(), F.col("node")).otherwise(F.md5(F.concat(F.lit(">"), before, F.col("node")))))
        reach *= 2
    return out.withColumn("parent", F.lag("node").over(w))


def prefix_tree(log: DataFrame) -> DataFrame:
    """The tree of all sequences so far: node, parent, activity, depth, cases that pass it, cases that end in it, first_event (the least event_id there) and parent's first_event.

    Each event is in one node, so the tree has no more rows than the log; the cases that end in a node are those of one variant.
    """
    e = prefix_nodes(log).withColumn("__end", F.lead("event_id").over(in_case()).isNull().cast("bigint"))
    tree = e.groupBy("node").agg(F.first("parent").alias("parent"), F.first("activity").alias("activity"), F.first("idx").alias("depth"), F.count(F.lit(1)).alias("cases"), F.sum("__end").alias("ends"), F.min("event_id").alias("first_event"))
    above = tree.select(F.col("node").alias("parent"), F.col("first_event").alias("parent_event"))
    return tree.join(above, "parent", "left")


def prefix_counts(log: DataFrame, activities: list[str]) -> DataFrame:
    """How often each activity has occurred in the case so far."""
    so_far = in_case().rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({f"n_{a}": of_case(F.sum((F.col("activity") == a).cast("bigint")).over(so_far)) for a in activities})


def global_gap(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Time since the event before, of any case."""
    return previous(log, [], ["ts_us"], width=stretch).withColumn("gap_us", F.col("ts_us") - F.col("prev_ts_us")).drop("prev_ts_us")


def trailing_rate(log: DataFrame, width: int, key: str = "resource") -> DataFrame:
    """Events of the key in the last width microseconds, this one included. Each bucket also sees the one before it."""
    own = F.floor(F.col("ts_us") / width)
    twice = log.withColumn("__bucket", F.explode(F.array(own, own + 1))).withColumn("__own", F.col("__bucket") == own)
    frame = Window.partitionBy(key, "__bucket").orderBy("ts_us").rangeBetween(-width, 0)
    return twice.withColumn("in_window", F.count(F.lit(1)).over(frame)).where("__own").drop("__bucket", "__own")


def trailing_rate_log(log: DataFrame, width: int, buckets: int) -> DataFrame:
    """bucket, events, in_window: events of the whole log in each bucket of width microseconds, and in the last so many buckets, this one included.

    Events are counted by bucket first; the frame goes over the table of buckets, which has one row for each from the first to the last.
    """
    n = log.groupBy(F.floor(F.col("ts_us") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    every = n.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bucket"))
    full = every.join(n, "bucket", "left").na.fill(0, ["events"])
    return full.withColumn("in_window", F.sum("events").over(Window.orderBy("bucket").rowsBetween(1 - buckets, 0)))


def active_cases(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """instant_us, active: cases that are open from that instant on. A case is open from its first start to its last completion."""
    case = cases(log).groupBy("case_id").agg(F.min("start_us").alias("a"), F.max("ts_us").alias("b"))
    steps = case.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(F.col("s.at").alias("instant_us")).agg(F.sum("s.d").alias("d")).withColumn("day", F.floor(F.col("instant_us") / stretch))
    days = steps.groupBy("day").agg(F.sum("d").alias("d"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("before"))
    so_far = F.sum("d").over(Window.partitionBy("day").orderBy("instant_us"))
    return steps.withColumn("inside", so_far).join(days, "day").select("instant_us", (F.col("before") + F.col("inside")).alias("active"))


def queue_wait(log: DataFrame) -> DataFrame:
    """wait_us: start less the completion before it in the case; null for the first and for events without case, negative where events overlap."""
    return log.withColumn("wait_us", F.col("start_us") - F.lag("ts_us").over(in_case()))


def gap_stats(log: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Idle time after an activity until the next start in the case. The median is exact, by selection in several passes; with accuracy, approximate in one."""
    from caseloom.operators.quantiles import exact_quantiles

    gap = (F.lead("start_us").over(in_case()) - F.col("ts_us")) / 1e6
    g = cases(log).select("activity", gap.alias("gap")).where("gap IS NOT NULL")
    basic = [F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 6).alias("mean_s")]
    if accuracy is not None:
        return g.groupBy("activity").agg(*basic, F.round(F.percentile_approx("gap", 0.5, accuracy), 6).alias("median_s"))
    g = staged(g, "gaps")
    known = same_key_join(g.groupBy("activity").agg(*basic), exact_quantiles(g, ["activity"], F.col("gap"), [0.5]), ["activity"], "left")
    return known.select("activity", "n", "mean_s", F.round("q0", 6).alias("median_s"))


def resource_idle(log: DataFrame) -> DataFrame:
    """Start less the completion before it on the resource; negative where they overlap."""
    return previous(log, ["resource"], ["ts_us"]).withColumn("idle_us", F.col("start_us") - F.col("prev_ts_us")).drop("prev_ts_us")


def cross_case_edges(log: DataFrame, within: int) -> DataFrame:
    """Consecutive events of different cases on one resource, at most within microseconds apart. Events without case are in no pair."""
    e = previous(log, ["resource"], ["ts_us", "case_id", "event_id"])
    e = e.where((F.col("prev_case_id") != F.col("case_id")) & (F.col("ts_us") - F.col("prev_ts_us") <= within))
    return e.select("resource", F.col("prev_event_id").alias("from_event"), F.col("event_id").alias("to_event"), (F.col("ts_us") - F.col("prev_ts_us")).alias("gap_us"))


def directly_follows(log: DataFrame) -> DataFrame:
    w = in_case()
    e = cases(log).select(F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), (F.lead("ts_us").over(w) - F.col("ts_us")).alias("gap")).where("b IS NOT NULL")
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("gap") / 1e6), 6).alias("mean_gap_s"))


def handover(log: DataFrame, other_only: bool = True) -> DataFrame:
    """r1, r2, n: how often work in a case goes from one resource to the next. Events without resource hand nothing over and get nothing."""
    e = cases(log).select(F.col("resource").alias("r1"), F.lead("resource").over(in_case()).alias("r2")).where("r2 IS NOT NULL")
    return (e.where("r1 != r2") if other_only else e).groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))


def termination_point(log: DataFrame, activity: str) -> DataFrame:
    """What directly precedes an activity that ends its case."""
    w = in_case()
    e = cases(log).select("activity", F.lag("activity").over(w).alias("before"), F.lead("activity").over(w).alias("after")).where((F.col("activity") == activity) & F.col("after").isNull())
    return e.groupBy(F.coalesce("before", F.lit("(start)")).alias("before")).agg(F.count(F.lit(1)).alias("n"))


def runs(states: DataFrame, key: list[str], at: str, state: str = "state") -> DataFrame:
    """Gaps and islands: key, run, state, enter, leave, length of each stretch of equal states."""
    w = Window.partitionBy(*key).orderBy(at)
    changed = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    s = states.withColumn("__changed", changed).withColumn("run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*key, "run", F.col(state).alias("state")).agg(F.min(at).alias("enter"), F.max(at).alias("leave"), F.count(F.lit(1)).alias("length"))


def first_seen(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")
