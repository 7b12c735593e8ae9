"""Event logs: shaping, cutting, variants, counts and comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("ts_us", "event_id")
DAY = 86_400_000_000
#: Rows of the whole log are ordered within stretches of this length.
STRETCH = 600_000_000
#: Where a closed split begins and ends, 1970-01-01 and 2099-12-30 23:59:59.
FIRST_US, LAST_US = 0, 4_102_358_399_000_000


def cases(log: DataFrame) -> DataFrame:
    """The events that belong to a case: those without case id are events, but no case."""
    return log.where(F.col("case_id").isNotNull())


def same_key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null is a value like any other: an event without resource is one of the resource null. The keys occur once."""
    named = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys], F.lit(True).alias("__there"))
    equal = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in keys])
    out = left.join(named, equal, how)
    if how in ("full", "right"):
        out = out.withColumns({k: F.when(F.col("__there"), F.col(f"`__r_{k}`")).otherwise(F.col(f"`{k}`")) for k in keys})
    return out.drop("__there", *[f"__r_{k}" for k in keys])


def stack_logs(logs: Mapping[str, DataFrame]) -> DataFrame:
    """All logs in one, labelled in column ``log``; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("log", F.lit(k)) for k, df in logs.items()])


def standardize(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename to Case_ID, Activity, Timestamp (or whatever names says); other columns stay."""
    return df.withColumnsRenamed(dict(names))


def parse_ts(df: DataFrame, col: str) -> DataFrame:
    """Text to timestamp, if the column is there; text that isn't a time becomes null."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col))) if col in df.columns else df


def filter_time_range(df: DataFrame, t0, t1, col: str = "ts", closed: bool = True) -> DataFrame:
    """Events from t0 to t1; with closed=False t1 itself is out. Reaches the scan as a pushed filter."""
    c = F.col(col)
    return df.where((c >= t0) & ((c <= t1) if closed else (c < t1)))


def assign_case_ids(log: DataFrame, start: int = 1, min_width: int = 4, stretch: int = STRETCH) -> DataFrame:
    """case_id, number, padded: consecutive numbers of cases in order of their first event.

    Cases are numbered within the stretch of time of their first event, after all cases of earlier ones; only the table of stretches has one window.
    """
    each = cases(log).groupBy("case_id").agg(F.min("ts_us").alias("first_us")).withColumn("day", F.floor(F.col("first_us") / stretch))
    days = each.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("cases"))
    nth = F.row_number().over(Window.partitionBy("day").orderBy("first_us", "case_id"))
    out = each.withColumn("nth", nth).join(days, "day").withColumn("number", (F.col("before") + F.col("nth") + (start - 1)).cast("bigint"))
    text = F.col("number").cast("string")
    width = F.greatest(F.lit(min_width), F.length((F.col("cases") + (start - 1)).cast("string")))
    return out.select("case_id", "number", F.concat(F.repeat(F.lit("0"), width - F.length(text)), text).alias("padded"))


def lookup(df: DataFrame, mapping: Mapping[str, str], key: str, into: str) -> DataFrame:
    """What a small mapping says of the key; null for others."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(into, F.try_element_at(pairs, F.col(key)))


def window_of(ts: Column, cuts: Iterable[int]) -> Column:
    """The number of cuts at or before ts: half-open windows."""
    return reduce(lambda a, b: a + b, [(ts >= c).cast("int") for c in cuts], F.lit(0))


def split_log(log: DataFrame, cuts: Iterable[int], half_open: bool = True) -> DataFrame:
    """Events with their window. Not half-open: each window ends a second before the cut, inclusive, and what lies in between is lost."""
    cuts = sorted(cuts)
    out = log.withColumn("window", window_of(F.col("ts_us"), cuts))
    if half_open:
        return out
    ends = F.element_at(F.array(*[F.lit(c - 1_000_000) for c in cuts], F.lit(LAST_US)), F.col("window") + 1)
    return out.where((F.col("ts_us") >= FIRST_US) & (F.col("ts_us") <= ends))


def split_names(cuts: Iterable[int], stem: str) -> list[tuple[int, str, str, str]]:
    """(window, name, from, to) of each window: the name is stem_window_i, from and to are ISO times in UTC, the latter a second before the next cut."""
    iso = lambda us: (datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(sep=" ")
    cuts = sorted(cuts)
    edges = [*zip([FIRST_US, *cuts], [*(c - 1_000_000 for c in cuts), LAST_US], strict=True)]
    return [(i, f"{stem}_window_{i}", iso(a), iso(b)) for i, (a, b) in enumerate(edges)]


def write_windows(log: DataFrame, cuts: Iterable[int], path: str, half_open: bool = True, by_case: bool = False) -> None:
    """Write the log once, cut in windows: a folder window=i for each, so that reading one window scans its folder alone. Windows that are written again are replaced, others stay.

    by_case keeps cases whole, by their last event. Rows of a window are dealt over as many files as their size asks for (a rebalance, which splits large windows). Events
    without time (or, by_case, without case) are in the folder of the null window.
    """
    cut = split_traces_by_last_event(log, cuts) if by_case else split_log(log, cuts, half_open)
    cut.hint("rebalance", "window").write.partitionBy("window").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_window(spark: SparkSession, path: str, window: int) -> DataFrame:
    """The events of one window of write_windows."""
    return spark.read.parquet(path).where(F.col("window") == window)


def split_report(split: DataFrame) -> DataFrame:
    """window, first_us, last_us, traces, events. Events without case count as events, not as traces."""
    return split.groupBy("window").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.countDistinct("case_id").alias("traces"), F.count(F.lit(1)).alias("events"))


def split_by_last_event(log: DataFrame, cuts: Iterable[int]) -> DataFrame:
    """case_id, window: whole cases, by their last event."""
    return cases(log).groupBy("case_id").agg(F.max("ts_us").alias("last_us")).select("case_id", window_of(F.col("last_us"), sorted(cuts)).alias("window"))


def split_traces_by_last_event(log: DataFrame, cuts: Iterable[int]) -> DataFrame:
    """Events with the window of their case's last event, so that no case is divided; null for events without case."""
    last = F.when(F.col("case_id").isNotNull(), F.max("ts_us").over(Window.partitionBy("case_id", apart())))
    return log.withColumn("window", F.when(last.isNotNull(), window_of(last, sorted(cuts))))


def apart() -> Column:
    """A second key beside case_id: null within cases, and another one for each event without case, so that these don't meet in one task."""
    return F.when(F.col("case_id").isNull(), F.xxhash64(*ORDER))


def phases(log: DataFrame, parts: int = 3, cuts: Iterable[int] | None = None) -> DataFrame:
    """case_id, phase: by the case's first event; a boundary belongs to the later phase. Without cuts the span of all cases (not of events without one) is cut evenly."""
    first = cases(log).groupBy("case_id").agg(F.min("ts_us").alias("first_us"))
    if cuts is not None:
        return first.select("case_id", window_of(F.col("first_us"), sorted(cuts)).alias("phase"))
    span = cases(log).agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    phase = reduce(lambda a, b: a + b, [(F.col("first_us") >= F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * i / parts)).cast("int") for i in range(1, parts)])
    return first.crossJoin(F.broadcast(span)).select("case_id", phase.alias("phase"))  # span: one row


def case_variants(log: DataFrame) -> DataFrame:
    """case_id, variant: the case's activities in order."""
    steps = F.array_sort(F.collect_list(F.struct(*ORDER, "activity")))
    return cases(log).groupBy("case_id").agg(F.array_join(F.transform(steps, lambda s: s["activity"]), ">").alias("variant"))


def variants(log: DataFrame) -> DataFrame:
    """variant, n: how many cases take that path. Events without case are on none; a null activity is left out of its path."""
    return case_variants(log).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


def variant_count(log: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("variant") if approximate else F.countDistinct("variant")
    return case_variants(log).agg(count.alias("variants"))


def variant_pareto(log: DataFrame) -> DataFrame:
    """Variants by rank, with share and cumulative share. Variants are numbered by count first, so the window over all has a row for each count only."""
    v = variants(log)
    by_n = v.groupBy("n").agg(F.count(F.lit(1)).alias("same"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum(F.col("n") * F.col("same")).over(Window.partitionBy())
    by_n = by_n.select("n", F.coalesce(F.sum("same").over(above), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("n") * F.col("same")).over(above), F.lit(0)).alias("held"), everything.alias("total"))
    v = v.withColumn("nth", F.row_number().over(Window.partitionBy("n").orderBy("variant"))).join(by_n, "n")
    return v.select("variant", "n", (F.col("before") + F.col("nth")).alias("rank"), F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round((F.col("held") + F.col("n") * F.col("nth")) / F.col("total"), 6).alias("cumulative"))


def top_variants(log: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent variants; of equally frequent ones those first in order of their text."""
    return variants(log).orderBy(F.desc("n"), "variant").limit(k)


def variant_diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants that only b has, only a has, and both have."""
    x, y = variants(a).select("variant"), variants(b).select("variant")
    return y.subtract(x), x.subtract(y), x.intersect(y)


def event_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("events"))


def case_ids(log: DataFrame) -> DataFrame:
    return cases(log).select("case_id").distinct().orderBy("case_id")


def trace_length_distribution(log: DataFrame) -> DataFrame:
    sizes = cases(log).groupBy("case_id").agg(F.count(F.lit(1)).alias("length"))
    return sizes.groupBy("length").agg(F.count(F.lit(1)).alias("cases")).orderBy("length")


def compare_trace_lengths(log: DataFrame, labels: list[str]) -> DataFrame:
    """length, then one column of case counts for each label; 0 where a log has none."""
    sizes = cases(log).groupBy("log", "case_id").agg(F.count(F.lit(1)).alias("length"))
    return sizes.groupBy("length").pivot("log", labels).agg(F.count(F.lit(1))).na.fill(0, labels)


def cases_with(log: DataFrame, activity: str) -> DataFrame:
    """case_id of the cases in which the activity occurs."""
    return cases(log).select("case_id").distinct().join(log.where(F.col("activity") == activity).select("case_id"), "case_id", "left_semi")


def cases_without(log: DataFrame, activity: str) -> DataFrame:
    """case_id of the cases in which the activity does not occur."""
    return cases(log).select("case_id").distinct().join(log.where(F.col("activity") == activity).select("case_id"), "case_id", "left_anti")


def rework(log: DataFrame) -> DataFrame:
    """activity, cases that repeat it, repeats."""
    n = cases(log).groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.groupBy("activity").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("n") - 1).alias("repeats"))


def duration_stats(log: DataFrame, by: str = "activity", accuracy: int | None = None) -> DataFrame:
    """Service time: n, mean, median, 90 % and deviation. Quantiles are exact, by selection in several passes (quantiles.py); with accuracy, approximate in one."""
    from caseloom.operators.quantiles import exact_quantiles

    s = (F.col("ts_us") - F.col("start_us")) / 1e6
    basic = [F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean_s")]
    if accuracy is not None:
        return log.groupBy(by).agg(*basic, F.round(F.percentile_approx(s, 0.5, accuracy), 6).alias("median_s"), F.round(F.percentile_approx(s, 0.9, accuracy), 6).alias("p90_s"), F.round(F.stddev_samp(s), 6).alias("sd_s"))
    known = same_key_join(log.groupBy(by).agg(*basic, F.round(F.stddev_samp(s), 6).alias("sd_s")), exact_quantiles(log, [by], s, [0.5, 0.9]), [by], "left")
    return known.select(by, "n", "mean_s", F.round("q0", 6).alias("median_s"), F.round("q1", 6).alias("p90_s"), "sd_s")


def correlation(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(x, y), 6).alias("corr"), F.round(F.regr_slope(F.col(y), F.col(x)), 6).alias("slope"), F.round(F.covar_samp(x, y), 6).alias("covar"))


def arrivals(log: DataFrame) -> DataFrame:
    """case_id, first_us: when each case's first event is complete."""
    return cases(log).groupBy("case_id").agg(F.min("ts_us").alias("first_us"))


def arrival_profile(log: DataFrame, by: str) -> DataFrame:
    """Case starts by weekday (Monday 0), hour or day, with an index against the mean of those that occur."""
    t = F.timestamp_micros("first_us")
    key = {"weekday": F.weekday(t), "hour": F.hour(t), "day": F.dayofyear(t)}[by]
    n = arrivals(log).groupBy(key.cast("bigint").alias(by)).agg(F.count(F.lit(1)).alias("cases"))
    return n.withColumn("index", F.round(F.col("cases") / F.avg("cases").over(Window.partitionBy()), 6))


def phase_report(log: DataFrame, without: str, ended: str, before: tuple[str, str]) -> DataFrame:
    """phase, cases, arrivals a day, and shares: without an activity, with one before another, ended by one."""
    at = lambda a: F.min(F.when(F.col("activity") == a, F.col("ts_us")))
    case = cases(log).groupBy("case_id").agg(F.min("ts_us").alias("first_us"), F.max_by("activity", F.struct(*ORDER)).alias("last"), at(without).alias("x"), at(before[0]).alias("a"), at(before[1]).alias("b"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    days = (F.max("first_us") - F.min("first_us")) / DAY
    return (
        case.join(phases(log), "case_id")
        .groupBy("phase")
        .agg(
            F.count(F.lit(1)).alias("cases"), F.round(F.count(F.lit(1)) / F.nullif(days, F.lit(0.0)), 6).alias("per_day"), share(F.col("x").isNull()).alias("without"),
            share(F.col("a") < F.col("b")).alias("precedes"), share(F.col("last") == ended).alias("ended"),
        )
    )


def phase_shares(log: DataFrame, attribute: str) -> DataFrame:
    """phase, value, cases, share: of the cases of each phase, how many have each value of an attribute (that of their first event)."""
    case = cases(log).groupBy("case_id").agg(F.min_by(attribute, F.struct(*ORDER)).alias("value"))
    n = case.join(phases(log), "case_id").groupBy("phase", "value").agg(F.count(F.lit(1)).alias("cases"))
    return n.withColumn("share", F.round(F.col("cases") / F.sum("cases").over(Window.partitionBy("phase")), 6))


def precedes_rate(log: DataFrame, first: str, second: str) -> DataFrame:
    """Of the cases that have both, how many have first before second."""
    at = lambda a: F.min(F.when(F.col("activity") == a, F.col("ts_us")))
    case = cases(log).groupBy("case_id").agg(at(first).alias("a"), at(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return case.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("a") < F.col("b")).cast("int")), 6).alias("rate"))


def sorted_log(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("case_id").asc_nulls_last(), F.col("ts_us").asc_nulls_last(), F.col("event_id").asc_nulls_last())


def head(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.col("ts_us").asc_nulls_last(), "event_id").limit(n)
