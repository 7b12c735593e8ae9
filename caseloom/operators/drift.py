"""Drift: how far windows are from the ones before, where the signal changes, and how well that finds known points.

Signals have one row a time bucket, so windows over a whole signal are over a small table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.log import arrivals, assign_case_ids


def window_distance(freq: DataFrame) -> DataFrame:
    """freq (bucket, state, share), zero-filled -> bucket, and distances from the bucket before: total variation, Hellinger, Jensen-Shannon (base 2)."""
    f = freq.withColumn("was", F.lag("share").over(Window.partitionBy("state").orderBy("bucket"))).where("was IS NOT NULL")
    p, q = F.col("share"), F.col("was")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return f.groupBy("bucket").agg(
        F.round(F.sum(F.abs(p - q)) / 2, 6).alias("tv"), F.round(F.sqrt(F.greatest(1 - F.sum(F.sqrt(p * q)), F.lit(0.0))), 6).alias("hellinger"), F.round(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0)), 6).alias("js")
    )


def feature_shift(df: DataFrame, features: list[str], at: str = "bucket") -> DataFrame:
    """bucket, feature, shift: the change of the mean from the bucket before, in pooled standard deviations."""
    stats = df.groupBy(at).agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.var_samp(f).alias(f"v_{f}"))])
    w = Window.orderBy(at)
    rows = []
    for f in features:
        m, v = F.col(f"m_{f}"), F.col(f"v_{f}")
        pooled = F.sqrt((v + F.lag(v).over(w)) / 2)
        rows.append(stats.select(at, F.lit(f).alias("feature"), F.round((m - F.lag(m).over(w)) / F.nullif(pooled, F.lit(0.0)), 6).alias("shift")))
    return reduce(DataFrame.unionAll, rows)


def change_points(signal: DataFrame, value: str, k: float = 1.0, min_sep: int = 2) -> DataFrame:
    """Buckets whose value is at least mean + k sd and the largest within min_sep buckets; of equal ones the first."""
    every, w = Window.partitionBy(), Window.orderBy("bucket")
    s = signal.withColumn("limit", F.avg(value).over(every) + k * F.stddev_samp(value).over(every))
    s = s.withColumns({"before": F.max(value).over(w.rowsBetween(-min_sep, -1)), "after": F.max(value).over(w.rowsBetween(1, min_sep))})
    v = F.col(value)
    return s.where((v >= F.col("limit")) & (F.col("before").isNull() | (v > F.col("before"))) & (F.col("after").isNull() | (v >= F.col("after")))).select("bucket", F.round(v, 6).alias("score"))


def cusum(signal: DataFrame, value: str) -> DataFrame:
    """bucket, cusum: the running sum of deviations from the mean, less its running minimum."""
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    s = signal.withColumn("d", F.col(value) - F.avg(value).over(Window.partitionBy())).withColumn("s", F.sum("d").over(w))
    return s.select("bucket", F.round(F.col("s") - F.least(F.min("s").over(w), F.lit(0.0)), 6).alias("cusum"))


def combined_signal(signals: list[DataFrame], value: str = "tv") -> DataFrame:
    """bucket, signal: the mean of the z-scores of several signals, over the buckets that all have."""
    every = Window.partitionBy()
    scored = [s.select("bucket", ((F.col(value) - F.avg(value).over(every)) / F.nullif(F.stddev_samp(value).over(every), F.lit(0.0))).alias(f"z{i}")) for i, s in enumerate(signals)]
    joined = reduce(lambda a, b: a.join(b, "bucket"), scored)
    return joined.select("bucket", F.round(reduce(lambda a, b: a + b, [F.coalesce(f"z{i}", F.lit(0.0)) for i in range(len(signals))]) / len(signals), 6).alias("signal"))


def match_drifts(detected: DataFrame, known: DataFrame, tolerance: int) -> DataFrame:
    """known, bucket, delay: each known point with what is detected up to tolerance buckets after it. Known points are laid out over their buckets, so this is a join on equal buckets."""
    spread = known.select("known", F.explode(F.sequence(F.col("known"), F.col("known") + tolerance)).alias("bucket"))
    return detected.join(spread, "bucket").select("known", "bucket", (F.col("bucket") - F.col("known")).alias("delay"))


def drift_evaluation(detected: DataFrame, known: DataFrame, tolerance: int) -> DataFrame:
    """One row: detected, known, precision, recall, mean delay of the first hit."""
    hits = match_drifts(detected, known, tolerance)
    first = hits.groupBy("known").agg(F.min("delay").alias("delay"))
    right = hits.agg(F.countDistinct("bucket").alias("right")).crossJoin(first.agg(F.count(F.lit(1)).alias("found"), F.avg("delay").alias("delay")))
    counts = detected.agg(F.count(F.lit(1)).alias("detected")).crossJoin(known.agg(F.count(F.lit(1)).alias("known"))).crossJoin(right)  # one row each
    return counts.select("detected", "known", F.round(F.col("right") / F.nullif(F.col("detected"), F.lit(0)), 6).alias("precision"), F.round(F.col("found") / F.nullif(F.col("known"), F.lit(0)), 6).alias("recall"), F.round("delay", 6).alias("mean_delay"))


#: Where known drifts lie, as fractions of the traces in order of their first events: (shape, [(from, to), ...]). A sudden drift is a point, a gradual one a stretch, a recurring
#: one alternates at the ends of equal seasons, an incremental one steps from version to version.
SHAPES = [
    ("sudden", [(0.5, 0.5)]),
    ("gradual", [(0.4, 0.6)]),
    ("recurring", [(0.2, 0.2), (0.4, 0.4), (0.6, 0.6), (0.8, 0.8)]),
    ("incremental", [(0.25, 0.25), (0.5, 0.5), (0.75, 0.75)]),
]


def drift_intervals(log: DataFrame, shapes: Iterable[tuple[str, list[tuple[float, float]]]] = SHAPES) -> DataFrame:
    """shape, part, from_us, to_us: known drifts, from fractions of the traces to the times at which those traces begin.

    The trace at fraction f of n is number floor(f * n) + 1, the last at most, in order of first events (assign_case_ids), so no window orders all traces. A log without cases gives no rows.
    """
    ends = [(s, i, k, f) for s, parts in shapes for i, part in enumerate(parts, 1) for k, f in enumerate(part)]
    wanted = log.sparkSession.createDataFrame(ends, "shape string, part int, `end` int, fraction double")  # some rows
    numbered = assign_case_ids(log).select("case_id", "number").join(arrivals(log), "case_id").select("number", "first_us")
    total = numbered.agg(F.count(F.lit(1)).alias("n"))  # one row
    wanted = wanted.crossJoin(F.broadcast(total)).withColumn("number", F.least(F.floor(F.col("fraction") * F.col("n")) + 1, F.col("n")))
    at = numbered.join(F.broadcast(wanted), "number")
    return at.groupBy("shape", "part").agg(F.min(F.when(F.col("end") == 0, F.col("first_us"))).alias("from_us"), F.min(F.when(F.col("end") == 1, F.col("first_us"))).alias("to_us"))


def match_intervals(detected: DataFrame, known: DataFrame, tolerance: int, by: str = "shape") -> DataFrame:
    """by, part, bucket, delay: detections (bucket) one to one with known intervals (by, part, from, to, in buckets), up to tolerance buckets after their ends.

    A detection counts for the first of the intervals of its kind that hold it, an interval takes the first detection that counts for it; so further hits of one drift are not right
    twice. delay is from the interval's start. Intervals are laid out over their buckets, so this is a join on equal buckets.
    """
    spread = known.select(by, "part", F.col("from").alias("start"), F.explode(F.sequence("from", F.col("to") + tolerance)).alias("bucket"))
    hits = detected.select("bucket").distinct().join(spread, "bucket")
    own = F.row_number().over(Window.partitionBy(by, "bucket").orderBy("start", "part"))
    first = hits.withColumn("nth", own).where("nth = 1").groupBy(by, "part", "start").agg(F.min("bucket").alias("bucket"))
    return first.select(by, "part", "bucket", (F.col("bucket") - F.col("start")).alias("delay"))


def shape_evaluation(detected: DataFrame, known: DataFrame, tolerance: int, by: str = "shape") -> DataFrame:
    """by, detected, known, matched, precision, recall, mean_delay: how well the detections find the known intervals of each kind, one to one."""
    right = match_intervals(detected, known, tolerance, by).groupBy(by).agg(F.count(F.lit(1)).alias("matched"), F.avg("delay").alias("delay"))
    n = detected.select("bucket").distinct().agg(F.count(F.lit(1)).alias("detected"))  # one row
    out = known.groupBy(by).agg(F.count(F.lit(1)).alias("known")).join(right, by, "left").na.fill(0, ["matched"]).crossJoin(F.broadcast(n))
    share = lambda of: F.round(F.col("matched") / F.nullif(F.col(of), F.lit(0)), 6)
    return out.select(by, "detected", "known", "matched", share("detected").alias("precision"), share("known").alias("recall"), F.round("delay", 6).alias("mean_delay"))
