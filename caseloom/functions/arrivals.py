"""Expected arrivals: seasonal, weekly and daily multipliers of a base rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multipliers from Monday to Sunday.
WEEK = (0.9, 0.9, 0.95, 1.0, 1.1, 1.45, 1.4)


def _bell(x: Column, centre: float, width: float) -> Column:
    return F.exp(-((x - centre) * (x - centre)) / (2.0 * width * width))


def seasonal_multiplier(ts: Column) -> Column:
    """High in late November, low in late July."""
    day = F.dayofyear(ts).cast("double")
    return F.greatest(F.lit(0.15), 1.0 + 1.8 * _bell(day, 330.0, 18.0) - 0.55 * _bell(day, 205.0, 30.0))


def weekly_multiplier(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in WEEK]), F.weekday(ts) + 1)


def intraday_multiplier(ts: Column) -> Column:
    """Low at night, a small peak at 13 h and a large one at 21 h; seconds don't count."""
    h = F.hour(ts) + F.minute(ts) / 60.0
    floor = F.when((h < 6) | (h > 23.5), 0.05).otherwise(0.25)
    return floor + 0.4 * _bell(h, 13.0, 1.5) + 1.3 * _bell(h, 21.0, 2.0)


def multiplier(ts: Column) -> Column:
    return seasonal_multiplier(ts) * weekly_multiplier(ts) * intraday_multiplier(ts)


def expected_arrivals(spine: DataFrame, total: DataFrame, hours: int = 6, drift_from: str | None = None, drift: float = 1.0) -> DataFrame:
    """spine (bucket_us, ts), total (one row, cases) -> bucket_us, expected: arrivals an hour so that the whole spine expects total."""
    factor = F.when(F.col("ts") >= F.lit(drift_from).cast("timestamp"), F.lit(drift)).otherwise(1.0) if drift_from else F.lit(1.0)
    s = spine.withColumn("m", multiplier(F.col("ts")) * factor)
    base = s.agg((F.count(F.lit(1)) * F.lit(float(hours)) * F.avg("m")).alias("weight")).crossJoin(total)  # one row each
    return s.crossJoin(F.broadcast(base)).select("bucket_us", (F.col("cases") / F.col("weight") * F.col("m")).alias("expected"))


def arrival_residual(expected: DataFrame, arrivals: DataFrame, width_us: int) -> DataFrame:
    """bucket_us, observed, expected in the bucket, residual, ratio."""
    n = arrivals.groupBy((F.floor(F.col("first_us") / width_us) * width_us).alias("bucket_us")).agg(F.count(F.lit(1)).alias("observed"))
    hours = width_us / 3_600_000_000
    e = expected.join(n, "bucket_us", "left").na.fill(0, ["observed"]).withColumn("expected", F.col("expected") * hours)
    return e.select("bucket_us", "observed", F.round("expected", 6).alias("expected"), F.round(F.col("observed") - F.col("expected"), 6).alias("residual"), F.round(F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0)), 6).alias("ratio"))
