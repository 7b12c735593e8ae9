"""Exact quantiles by selection over several passes, so that no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.log import same_key_join
from caseloom.operators.stage import small, staged

#: A bracket with at most so many values is ordered; parts into which a larger one is cut; accuracy of the sketch that gives the first brackets.
MOST, PARTS, ACCURACY = 100_000, 1024, 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: Column, shares: list[float], most: int = MOST, accuracy: int = ACCURACY) -> DataFrame:
    """by, q0, q1, ...: the interpolated quantiles of value in each group, as percentile() has them; null values don't count, a null key is one like any other.

    A mergeable sketch brackets each quantile; the values below and inside the bracket are counted exactly, and a bracket that does not hold the ranks sought is widened to all values.
    As long as one holds more than most values it is cut into PARTS of equal width, counted, and narrowed to those that hold the ranks. Then only the values
    inside brackets are ordered. Equal values never make a bracket long: they are counted by value. A group without values is left out.
    """
    v = staged(df.select(*by, value.cast("double").alias("__v")).where("__v IS NOT NULL"), "quantile-values")
    sides = [x for p in shares for x in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    groups = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.percentile_approx("__v", sides, accuracy).alias("sides"))
    rank = lambda p: F.lit(p) * (F.col("n") - 1)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(rank(p)).alias("k1"), F.ceil(rank(p)).alias("k2"), (rank(p) - F.floor(rank(p))).alias("part"), F.col("sides")[2 * i].alias("lo"), F.col("sides")[2 * i + 1].alias("hi")) for i, p in enumerate(shares)])
    asked = staged(groups.select(*by, "least", "greatest", F.explode(each).alias("x")).select(*by, "least", "greatest", "x.*"), "quantile-brackets")
    inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
    key = [*by, "i"]

    def counted(asked: DataFrame) -> DataFrame:
        """asked with below and held: how many values lie before and in its bracket."""
        n = _join(v, asked, by).groupBy(*key).agg(F.sum((F.col("__v") < F.col("lo")).cast("bigint")).alias("below"), F.sum(inside.cast("bigint")).alias("held"))
        return staged(same_key_join(asked, n, key), "quantile-brackets")

    sure = (F.col("below") <= F.col("k1")) & (F.col("below") + F.col("held") > F.col("k2"))
    asked = counted(asked)
    if not asked.where(~sure).isEmpty():
        wide = asked.withColumns({"lo": F.when(sure, F.col("lo")).otherwise(F.col("least")), "hi": F.when(sure, F.col("hi")).otherwise(F.col("greatest"))})
        asked = counted(wide.drop("below", "held"))
    large = (F.col("held") > most) & (F.col("lo") < F.col("hi"))
    while not asked.where(large).isEmpty():
        width = (F.col("hi") - F.col("lo")) / PARTS
        part = F.least(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(PARTS - 1))
        rows = _join(v, asked.where(large), by).where(inside).withColumn("part", part)
        rows = rows.groupBy(*key, "k1", "k2", "below", "part").agg(F.min("__v").alias("a"), F.max("__v").alias("b"), F.count(F.lit(1)).alias("c"))
        after = F.col("below") + F.sum("c").over(Window.partitionBy(*key).orderBy("part"))  # PARTS rows at most
        found = rows.withColumn("after", after).where((F.col("after") > F.col("k1")) & (F.col("after") - F.col("c") <= F.col("k2")))
        found = found.groupBy(*key).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
        narrow = same_key_join(asked.where(large).drop("lo", "hi", "below", "held"), found, key)
        narrow = counted(staged(narrow, "quantile-brackets"))
        asked = staged(asked.where(~large).unionByName(narrow.select(*asked.columns)), "quantile-brackets")
    values = _join(v, asked, by).where(inside).groupBy(*key, "k1", "k2", "part", "below", "__v").agg(F.count(F.lit(1)).alias("c"))
    after = F.col("below") + F.sum("c").over(Window.partitionBy(*key).orderBy("__v"))
    at = values.withColumn("after", after)
    lower = lambda k: F.min(F.when(F.col("after") > F.col(k), F.col("__v")))
    got = at.groupBy(*key, "part").agg(lower("k1").alias("a"), lower("k2").alias("b"))
    got = got.withColumn("q", (1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))])


def _join(v: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Values with the brackets of their group: one row for each share; the table of brackets is narrow, and is sent around if its rows are few."""
    return same_key_join(v, small(asked), by) if by else v.crossJoin(small(asked))  # without keys a row for each share
