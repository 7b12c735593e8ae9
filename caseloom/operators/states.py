"""States of a running case, of a resource, and of the whole process; what they look like and how they change."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.log import DAY, cases, same_key_join
from caseloom.operators.stage import staged
from caseloom.operators.windows import in_case, prefix_counts, runs

HOUR = 3_600_000_000


def intra_case_state(log: DataFrame, activities: list[str] | None = None, attributes: list[str] | None = None) -> DataFrame:
    """event_id, case_id, idx, gap_us, elapsed_us, state: last activity, how far the case is, how long it paused.

    With activities, also how often each has occurred in the case so far (n_<activity>); with attributes, these columns of the log. Events without case have no such state.
    """
    w, log = in_case(), cases(log)
    s = prefix_counts(log, activities or []).withColumns({"idx": F.row_number().over(w), "gap_us": F.col("ts_us") - F.lag("ts_us").over(w), "elapsed_us": F.col("ts_us") - F.first("ts_us").over(w)})
    far = F.when(F.col("idx") == 1, "first").when(F.col("idx") <= 3, "early").otherwise("late")
    pause = F.when(F.col("gap_us").isNull(), "none").when(F.col("gap_us") < HOUR, "short").when(F.col("gap_us") < 6 * HOUR, "medium").otherwise("long")
    more = [f"n_{a}" for a in activities or []] + list(attributes or [])
    return s.select("event_id", "case_id", "ts_us", "resource", "idx", "gap_us", "elapsed_us", F.concat_ws("|", "activity", far, pause).alias("state"), *[F.col(f"`{c}`") for c in more])


def spine(log: DataFrame, width: int = DAY, of: DataFrame | None = None) -> DataFrame:
    """bucket: every time bucket from the first event to the last; with of, for each of its rows."""
    ends = log.agg(F.floor(F.min("ts_us") / width).alias("a"), F.floor(F.max("ts_us") / width).alias("b"))
    rows = ends if of is None else of.crossJoin(F.broadcast(ends))  # one row
    return rows.select(*(of.columns if of is not None else []), F.explode(F.sequence("a", "b")).alias("bucket"))


def resource_state(log: DataFrame, width: int = DAY, low: float = 0.25, high: float = 0.9, by: str = "resource") -> DataFrame:
    """The column by (a resource, a role or a team), bucket, events, cases, activities, handovers, wait_s, state (idle, normal, busy by quantiles of events), zero-filled.

    Events without that column's value are those of the value null. A handover is an event whose case was with another value before; null hands nothing over and gets nothing.
    """
    w = in_case()
    e = log.withColumns({"bucket": F.floor(F.col("ts_us") / width), "from": F.lag(by).over(w), "wait": F.col("start_us") - F.lag("ts_us").over(w)})
    n = e.groupBy(by, "bucket").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("case_id").alias("cases"), F.countDistinct("activity").alias("activities"),
        F.sum((F.col("from") != F.col(by)).cast("bigint")).alias("handovers"), (F.sum("wait").cast("double") / F.count("wait") / 1e6).alias("wait_s"),
    )
    s = same_key_join(spine(log, width, log.select(by).distinct()), n, [by, "bucket"], "left").na.fill(0, ["events", "cases", "activities", "handovers"]).na.fill(0.0, ["wait_s"])
    cut = s.agg(F.percentile("events", F.lit(low)).alias("lo"), F.percentile("events", F.lit(high)).alias("hi"))
    state = F.when(F.col("events") <= F.col("lo"), "idle").when(F.col("events") >= F.col("hi"), "busy").otherwise("normal")
    return s.crossJoin(F.broadcast(cut)).withColumn("state", state).drop("lo", "hi")  # one row of quantiles


def active_by_bucket(log: DataFrame, width: int = 6 * HOUR) -> DataFrame:
    """bucket, arrivals, active: cases that begin in each bucket, and cases that are open in it, from the first event's bucket to the last's.

    A case adds one in its first bucket and takes it away after its last, so its length makes no rows; the sum runs over the table of buckets.
    """
    case = cases(log).groupBy("case_id").agg(F.floor(F.min("ts_us") / width).alias("a"), F.floor(F.max("ts_us") / width).alias("b"))
    step = lambda at, came, d: F.struct(at.alias("bucket"), F.lit(came).alias("came"), F.lit(d).alias("d"))
    steps = case.select(F.explode(F.array(step(F.col("a"), 1, 1), step(F.col("b") + 1, 0, -1))).alias("s"))
    steps = steps.groupBy("s.bucket").agg(F.sum("s.came").alias("arrivals"), F.sum("s.d").alias("d"))
    full = spine(log, width).join(steps, "bucket", "left").na.fill(0, ["arrivals", "d"])
    return full.select("bucket", "arrivals", F.sum("d").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("active"))


def inter_case_state(log: DataFrame, width: int = 6 * HOUR) -> DataFrame:
    """bucket, events, arrivals, active, gap_s, state: congested, bursty, slow or normal by quantiles."""
    bucket = lambda c: F.floor(F.col(c) / width)
    # The gaps of a bucket add up to its last event less that of the bucket before, so no event need be ordered.
    n = log.groupBy(bucket("ts_us").alias("bucket")).agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    before = F.lag("last").over(Window.orderBy("bucket"))
    gaps, since = F.col("events") - before.isNull().cast("int"), F.col("last") - F.coalesce(before, F.col("first"))
    n = n.select("bucket", "events", (since / F.nullif(gaps, F.lit(0)) / 1e6).alias("gap_s"))
    s = active_by_bucket(log, width).join(n, "bucket", "left").na.fill(0, ["events"]).na.fill(0.0, ["gap_s"]).select("bucket", "events", "gap_s", "arrivals", "active")
    q = lambda c, p: F.percentile(c, F.lit(p))
    cut = s.agg(q("active", 0.9).alias("a90"), q("events", 0.9).alias("e90"), q("events", 0.1).alias("e10"))
    state = F.when(F.col("active") >= F.col("a90"), "congested").when(F.col("events") >= F.col("e90"), "bursty").when(F.col("events") <= F.col("e10"), "slow").otherwise("normal")
    return s.crossJoin(F.broadcast(cut)).withColumn("state", state).drop("a90", "e90", "e10")  # one row of quantiles


def state_frequency(states: DataFrame, at: str = "bucket", weight: str | None = None, fill: bool = True) -> DataFrame:
    """bucket, state, n (rows, or the sum of weight), share; zero for states that a bucket lacks.

    Every bucket from the first to the last is there (whole numbers); one without rows has shares of zero. With fill=False only those that occur.
    """
    n = states.groupBy(at, "state").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    if fill:
        ends = n.agg(F.min(at).alias("__a"), F.max(at).alias("__b"))  # one row
        every = n.select("state").distinct().crossJoin(F.broadcast(ends)).select(F.explode(F.sequence("__a", "__b")).alias(at), "state")
    else:
        every = n.select(at).distinct().crossJoin(n.select("state").distinct())  # both distinct
    full = every.join(n, [at, "state"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.coalesce(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(at)), F.lit(0)), F.lit(0.0)))


def state_transitions(states: DataFrame, key: list[str], at: str = "bucket") -> DataFrame:
    """from, to, n, probability."""
    t = states.select(F.lag("state").over(Window.partitionBy(*key).orderBy(at)).alias("from"), F.col("state").alias("to")).where("`from` IS NOT NULL")
    n = t.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from")), 6))


def state_profile(states: DataFrame, features: list[str]) -> DataFrame:
    """state, feature, inside, rest, difference in standard deviations of all. Rows where a feature is null count for the others only.

    One pass: counts, means and squared deviations by state are merged, so that no large squares are taken from each other; a feature that is the same
    everywhere, but for what doubles can't hold, has no difference (null).
    """
    aggs = [a for i, f in enumerate(features) for a in (F.count(f).alias(f"__n{i}"), F.avg(F.col(f).cast("double")).alias(f"__m{i}"), (F.var_pop(f) * F.count(f)).alias(f"__q{i}"))]
    by = states.groupBy("state").agg(*aggs)
    every = Window.partitionBy()  # a row for each state
    rows = []
    for i, f in enumerate(features):
        s = by.select("state", F.col(f"__n{i}").alias("n"), F.coalesce(f"__m{i}", F.lit(0.0)).alias("m"), F.coalesce(f"__q{i}", F.lit(0.0)).alias("q"))
        s = s.withColumns({"tn": F.sum("n").over(every), "ts": F.sum(F.col("n") * F.col("m")).over(every)}).withColumn("mean", F.col("ts") / F.nullif("tn", F.lit(0)))
        off = F.col("m") - F.col("mean")
        s = s.withColumn("variance", F.sum(F.col("q") + F.col("n") * off * off).over(every) / F.nullif(F.col("tn") - 1, F.lit(0)))
        sd = F.when(F.col("variance") > F.pow(F.col("mean") * 4e-15, F.lit(2)), F.sqrt("variance"))
        inside, rest = F.when(F.col("n") > 0, F.col("m")), (F.col("ts") - F.col("n") * F.col("m")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))
        rows.append(s.select("state", F.lit(f).alias("feature"), F.round(inside, 6).alias("inside"), F.round(rest, 6).alias("rest"), F.round((inside - rest) / sd, 6).alias("difference")))
    return reduce(DataFrame.unionAll, rows)


def border_conditions(states: DataFrame, key: list[str], features: list[str], at: str = "bucket", entering: bool = True, k: int = 1) -> DataFrame:
    """state, feature, base, border, lift: the features k buckets before a state is entered (entering), or in the k-th last one before it is left."""
    w = Window.partitionBy(*key).orderBy(at)
    if entering:
        s = states.withColumn("__border", F.lag("state").over(w) != F.col("state")).withColumns({f"__b_{f}": F.lag(f, k).over(w) for f in features})
    else:
        s = states.withColumn("__border", F.lead("state").over(w) != F.col("state")).withColumns({f"__b_{f}": F.lag(f, k - 1).over(w) if k > 1 else F.col(f) for f in features})
    base = states.agg(*[F.avg(f).alias(f"base_{f}") for f in features])
    border = s.where("__border").groupBy("state").agg(*[F.avg(f"__b_{f}").alias(f"border_{f}") for f in features]).crossJoin(F.broadcast(base))  # one row
    rows = [border.select("state", F.lit(f).alias("feature"), F.round(f"base_{f}", 6).alias("base"), F.round(f"border_{f}", 6).alias("border"), F.round(F.col(f"border_{f}") / F.nullif(F.col(f"base_{f}"), F.lit(0.0)), 6).alias("lift")) for f in features]
    return reduce(DataFrame.unionAll, rows)


def zscores(df: DataFrame, features: list[str]) -> DataFrame:
    """z_<feature> for each feature; 0 where all rows are equal."""
    of = df.agg(F.struct(*[a for i, f in enumerate(features) for a in (F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"d{i}"))]).alias("__stats"))
    out = df.crossJoin(F.broadcast(of))  # one row
    z = {f"z_{f}": F.coalesce((F.col(f) - F.col("__stats")[f"m{i}"]) / F.nullif(F.col("__stats")[f"d{i}"], F.lit(0.0)), F.lit(0.0)) for i, f in enumerate(features)}
    return out.withColumns(z).drop("__stats")


def state_vectors(df: DataFrame, features: list[str], into: str = "vector") -> DataFrame:
    """Assembled and standardised features."""
    raw = VectorAssembler(inputCols=features, outputCol="__raw").transform(df)
    return StandardScaler(inputCol="__raw", outputCol=into, withMean=True, withStd=True).fit(raw).transform(raw).drop("__raw")


def pca(vectors: DataFrame, k: int, col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """The vectors with k principal components, and component, variance (its share). Signs are arbitrary."""
    model = PCA(k=k, inputCol=col, outputCol="components").fit(vectors)
    share = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return model.transform(vectors), vectors.sparkSession.createDataFrame(share, "component int, variance double")


def cluster_states(vectors: DataFrame, k: int, seed: int = 7, col: str = "vector") -> DataFrame:
    """vectors with their cluster of k-means (0 to k - 1); vectors must have no column of that name."""
    return KMeans(k=k, seed=seed, featuresCol=col, predictionCol="cluster", maxIter=20).fit(vectors).transform(vectors)


def som_states(vectors: DataFrame, grid: tuple[int, int] = (3, 3), epochs: int = 5, col: str = "vector", seed: int = 7) -> DataFrame:
    """Batch self-organising map: vectors with their cell (null if there is none).

    The vectors are staged once, and every epoch reads that table: it assigns each vector to its best cell by an expression over the codebook's literals, and sums
    of cells are merged from partial sums of each partition, so a row for each cell returns to the driver. Neighbouring cells share their sums, less from epoch to epoch.
    """
    rows, cols = grid
    cells = rows * cols
    x = staged(vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), vector_to_array(col).alias("x")), "som-vectors")
    dims = x.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return vectors.withColumn("cell", F.lit(None).cast("int"))
    place = np.array([(i // cols, i % cols) for i in range(cells)], float)
    far = ((place[:, None] - place[None]) ** 2).sum(2)
    book = np.random.default_rng(seed).normal(0, 0.5, (cells, dims))

    def best(words: np.ndarray) -> F.Column:
        gaps = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for w in words]
        return (F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1).cast("int")

    for epoch in range(epochs):
        sums = x.select(best(book).alias("cell"), array_to_vector("x").alias("v")).groupBy("cell").agg(Summarizer.sum(F.col("v")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        total, count = np.zeros_like(book), np.zeros(cells)
        for r in sums:
            total[r["cell"]], count[r["cell"]] = r["s"].toArray(), r["n"]
        reach = np.exp(-far / (2 * (max(rows, cols) / 2 * (1 - epoch / epochs) + 0.3) ** 2))
        weight = reach @ count
        book = np.where(weight[:, None] > 1e-9, (reach @ total) / np.maximum(weight, 1e-9)[:, None], book)
    return x.select("row.*", best(book).alias("cell"))


def attach_state(events: DataFrame, states: DataFrame, key: str, at: str, state: str = "state") -> DataFrame:
    """Events with the latest state of their key at or before them; states hold from their time on. A column of events with the state's name is replaced; a null key is a key like any other.

    As-of by union: within a day states and events are ordered together; a day begins with the last state of earlier days, from a table with a row for each key and day.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    e = events.select(F.col(f"`{key}`").alias("key"), F.col("ts_us").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("s"), whole.alias("event"))
    s = states.select(F.col(f"`{key}`").alias("key"), F.col(f"`{at}`").alias("t"), F.lit(0).alias("kind"), F.col(f"`{state}`").alias("s"), F.lit(None).cast(e.schema["event"].dataType).alias("event"))
    both = e.unionByName(s).withColumn("day", F.floor(F.col("t") / DAY))
    last = both.groupBy("key", "day").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("t"))).alias("end"))
    last = last.select("key", "day", F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    here = F.last("s", ignorenulls=True).over(Window.partitionBy("key", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = same_key_join(both.withColumn("here", here).where("kind = 1"), last, ["key", "day"], "left")
    return out.select(*[F.col("event")[c].alias(c) for c in events.columns if c != state], F.coalesce("here", "carry").alias(state))


def state_runs(states: DataFrame, key: list[str], at: str = "bucket") -> DataFrame:
    """Stretches of equal states of each key: see windows.runs."""
    return runs(states, key, at)


