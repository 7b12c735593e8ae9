"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words. With ``ratio = target / source_size``, every document of it is taken ``floor(ratio)`` times
for certain. The words still missing are a sample of documents, one more copy each, with unequal inclusion probabilities
``p = factor * measure``: the measure is the square root of a document's words (or its priority, if a column is given), and the factor
is such that the expected words are the missing ones. Documents whose p would reach 1 are taken for certain, and the factor is that
of the rest.

The others are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with u a hash of doc_id in (0, 1), and the front of that order is
taken until the missing words are used up: the size that is fixed is counted in words. What the last document leaves open is closed by one document of
the rest, the one whose size is nearest to it (none, if that is nearer). So the probabilities hold but for one document a source.

No source is gathered in one task: words are summed by leading bits of the rank, the interval in which the words end is divided
again until it holds few rows, and only these are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, small, staged

#: Ranks are numbers of RANK bits; each round divides an interval by STEP of them, until it holds FEW rows of a source at most.
RANK, STEP, FEW = 48, 8, 2_000
#: Measures are whole numbers from 1 to this one; a priority of 1 counts UNIT.
MEASURES, UNIT = 4096, 64


def source_targets(sources: DataFrame, weights=(5, 2, 1), cap: float = 3.0, total_share: float = 1.0) -> DataFrame:
    """sources (skey, source, source_size) -> the same with ``target``.

    Sources by code point, null last, weigh ``weights`` repeating. Targets share total_share of all
    words by weight, none above cap times its source; the excess goes to the others by weight.
    With sources in order of cap / weight those that stop at their cap come first, so running
    sums over this table (one row a source, all in one task) give the level at which the others end.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy("room", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all_words") * F.lit(total_share) - F.coalesce(F.sum("most").over(by_room), F.lit(0.0))
    weight_left = F.col("all_weights") - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("level", left / weight_left)
        .withColumn("full", F.col("level") > F.col("room"))
        .withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))))
        .select("skey", "source", "source_size", "weight", "target")
    )


def _factors(levels: DataFrame) -> DataFrame:
    """levels (skey, measure, words, missing) -> skey, top, factor, left.

    Measures above top are taken for certain; those up to it have p = factor * measure and share the words that are left. top is the
    largest measure whose p stays below 1 when all larger ones are certain.
    """
    falling = Window.partitionBy("skey").orderBy(F.desc("measure"))
    rising = Window.partitionBy("skey").orderBy("measure")
    left = F.col("missing") - F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum((F.col("measure") * F.col("words")).cast("decimal(38,0)")).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    each = levels.select("skey", "measure", left.alias("left"), (left / weighed.cast("double")).alias("factor")).where(F.col("factor") * F.col("measure") < 1)
    return each.groupBy("skey").agg(F.max_by(F.struct("measure", "factor", "left"), "measure").alias("x")).select("skey", F.col("x.measure").alias("top"), "x.factor", "x.left")


def _ranked(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that are drawn by rank, with it (``q``, and ``rank``, RANK bits of ``q / (1 + q)``) and the state of their source."""
    x = rows.join(state, "skey").where((F.col("size") > 0) & (F.col("measure") <= F.col("top")) & (F.col("factor") > 0))
    return _with_rank(x).withColumn("rank", F.floor(F.col("q") / (1 + F.col("q")) * F.lit(float(1 << RANK))))


def _with_rank(x: DataFrame) -> DataFrame:
    x = x.withColumn("p", F.col("factor") * F.col("measure"))
    return x.withColumn("q", (F.col("u") / (1 - F.col("u"))) / F.nullif(F.col("p") / (1 - F.col("p")), F.lit(0.0)))


def _measure(size: Column, priority: Column | None) -> Column:
    """Whole numbers, so that their sums are the same in any order."""
    raw = F.ceil(F.sqrt(size)) if priority is None else F.round(F.coalesce(priority.cast("double"), F.lit(1.0)) * UNIT)
    return F.greatest(F.lit(1), F.least(F.lit(MEASURES), raw)).cast("bigint")


def _sized(docs: DataFrame, source_col: str, id_col: str, text_col: str, priority_col: str | None, whole: bool) -> DataFrame:
    """What the mix needs of each row; with whole, the row itself as well."""
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("bigint")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
        size.alias("size"),
        (F.col(priority_col) if priority_col else F.lit(None)).cast("double").alias("priority"),
        ((spread + 0.5) / F.lit(float(1 << 52))).alias("u"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    )
    return out.withColumn("measure", _measure(F.col("size"), F.col("priority") if priority_col else None)).drop("priority")


def _cuts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """skey, cut, open: the last q that is taken, and the words still missing then."""
    # The interval of ranks in which the words end, a prefix of the rank's bits, and the words before it.
    at = state.select("skey", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    cuts = None
    for bits in range(0, RANK + 1, STEP):
        here = _ranked(rows, small(state)).join(small(at), "skey").where(F.shiftright("rank", RANK - bits) == F.col("prefix"))
        if bits == RANK or here.groupBy("skey").count().where(F.col("count") > FEW).isEmpty():
            upto = F.col("before") + F.sum("size").over(Window.partitionBy("skey").orderBy("q"))
            inside = here.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("skey").agg(F.max("q").alias("last_q"), F.max("upto").alias("used"))
            got = at.join(inside, "skey", "left").select("skey", F.col("last_q").alias("last_in"), F.coalesce("used", "before").alias("used"))
            return got if cuts is None else got.join(cuts, "skey", "left").select("skey", F.coalesce("last_in", "last_q").alias("last_in"), "used")
        running = Window.partitionBy("skey").orderBy("prefix")
        heap = here.select("skey", F.shiftright("rank", RANK - bits - STEP).alias("prefix"), "size", "q", "before", "left")
        heap = heap.groupBy("skey", "prefix").agg(F.sum("size").alias("words"), F.max("q").alias("top_q"), F.first("before").alias("start"), F.first("left").alias("left"))
        heap = staged(heap.withColumn("upto", F.col("start") + F.sum("words").over(running)), "mix-heap")
        full = heap.where(F.col("upto") <= F.col("left")).groupBy("skey").agg(F.max("top_q").alias("last_q"), F.max("upto").alias("words"), F.max("prefix").alias("full"))
        split = heap.where(F.col("upto") > F.col("left")).groupBy("skey").agg(F.min("prefix").alias("split"))
        # Where nothing is split, everything left is taken: the interval is behind the last one, and empty.
        at = at.withColumnRenamed("before", "was").drop("prefix").join(full, "skey", "left").join(split, "skey", "left")
        at = staged(at.select("skey", "last_q", F.coalesce("split", F.lit(-1).cast("bigint")).alias("prefix"), F.coalesce("words", "was").alias("before")), "mix-interval")
        found = at.select("skey", "last_q")
        cuts = found if cuts is None else found.withColumnRenamed("last_q", "new_q").join(cuts, "skey").select("skey", F.coalesce("new_q", "last_q").alias("last_q"))
        at = at.drop("last_q")


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, total_share: float = 1.0, priority_col: str | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Return one row per input row: doc_id, source, size, source_size, target, copies, taken; with whole, also the input row as ``row``.

    Null text counts as no words; a null source is a source of its own; documents without words
    take no copies and no words. Rows that repeat a doc_id share its random number and are taken together.
    An empty table gives an empty result. Priorities count in 64ths from 1/64 to 64; a null one counts as 1. Other columns are ignored.
    """
    sized = lambda whole: _sized(docs, source_col, id_col, text_col, priority_col, whole)
    rows = staged(sized(False), "mix-sizes")
    levels = staged(rows.groupBy("skey", "measure").agg(F.sum("size").alias("words")), "mix-levels")
    sources = levels.groupBy("skey").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)))
    state = source_targets(sources, weights, cap, total_share)
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    state = state.withColumn("certain", F.floor(ratio)).withColumn("missing", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    state = staged(state, "mix-targets")
    factors = _factors(levels.where("words > 0").join(state.select("skey", "missing"), "skey"))
    state = staged(state.join(factors, "skey", "left"), "mix-factors")
    cuts = staged(_cuts(rows, state), "mix-cuts")
    state = staged(state.join(cuts, "skey", "left").withColumn("open", F.col("left") - F.col("used")).drop("used"), "mix-open")
    rest = _ranked(rows, small(state)).where(F.col("last_in").isNull() | (F.col("q") > F.col("last_in")))
    off = F.abs(F.col("size") - F.col("open"))
    closing = rest.where(off < F.col("open")).groupBy("skey").agg(F.min(F.struct(off.alias("off"), "q")).alias("x")).select("skey", F.col("x.q").alias("closing"))
    state = staged(state.join(closing, "skey", "left"), "mix-closed")
    done = _with_rank((sized(True) if whole else rows).join(small(state), "skey"))
    drawn = (F.col("measure") <= F.col("top")) & ((F.col("q") <= F.col("last_in")) | (F.col("q") == F.col("closing")))
    extra = F.coalesce((F.col("measure") > F.col("top")) | drawn, F.lit(False)) & (F.col("factor") > 0)
    done = done.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + F.coalesce(extra, F.lit(False)).cast("bigint")).otherwise(F.lit(0)).cast("bigint"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if whole else []))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    taken = mix(docs, whole=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


ORACLE = f"""
    WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
         r AS (SELECT *, greatest(1, least({MEASURES}, ceil(sqrt(size::DOUBLE))))::BIGINT AS measure FROM d),
         s0 AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
         s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS most FROM s0),
         s2 AS (SELECT *, most / weight AS room, (sum(source_size) OVER ())::DOUBLE AS all_words, sum(weight) OVER () AS all_weights FROM s1),
         s3 AS (SELECT *, (all_words - coalesce(sum(most) OVER w, 0)) / (all_weights - coalesce(sum(weight) OVER w, 0)) AS level FROM s2
                WINDOW w AS (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         s4 AS (SELECT *, max(CASE WHEN level <= room THEN level END) OVER () AS final FROM s3),
         s5 AS (SELECT skey, source_size, CASE WHEN level > room THEN most ELSE least(most, final * weight) END AS target FROM s4),
         s6 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS certain FROM s5),
         s7 AS (SELECT *, greatest(target - certain * source_size::DOUBLE, 0) AS missing FROM s6),
         l0 AS (SELECT skey, measure, sum(size)::BIGINT AS words FROM r GROUP BY ALL HAVING sum(size) > 0),
         l1 AS (SELECT skey, measure, missing - coalesce(sum(words) OVER (PARTITION BY skey ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
                       (sum(measure * words) OVER (PARTITION BY skey ORDER BY measure ROWS UNBOUNDED PRECEDING))::DOUBLE AS weighed FROM l0 JOIN s7 USING (skey)),
         l2 AS (SELECT *, remaining / weighed AS factor FROM l1),
         f AS (SELECT skey, max(measure) AS top, arg_max(factor, measure) AS factor, arg_max(remaining, measure) AS remaining FROM l2 WHERE factor * measure < 1 GROUP BY skey),
         p AS (SELECT r.*, source_size, target, certain, top, factor, remaining, factor * measure AS p FROM r JOIN s7 USING (skey) LEFT JOIN f USING (skey)),
         q AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND measure <= top AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
         c AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY q) AS upto FROM q WHERE q IS NOT NULL),
         k AS (SELECT skey, max(q) FILTER (upto <= remaining) AS last_q, any_value(remaining) - coalesce(max(upto) FILTER (upto <= remaining), 0)::DOUBLE AS open FROM c GROUP BY skey),
         e AS (SELECT skey, arg_min(q, [abs(size - open), q]) AS closing FROM c JOIN k USING (skey) WHERE (last_q IS NULL OR q > last_q) AND abs(size - open) < open GROUP BY skey),
         o AS (SELECT *, CASE WHEN size > 0 THEN certain + coalesce((measure > top OR q <= last_q OR q = closing) AND factor > 0, false)::BIGINT ELSE 0 END AS copies
               FROM q LEFT JOIN k USING (skey) LEFT JOIN e USING (skey))
    SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM o"""


def op1_pareto_mix(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
