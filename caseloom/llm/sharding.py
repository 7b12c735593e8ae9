"""Shards of near equal bytes by histogram sort.

Documents are ordered by the hash of their text (equal texts stand together), then by the hash of
their doc_id. Boundaries between shards are found by counting: exact bytes are summed below probes that divide the key
space evenly, the interval holding each wanted boundary is divided again, and so on until all boundaries are
within tolerance. Only then are the rows exchanged, once, into ranges of the key; places in a shard follow from the order within each range.

What reaches the driver is a histogram of at most ``(shards - 1) * 2**STEP`` sums a round, at any size of input, and at last
at most FEW keys for each boundary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import small, staged

SHARDS = 16
#: Bits of the key (60 of each hash) that a round of probes refines.
STEP = 10
#: Digits of the hash of the text, and of the whole key.
TEXT_DIGITS, DIGITS = 6, 12
#: A boundary may be off by this share of a shard.
TOLERANCE = 0.001
#: ... and by this share, if it then doesn't divide a group of equal texts.
GROUP_TOLERANCE = 0.01
#: An interval with so few rows is settled by its rows themselves.
FEW = 1000
#: Rows that one task orders, about.
RUN_ROWS = 20_000


def _digit(level: int) -> Column:
    """STEP bits of the key, from the top: first those of the text's hash, then those of the document's."""
    part, at = ("h", level) if level < TEXT_DIGITS else ("d", level - TEXT_DIGITS)
    return F.shiftright(F.col(part), STEP * (TEXT_DIGITS - 1 - at)).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")


def _number(digits: tuple[int, ...]) -> int:
    """Leading digits as a hash with zeros behind them."""
    return sum(v << STEP * (TEXT_DIGITS - 1 - i) for i, v in enumerate(digits))


def _inside(prefix: tuple[int, ...]) -> Column:
    if len(prefix) <= TEXT_DIGITS:
        return F.col("h").between(_number(prefix), _number(prefix) + (1 << STEP * (TEXT_DIGITS - len(prefix))) - 1)
    low, rest = _number(prefix[TEXT_DIGITS:]), DIGITS - len(prefix)
    return (F.col("h") == _number(prefix[:TEXT_DIGITS])) & F.col("d").between(low, low + (1 << STEP * rest) - 1)


def _beyond(cut: tuple[int, ...]) -> Column:
    """Whether the row is at or after the boundary."""
    h, d = _number(cut[:TEXT_DIGITS]), _number(cut[TEXT_DIGITS:])
    return (F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d))


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> list[tuple[int, ...]]:
    """keys (h, d, size) -> the boundaries: prefixes of digits; a row is beyond a boundary if its digits are not below it."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    goals = [share * i for i in range(1, shards)]
    found: dict[int, tuple[int, ...]] = {}
    open_: dict[tuple[int, ...], tuple[int, int, list[int]]] = {(): (0, 1 << 62, list(range(shards - 1)))}  # interval: bytes below it, its rows, its boundaries

    def held(level: int, prefixes, upto: int) -> dict[tuple[int, ...], list[tuple]]:
        """Of the rows in these intervals of one level: bytes and rows by the digits up to another level, in order."""
        inside = reduce(lambda a, b: a | b, map(_inside, prefixes))
        digits = [_digit(i).alias(f"k{i}") for i in range(upto)]
        out: dict[tuple[int, ...], list[tuple]] = {p: [] for p in prefixes}
        for r in sorted(map(tuple, keys.where(inside).groupBy(*digits).agg(F.sum("size"), F.count(F.lit(1))).collect())):
            out[r[:level]].append(r)
        return out

    for level in range(DIGITS):
        if not open_ or not total:
            break
        few = all(rows <= FEW for _, rows, _ in open_.values())
        upto = DIGITS if few else level + 1
        following: dict[tuple[int, ...], tuple[int, int, list[int]]] = {}
        for prefix, counted in held(level, open_, upto).items():
            below, _, here = open_[prefix]
            # Boundaries before each probe: bytes below it, its digits, and whether the text before it is another one.
            at, edges = below, []
            for *key, size, rows in counted:
                edges.append((at, tuple(key), rows, not edges or edges[-1][1][:TEXT_DIGITS] != tuple(key)[:TEXT_DIGITS]))
                at += size
            edges.append((at, (*edges[-1][1][:-1], edges[-1][1][-1] + 1), 0, True))
            for g in here:
                best = min(edges, key=lambda e: abs(e[0] - goals[g]))
                whole = min((e for e in edges if e[3]), key=lambda e: abs(e[0] - goals[g]))
                if abs(whole[0] - goals[g]) <= group_tolerance * share:
                    best = whole if upto >= TEXT_DIGITS or abs(whole[0] - goals[g]) <= tolerance * share else best
                if upto == DIGITS or abs(best[0] - goals[g]) <= (group_tolerance if upto >= TEXT_DIGITS and best[3] else tolerance) * share:
                    found[g] = best[1]
                else:
                    i = max(i for i, e in enumerate(edges[:-1]) if e[0] <= goals[g])
                    following.setdefault(edges[i][1], (edges[i][0], edges[i][2], []))[2].append(g)
        open_ = following
    return [found[g] for g in sorted(found)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    The law is ``bytes``: sizes (UTF-8 bytes plus one; null text: one) near equal. Equal texts stand together, so a group is divided only
    where a boundary would else miss its tolerance; a group larger than a shard is divided by doc_id. Rows that repeat doc_id and text
    stay together, always. Slots are in order of the key. grown_shard is null under this law. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 4).alias("h"),
            F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(id_col)), 4).alias("d"),
        ),
        "shard-keys",
    )
    cuts = splitters(keys, shards, tolerance)
    number = reduce(lambda a, b: a + b, [_beyond(c).cast("int") for c in cuts], F.lit(0))
    order = ["h", "d", "doc_id", "text_crc32"]
    ranged = keys.withColumn("shard", number).repartitionByRange(max(1, -(-keys.count() // RUN_ROWS)), *order).sortWithinPartitions(*order)
    rows = staged(ranged.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    # Ranges follow each other in key order, so a row's place is what earlier ranges hold of its shard, and its place in its own.
    parts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "range", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    return rows.join(small(staged(parts, "shard-ranges")), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("base") + F.col("at") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_histogram_sort(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
