"""Packing documents into as few token sequences as possible, by bin completion.

Texts become pieces of at most ``capacity`` tokens; a full piece is a sequence of its own. The others are dealt at
random into blocks of bounded size (a block costs at most one sequence), and each block is packed by branch and
bound. The incumbent is the best-fit-decreasing packing. Then, sequence by sequence, fillings around the largest piece left are
enumerated, least waste first; a filling is left out if it is dominated (one or several of its pieces could be exchanged for one larger
piece that is left and still fits), and a branch is dropped once its waste exceeds what a packing better than the incumbent may
waste. The search ends when no branch is left, when the incumbent has as few sequences as the tokens need, or
after ``budget`` steps: that bounds the time, never the pieces, and None searches to the end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import lean, staged, text_slices
from caseloom.llm.tokens import WORD_TOKENIZER, encoder

CAPACITY = 4096
END_ID = 1
BLOCK = 10_000
#: Steps of the search for a block whose best-fit packing is above the least number of sequences (a second or two).
BUDGET = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def _pieces(tokenizer: str, end: int, capacity: int, with_ids: bool):
    def pieces(batches):
        """Words are remembered within a task; a worker that waits holds no tokenizer."""
        coder, last, step, place = encoder(tokenizer), np.array([end], "<u4").tobytes(), 4 * capacity, TaskContext.get().partitionId() << 36
        for batch in text_slices(batches, "text", 1_000_000):
            out: list[tuple] = []
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
                raw = coded + last
                for i, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), place, *([part] if with_ids else ())))
                    place += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place", "ids"]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])

    return lean(pieces)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest sequence that still has room."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for n in lengths:
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([n])
            left, k = capacity - n, len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(n)
            left -= n
        if left:
            insort(room, (left, k))
    return bins


def reachable(sizes: list[int], count: dict[int, int], room: int) -> list[int]:
    """For each number of the smallest sizes: the sums up to room that their pieces can have, as bits."""
    within, out = (1 << room + 1) - 1, [1]
    for n in sizes:
        sums, copies, k = out[-1], count[n], 1
        while copies and n <= room and sums != within:
            k = min(k, copies)
            sums |= sums << k * n & within
            copies, k = copies - k, 2 * k
        out.append(sums)
    return out


def dominated(filling: tuple[int, ...], left: int, others: int) -> bool:
    """Whether a piece of others (bits of sizes) still fits, or could take the place of one or several smaller ones of the filling, which go elsewhere then.

    left: the room that the filling leaves.
    """
    single = several = 0
    for n in filling:
        several |= (single | several) << n
        single |= 1 << n
    # A piece alone, or none, must be exchanged for a larger one; several, for one at least as large as they are together.
    reach, width = (single | several | 1) << 1 if left else 0, 1
    while width < left:
        step = min(width, left - width)
        reach |= reach << step
        width += step
    return bool((reach | several) & others)


def _unrolled(taken: tuple) -> tuple[int, ...]:
    """The pieces of (size, copies, those before), largest first."""
    parts: list[tuple[int, int]] = []
    while taken:
        n, k, taken = taken
        parts.append((n, k))
    return tuple(n for n, k in reversed(parts) for _ in range(k))


def fillings(sizes: list[int], count: dict[int, int], room: int, most, spend) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All undominated fillings of room, least waste first, as (waste, pieces). most() is the waste allowed by now; spend(n) counts steps.

    A depth-first search over the sums that can still be reached, so no branch of it ends in vain; pieces of one size are taken together.
    sizes and count may change while a filling is in use, if they are as before when the next one is asked for. The tables of sums are built
    anew then: a search that waits holds none, so a block of thousands of sequences has one search's tables at a time.
    """

    def tables() -> tuple[list[int], int]:
        spend(len(sizes) // 8)
        return reachable(sizes, count, room), sum(1 << n for n in sizes if n <= room)

    (sums, fitting), waste = tables(), 0
    while waste <= min(most(), room):
        if sums[-1] >> room - waste & 1:
            # (sizes that may still be used, sum still to fill, pieces so far)
            todo = [(len(sizes), room - waste, ())]
            while todo:
                top, want, taken = todo.pop()
                spend(1)
                if not want:
                    pieces = _unrolled(taken)
                    used = Counter(pieces)
                    if not dominated(pieces, waste, fitting - sum(1 << n for n, k in used.items() if k == count[n])):
                        sums = used = None
                        yield waste, pieces
                        if waste > most():
                            return
                        sums, fitting = tables()
                    continue
                top = bisect_right(sizes, want, 0, top)
                if not top or not sums[top] >> want & 1:
                    continue
                n = sizes[top - 1]
                # Fewest pieces of the largest size first onto the stack, so that most of them are tried first.
                for k in range(min(count[n], want // n) + 1):
                    if sums[top - 1] >> want - k * n & 1:
                        todo.append((top - 1, want - k * n, (n, k, taken) if k else taken))
        waste += 1


class _Spent(Exception):
    """The budget of the search is used up."""


def complete_bins(lengths: list[int], capacity: int, budget: int | None = BUDGET) -> list[list[int]]:
    """Sequences, as lists of lengths, holding all lengths: as few as possible, if the search ends within the budget; never more than best fit takes."""
    lengths = sorted(lengths, reverse=True)
    incumbent = best_fit(lengths, capacity)
    total, spent = sum(lengths), 0
    least = -(-total // capacity)
    if len(incumbent) <= least:
        return incumbent
    count: dict[int, int] = {}
    for n in lengths:
        count[n] = count.get(n, 0) + 1
    sizes = sorted(count)

    def take(n: int) -> None:
        count[n] -= 1
        if not count[n]:
            sizes.pop(bisect_left(sizes, n))

    def give(n: int) -> None:
        if not count[n]:
            insort(sizes, n)
        count[n] += 1

    def spend(n: int) -> None:
        nonlocal spent
        spent += n
        if budget is not None and spent > budget:
            raise _Spent

    wasted, may_waste = 0, (len(incumbent) - 1) * capacity - total
    # The largest piece of each sequence, its other pieces and their waste, and the search for further ones.
    tops: list[int] = []
    bins: list[tuple[int, tuple[int, ...]]] = []
    options: list[Iterator[tuple[int, tuple[int, ...]]]] = []

    def around_largest() -> None:
        tops.append(sizes[-1])
        take(sizes[-1])
        options.append(fillings(sizes, count, capacity - tops[-1], lambda: may_waste - wasted, spend))

    def undo() -> None:
        nonlocal wasted
        w, pieces = bins.pop()
        wasted -= w
        for n in pieces:
            give(n)

    try:
        around_largest()
        while options:
            option = next(options[-1], None)
            if option is None or wasted + option[0] > may_waste:
                # No filling of this sequence is left that may lead to fewer: undo the one before.
                options.pop()
                give(tops.pop())
                if bins:
                    undo()
                continue
            bins.append(option)
            wasted += option[0]
            for n in option[1]:
                take(n)
            if sizes:
                around_largest()
                continue
            incumbent = [[top, *pieces] for top, (_, pieces) in zip(tops, bins, strict=True)]
            if len(incumbent) <= least:
                return incumbent
            may_waste = (len(incumbent) - 1) * capacity - total
            undo()
    except _Spent:
        pass
    return incumbent


def _pack(capacity: int, budget: int | None):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        at: dict[int, list[int]] = {}
        for i in order.tolist():
            at.setdefault(int(lengths[i]), []).append(i)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(complete_bins(lengths.tolist(), capacity, budget)):
            place = 0
            for n in b:
                i = at[n].pop()
                sequence[i], offset[i] = k, place
                place += n
        block = table.column("block").to_numpy()
        return table.drop_columns(["block"]).append_column("sequence_id", pa.array(block.astype(np.int64) << 32 | sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_TOKENIZER, end: int = END_ID, with_ids: bool = False, budget: int | None = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as unsigned 32-bit bytes).

    Null and empty texts hold the end id alone. Only texts longer than a sequence are cut. Repeated rows are packed
    once each; a null doc_id stays null. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")
    pieces = staged(docs.mapInArrow(_pieces(tokenizer, end, capacity, with_ids), schema), "pack-pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("place")).withColumn("offset", F.lit(0).cast("bigint"))
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // BLOCK))
    dealt = rest.select("place", "length", F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"), *(c for c in pieces.columns if c not in ("place", "length")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "block") + ", sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInArrow(_pack(capacity, budget), schema)
    return full.select(packed.columns).unionAll(packed).drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, of a packing with ids: sequence_id, n_tokens, ids (unsigned 32-bit bytes) with the pieces in place. An empty packing has none."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def waste(packed: DataFrame) -> DataFrame:
    """Sequences, tokens and the fewest sequences that could hold them, in one row; zeros for an empty packing."""
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    return used.withColumn("least", F.ceil(F.col("tokens") / CAPACITY))


def op2_bin_completion(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
