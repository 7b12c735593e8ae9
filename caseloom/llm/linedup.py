"""Line-level deduplication by pairwise alignment.

A run is a stretch of lines of enough words that has too few without its first or its last line; as a whole it is at most as frequent as its
rarest line, so runs are the rare keys by which overlapping documents are found. Each run that several
documents hold links every later document to the first one that holds it; so there are never more pairs than shared runs.
Every line of a common block of enough words lies in a run within the block, so no block is missed, whichever documents hold
its lines one by one. Each pair is aligned by patience diff, anchored at the lines that are rarest: those that
either document holds once. Common blocks of enough words, as the alignment pairs them, are deleted from the later document
(the one with the larger doc_id). Alignment works on line hashes alone; texts are read once more to delete.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, may_be_among, only, lean, small, staged
from caseloom.llm.neardup import _STEP, _mix, confirmed, likely_copies

#: A common block is deleted if it has so many words.
LEAST_WORDS = 10
#: Later documents that are aligned with one earlier document by one task, about.
ALIGN_ROWS = 512


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), given in order of i, in which j rises too."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k:k + 1], at[k:k + 1] = [j], [n]
        before[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal lines. None marks lines that match nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] is not None and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] is not None and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a: dict = {}
        in_b: dict = {}
        for i in range(a0, a1):
            in_a.setdefault(a[i], []).append(i)
        for j in range(b0, b1):
            in_b.setdefault(b[j], []).append(j)
        common = [(v, in_b[x]) for x, v in in_a.items() if x is not None and x in in_b]
        single = [(v[0], w[0]) for v, w in common if len(v) == len(w) == 1]
        anchors = longest_rising(sorted(single or [(v[0], w[0]) for v, w in common]))
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        if anchors:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def block_places(later: list, words: list[int], first: list, least: int) -> list[tuple[int, int]]:
    """Lines of later that lie in a common block of at least so many words, each with the line of first that it repeats.

    The alignment decides: its blocks go as it pairs them, then what is left is aligned again, which finds blocks that moved. Blocks pass over blank lines (None), which are no part of
    them. An aligned block that is too small may be bound to the wrong one of several equal lines, or be cut off from a larger one; only where that
    happened, the runs of later are looked up in first too, and lines which the alignment left are added, with the first place where their run stands.
    """
    at, there = ([i for i, x in enumerate(lines) if x is not None] for lines in (later, first))
    sizes = [words[i] for i in at]
    a, b = [later[i] for i in at], [first[j] for j in there]
    left, place, small = list(a), {}, False
    while pairs := patience(left, b):
        block, found = [], False
        for n, (i, j) in enumerate(pairs):
            block.append((i, j))
            if n + 1 == len(pairs) or pairs[n + 1] != (i + 1, j + 1):
                if sum(sizes[k] for k, _ in block) >= least:
                    found = True
                    place |= dict(block)
                    for k, _ in block:
                        left[k] = None
                else:
                    small = True
                block = []
        if not found:
            break
    if small:
        place = _in_common_runs(a, sizes, b, least) | place
    return sorted((at[k], there[j]) for k, j in place.items())


def common_blocks(later: list, words: list[int], first: list, least: int) -> list[int]:
    """Lines of later that lie in a common block of at least so many words."""
    return [i for i, _ in block_places(later, words, first, least)]


def _in_common_runs(a: list, words: list[int], b: list, least: int) -> dict[int, int]:
    """Lines of a that lie in a run of at least so many words which b has too, with the first place of the first such run."""
    starts, ends = runs(np.array(words), np.array([0, len(words)]), least)
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    held: dict = {}
    for n in {e - s for s, e in spans}:
        for j in range(len(b) - n, -1, -1):
            held[tuple(b[j : j + n])] = j
    out: dict[int, int] = {}
    for s, e in spans:
        j = held.get(tuple(a[s:e]))
        if j is not None:
            for k in range(s, e):
                out.setdefault(k, j + k - s)
    return out


def runs(words: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of at least so many words, shortest from either side. Lines have words; borders are those of documents."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n, least = np.arange(len(words)), max(least, 1)
    of = np.searchsorted(borders, n, "right")
    ends = np.searchsorted(sums, sums[:-1] + least, "left")
    starts = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead, back = ends <= borders[of], starts >= borders[of - 1]
    both = np.unique(np.stack([np.concatenate([n[ahead], starts[back]]), np.concatenate([ends[ahead], n[back] + 1])]), axis=1)
    return both[0], both[1]


def _run_keys(least: int):
    def run(batches):
        for batch in batches:
            lines, words = batch.column("hashes"), batch.column("words").flatten().to_numpy()
            sizes = lines.value_lengths().to_numpy()
            borders = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            hashes = lines.flatten().to_numpy().view(np.uint64)
            starts, ends = runs(words, borders, least)
            keys = (ends - starts).astype(np.uint64)
            for k in range(int((ends - starts).max(initial=0))):
                more = np.flatnonzero(starts + k < ends)
                keys[more] = _mix(keys[more] * _STEP + hashes[starts[more] + k])
            ids = batch.column("doc_id").to_numpy()[np.searchsorted(borders, starts, "right") - 1]
            out = pa.table({"doc_id": ids, "run": keys.view(np.int64)}).group_by(["doc_id", "run"]).aggregate([])
            yield from out.select(["doc_id", "run"]).to_batches()

    return lean(run)


def _align(least: int):
    keys = lambda lines: [None if x["h"] is None else (x["h"], x["c"]) for x in lines]

    def run(batches):
        """Rows in order of (first_id, part): the lines of the first document, then those of later ones -> doc_id, row, at (a line to delete), first_id, first_at (the line that it repeats)."""
        key, firsts = None, []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["first_id"], r["part"]) != key:
                    key, firsts = (r["first_id"], r["part"]), []
                lines = keys(r["lines"])
                if r["doc_id"] is None:
                    firsts.append(lines)
                else:
                    gone: dict = {}
                    for first in firsts:
                        gone = dict(block_places(lines, r["words"], first, least)) | gone
                    out += [(r["doc_id"], r["row"], i, r["first_id"], j) for i, j in sorted(gone.items())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["doc_id", "row", "at", "first_id", "first_at"])

    return lean(run)


def _rows_and_pairs(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The lines of all documents as hashes with their words, and the pairs (doc_id, first_id) to align: a document with the first that holds one of its runs."""
    lines = F.split(F.col(text_col), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.trim(x))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("c"))
    rows = staged(
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.xxhash64(text_col).alias("row"),
            F.transform(trimmed, lambda x: F.when(x.rlike(WORD), F.struct(F.xxhash64(x).alias("h"), F.crc32(x.cast("binary")).alias("c"))).otherwise(none)).alias("lines"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
        ),
        "lines",
    )
    solid = F.filter(F.arrays_zip("lines", "words"), lambda x: x["lines"]["h"].isNotNull())
    held = rows.select("doc_id", F.transform(solid, lambda x: x["lines"]["h"]).alias("hashes"), F.transform(solid, lambda x: x["words"]).alias("words"))
    held = staged(held.mapInArrow(_run_keys(least_words), "doc_id long, run long"), "lines-runs")
    shared = held.groupBy("run").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    shared = small(staged(shared, "lines-shared"))
    pairs = staged(held.join(shared, "run").where("doc_id > first_id").select("doc_id", "first_id").distinct(), "lines-pairs")
    return rows, pairs


def _aligned(rows: DataFrame, pairs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, row, at, first_id, first_at. The pairs of one first document are dealt into parts; each has its lines once, and later documents stream past."""
    wanted = staged(pairs.select(F.explode(F.array("doc_id", "first_id")).alias("doc_id")).distinct(), "lines-wanted")
    texts = only(rows, wanted, "doc_id").repartition("doc_id").dropDuplicates(["doc_id", "row"])
    parts = pairs.groupBy("first_id").agg(F.ceil(F.count(F.lit(1)) / ALIGN_ROWS).alias("parts")).where("parts > 1")
    dealt = pairs.join(small(staged(parts, "lines-parts")), "first_id", "left").select("doc_id", "first_id", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    no = F.lit(None).cast("bigint")
    heads = dealt.select("first_id", "part").distinct().join(texts.withColumnRenamed("doc_id", "first_id"), "first_id").select("first_id", "part", no.alias("doc_id"), "row", "lines", "words")
    later = dealt.join(texts, "doc_id").select("first_id", "part", "doc_id", "row", "lines", "words")
    both = heads.unionAll(later).repartition("first_id", "part").sortWithinPartitions("first_id", "part", F.col("doc_id").asc_nulls_first())
    return both.mapInArrow(_align(least_words), "doc_id long, row long, at int, first_id long, first_at int")


def repeated_blocks(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), at, first_id, first_at: each line of a block that a document has in common with an earlier one, and the line there with which the alignment pairs it.

    Lines are counted from 0. A line is paired once with each earlier document that it is aligned with. Null ids and texts take no part; an empty table gives an empty result.
    """
    rows, pairs = _rows_and_pairs(docs, least_words, id_col, text_col)
    return _aligned(rows, pairs, least_words)


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, spare: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, row (a hash of the text) and gone, the positions of lines to delete, for the rows that have any.

    With spare, pairs whose texts are this similar as wholes, by their full sets of five-word shingles, are not aligned: they are left to
    deduplication of documents, which could no longer see what they were after some of their lines had gone. What counts is what the
    blocks of all other pairs leave of their texts; pairs that are less similar then are aligned as well. Null ids and texts take no part; an empty table gives an empty result.
    """
    rows, pairs = _rows_and_pairs(docs, least_words, id_col, text_col)
    aligned = lambda pairs: _aligned(rows, pairs, least_words).select("doc_id", "row", "at")

    def of_row(gone: DataFrame) -> DataFrame:
        return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))

    if spare is None:
        return of_row(aligned(pairs))
    percent = round(spare * 100)
    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    as_pairs = lambda p: p.select(F.col("b").alias("doc_id"), F.col("a").alias("first_id"))
    # Pairs that may be copies wait until all others are aligned; their texts are compared as those have left them.
    unknown = staged(likely_copies(pairs.select(F.col("doc_id").alias("b"), F.col("first_id").alias("a")), whole, 5, percent), "lines-alike")
    gone = staged(aligned(staged(pairs.join(as_pairs(unknown), ["doc_id", "first_id"], "left_anti"), "lines-apart")), "lines-cut")
    spared = None
    while True:
        wanted = staged(unknown.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "lines-compared")
        cut = _deleted(only(whole, wanted, "doc_id"), of_row(gone), "doc_id", "text")
        good = staged(confirmed(unknown, cut, 5, percent, among=True), "lines-spared")
        lost = staged(unknown.join(good, ["a", "b"], "left_anti"), "lines-lost")
        if lost.isEmpty():
            return of_row(gone)
        new = staged(aligned(as_pairs(lost)).join(gone, ["doc_id", "row", "at"], "left_anti"), "lines-cut")
        gone = staged(gone.unionAll(new), "lines-cut")
        spared = good if spared is None else staged(spared.unionAll(good), "lines-spared")
        # Spared pairs of documents that have lost more lines are compared again.
        ids = small(staged(new.select("doc_id").distinct(), "lines-changed"))
        unknown = staged(spared.join(ids.withColumnRenamed("doc_id", "a"), "a", "left_semi").unionAll(spared.join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")).distinct(), "lines-touched")
        if unknown.isEmpty():
            return of_row(gone)
        spared = staged(spared.join(unknown, ["a", "b"], "left_anti"), "lines-spared")


def _masks(batches):
    """The lines to delete as a list of booleans, so that a line is looked up at once."""
    for batch in batches:
        masks = []
        for gone in batch.column("gone").to_pylist():
            mask = np.zeros(gone[-1] + 1, bool)
            mask[gone] = True
            masks.append(mask)
        ends = np.cumsum([0, *map(len, masks)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(masks) if masks else np.zeros(0, bool)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), lists], ["__gone_id", "__gone_row", "__gone"])


def _deleted(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without those lines; column __gone says which they were."""
    masks = gone.mapInArrow(_masks, "`__gone_id` long, `__gone_row` long, `__gone` array<boolean>")
    out = df.join(masks, (F.col(id_col).cast("bigint") == F.col("__gone_id")) & (F.xxhash64(text_col) == F.col("__gone_row")), "left").drop("__gone_id", "__gone_row")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.coalesce(F.try_element_at("__gone", i + 1), F.lit(False)))
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))


def delete_repeated(docs: DataFrame, least_words: int = LEAST_WORDS, spare: float | None = None, counts: tuple[str, str] = ("n_lines", "n_deleted"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns, and common blocks deleted from the text of the later document of each pair.

    Two more columns, named by counts: its lines, and those deleted. Blank lines (without words) match nothing and stay; blocks pass over them. Null texts stay null, with no
    lines; rows without doc_id stay as they are. Rows that repeat a doc_id are aligned each with documents of smaller doc_id, not with each other. An empty table gives an
    empty result. Columns of docs that have the names of those two are replaced; names that begin with __gone are this function's own.
    """
    gone = staged(repeated_lines(docs, least_words, spare, id_col, text_col), "lines-gone")
    docs = docs.drop(*counts)
    # Only texts that may lose lines are joined; the others pass as they are.
    ids = gone.select(F.col("doc_id").alias(id_col))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    lines = count(F.split(F.col(text_col), "\n", -1))
    same = may_be_among(docs, ids, id_col, other=True).withColumns({counts[0]: lines, counts[1]: F.lit(0)})
    cut = _deleted(may_be_among(docs, ids, id_col).withColumn(counts[0], lines), gone, id_col, text_col)
    return same.unionByName(cut.withColumn(counts[1], count(F.filter("__gone", lambda x: x))).drop("__gone"))


def op8_patience_lines(spark, sf_dir):
    out = delete_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
