"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each half has a codebook of its own, and a pair of codewords is a cell. By Cauchy-Schwarz no vector of a cell can score
more with an anchor than the sum, over the halves, of anchor times codeword plus the anchor's length times the radius of the codeword's members.
A heap visits the cells in descending order of that sum (the multi-sequence algorithm: of two sorted lists of half bounds, the pairs in order of their
sums), and a search ends when the bound of the next cell falls below what it still needs. So results are exact, whatever the codebooks.

Rows are dealt into slices by cell, large cells into several; an anchor first searches the slice with its best bound, which tells what it needs,
and then only slices with a bound that reaches it. Codebooks come from a bounded sample; radii are those of all rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import small, staged

#: Rows on which codebooks are fitted at most; codewords of a half at most, and vectors for each cell; rounds of k-means.
SAMPLE, WORDS, CELL_ROWS, ROUNDS = 12_000, 128, 128, 8
#: Rows of a slice (more where that made over SLICES of them); anchors that search a slice in one task.
SLICE_ROWS, SLICES, BLOCK = 50_000, 4_096, 5_000
LONG = (1 << 63) - 1


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or any component is null or not finite."""
    v = F.transform(vec, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(column, dims: int) -> np.ndarray:
    return pa.concat_arrays(column.chunks if isinstance(column, pa.ChunkedArray) else [column]).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fit(table: pd.DataFrame, words: int) -> pd.DataFrame:
    """Codebooks of both halves, by k-means on the sample."""
    x = np.stack(table["q"].to_numpy()).astype(np.float64)[:SAMPLE]
    rng, out = np.random.default_rng(11), []
    for half in np.split(x, [(x.shape[1] + 1) // 2], axis=1):
        centres = half[rng.permutation(len(half))[: min(words, len(half))]].copy()
        for _ in range(ROUNDS):
            near = np.argmin((centres * centres).sum(1) - 2 * half @ centres.T, axis=1)
            order = np.argsort(near, kind="stable")
            filled, at = np.unique(near[order], return_index=True)
            if half.shape[1]:
                centres[filled] = np.add.reduceat(half[order], at, axis=0) / np.diff(at, append=len(near))[:, None]
        out.append(centres)
    return pd.DataFrame({"first": [out[0].astype("<f8").tobytes()], "second": [out[1].astype("<f8").tobytes()], "words": [len(out[0])]})


class Books:
    """Codebooks of the two halves: words x dimensions each."""

    def __init__(self, dims: int = 0, first: bytes = b"", second: bytes = b"", words: int = 0):
        self.dims, self.cut = dims, (dims + 1) // 2
        self.halves = [np.frombuffer(first, "<f8").reshape(words, self.cut), np.frombuffer(second, "<f8").reshape(words, dims - self.cut)]

    def cut_in_two(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, [self.cut], axis=-1)


def _cells(books):
    """Rows with their cell and their squared distances from its codewords."""

    def run(batches):
        b = books.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("q"), b.dims).astype(np.float64)
                out = []
                for half, words in zip(b.cut_in_two(x), b.halves, strict=True):
                    near = np.argmin((words * words).sum(1) - 2 * half @ words.T, axis=1)
                    out += [pa.array(near.astype(np.int32)), pa.array(np.sqrt(((half - words[near]) ** 2).sum(1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "i", "r1", "j", "r2"])

    return run


def _bounds(books: Books, q: np.ndarray, i: np.ndarray, r1: np.ndarray, j: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Upper bounds of what the rows of each cell (i, j, radii) score with an anchor."""
    a, b = books.cut_in_two(q)
    return _half(books, 0, a)[i] + np.linalg.norm(a) * r1 + _half(books, 1, b)[j] + np.linalg.norm(b) * r2 + _slack(q)


def _half(books: Books, side: int, part: np.ndarray) -> np.ndarray:
    return books.halves[side] @ part


def _slack(q: np.ndarray) -> float:
    """More than rounding can take from a bound."""
    return 1.0 + 1e-6 * float(np.abs(q).sum())


def _need(scores: list[int] | None, known: list[dict] | None, k: int, low: int, high: int) -> float:
    """The least score that can still change what an anchor has found; infinite if nothing can."""
    least = {x["place"]: x["least"] for x in known or [] if x["held"] >= k}
    if scores is None:
        return least.get(0, -np.inf)
    windows = {place: window(p, low, high) for place, p in enumerate(scores)}
    return min((max(lo, least.get(place, lo)) for place, (lo, hi) in windows.items() if lo <= hi), default=np.inf)


def _ask(books, cells, home: bool, k: int, low: int, high: int):
    """Anchors with the slices that they search: the one with the best bound, or all others with a bound that reaches what they need."""

    def run(batches):
        of, i, r1, j, r2 = cells.value
        order = np.argsort(of, kind="stable")
        of, i, r1, j, r2 = of[order], i[order], r1[order], j[order], r2[order]
        names, starts = np.unique(of, return_index=True)
        for batch in batches:
            lists = []
            for q, scores, known in zip(*(batch.column(c).to_pylist() for c in ("q", "scores", "known")), strict=True):
                most = np.maximum.reduceat(_bounds(books.value, np.array(q, np.float64), i, r1, j, r2), starts)
                reach = most >= _need(scores, known, k, low, high)
                best = int(np.argmax(most))
                lists.append([int(n) for at, n in enumerate(names) if reach[at] and (at == best) == home])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ASKING), pa.array(lists, pa.list_(pa.int32()))], [*ASKING, "slices"])

    return run


class Slice:
    """A slice's rows by cell, and what bounds them: the radii of its own rows."""

    def __init__(self, books: Books, table: pa.Table):
        self.books = books
        i, j, ids, labels = (table.column(c).to_numpy() for c in ("i", "j", "vec_id", "label"))
        x = _matrix(table.column("q"), books.dims)
        # Equal rows with equal ids count once.
        order = np.lexsort([*x.T[::-1], labels, ids, j, i])
        x, i, j, ids, labels = x[order], i[order], j[order], ids[order], labels[order]
        new = np.ones(len(ids), bool)
        new[1:] = (x[1:] != x[:-1]).any(1) | (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1])
        self.x, self.ids, self.labels, i, j = x[new], ids[new], labels[new], i[new], j[new]
        self.most = int(np.abs(self.x).max(initial=0))
        self.exact = self.x.astype(np.float64)
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        ends = np.r_[starts[1:], len(i)]
        self.cells = {(int(i[s]), int(j[s])): (int(s), int(e)) for s, e in zip(starts, ends, strict=True)}
        self.words, self.radii = [], []
        for half, codes, words in zip(books.cut_in_two(self.exact), (i, j), books.halves, strict=True):
            used, at = np.unique(codes, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.sqrt(((half - words[codes]) ** 2).sum(1)))
            self.words.append(used)
            self.radii.append(far)

    def scores(self, q: list[int], s: int, e: int):
        """Integer inner products, exact: in doubles where these hold them, else with Python's integers, kept to the range of a long."""
        most = max(map(abs, q), default=0)
        if most * max(1, self.most) * max(1, len(q)) < 1 << 53:
            return (self.exact[s:e] @ np.array(q, np.float64)).astype(np.int64)
        return np.array([max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(row, q, strict=True)))) for row in self.x[s:e].tolist()], np.int64)

    def visit(self, q: list[int]):
        """Cells in descending order of their bounds: (bound, start, end)."""
        v = np.array(q, np.float64)
        lists = []
        for side, part in enumerate(self.books.cut_in_two(v)):
            bound = _half(self.books, side, part)[self.words[side]] + np.linalg.norm(part) * self.radii[side]
            order = np.argsort(-bound, kind="stable")
            lists.append((bound[order].tolist(), self.words[side][order].tolist()))
        (u, first), (w, second) = lists
        slack, heap, seen = _slack(v), [(-(u[0] + w[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            cell = self.cells.get((first[a], second[b]))
            if cell:
                yield -bound + slack, *cell
            for c in ((a + 1, b), (a, b + 1)):
                if c[0] < len(u) and c[1] < len(w) and c not in seen:
                    seen.add(c)
                    heapq.heappush(heap, (-(u[c[0]] + w[c[1]]), *c))


class Best:
    """The k best of what is offered: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int | None:
        """What a score must reach to enter; None while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least()
        if least is not None:
            good = scores >= least
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort([ids, -scores])[: self.k] if scores.min() > -LONG - 1 else np.array(sorted(range(len(ids)), key=lambda r: (-int(scores[r]), ids[r]))[: self.k])
            self.scores, self.ids = scores[order], ids[order]


def positives_in(s: Slice, anchor: int, label: int, q: list[int], k: int) -> Best:
    """The k best rows of the anchor's label among the slice's; the search ends when no cell left can hold one."""
    best = Best(k)
    for bound, a, b in s.visit(q):
        least = best.least()
        if least is not None and bound < least:
            break
        mine = (s.labels[a:b] == label) & (s.ids[a:b] != anchor)
        if mine.any():
            best.offer(s.scores(q, a, b)[mine], s.ids[a:b][mine])
    return best


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest integer between low and high hundredths of a score."""
    return -((-low * score) // 100), (high * score) // 100


def negatives_in(s: Slice, anchor: int, label: int, q: list[int], windows: list[tuple[int, int]], k: int) -> list[Best]:
    """For each window of scores the k best rows of other labels within it; the search ends when all windows are certain."""
    best = [Best(k) for _ in windows]
    wanted = [(w, b) for w, b in zip(windows, best, strict=True) if w[0] <= w[1]]
    for bound, start, end in s.visit(q) if wanted else ():
        need = min(lo if b.least() is None else max(lo, b.least()) for (lo, _), b in wanted)
        if bound < need:
            break
        scores = s.scores(q, start, end)
        other = (s.labels[start:end] != label) & (s.ids[start:end] != anchor) & (scores >= need)
        if other.any():
            scores, ids = scores[other], s.ids[start:end][other]
            for (lo, hi), b in wanted:
                inside = (scores >= lo) & (scores <= hi)
                b.offer(scores[inside], ids[inside])
    return best


ASKING = ("anchor_id", "anchor_key", "label", "q", "scores")
FOUND = "anchor_id long, anchor_key long, place int, vec_id long, score long"


def _search(books, k: int, low: int = 0, high: int = 0):
    """What anchors find in a slice: positives (place 0), or, if they bring positives' scores, negatives for each of these (place: which one)."""

    def run(rows, anchors):
        out = []
        if rows.num_rows and anchors.num_rows:
            s = Slice(books.value, rows)
            for r in anchors.select(["anchor_id", "anchor_key", "label", "q", "scores"]).to_pylist():
                if r["scores"] is None:
                    found = [positives_in(s, r["anchor_id"], r["label"], r["q"], k)]
                else:
                    found = negatives_in(s, r["anchor_id"], r["label"], r["q"], [window(p, low, high) for p in r["scores"]], k)
                out += [(r["anchor_id"], r["anchor_key"], place, i, v) for place, b in enumerate(found) for i, v in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("anchor_id", "anchor_key", "place", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place. An anchor has k rows a slice and place at most."""
    nth = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, label, q: whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row for which anchors holds searches among all others by inner product, higher first, ties by smaller vec_id: its positives are the best of its label, and for each of them
    it gets the best rows of other labels with a score between low and high hundredths of the positive's.

    Rows with a null in vec_id, label or q take no part, nor do those of another dimension than most. Equal rows count once; rows that share a vec_id but
    differ are rows of their own, each an anchor if its id is one, but no row is paired with its own id. Scores beyond a long count as its ends. An empty table, or one label, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "q", anchors.alias("__anchor"))
    sizes = rows.groupBy(F.size("q").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if sizes is None:
        return empty
    n, dims = sizes["n"], sizes["dims"]
    rows = rows.where(F.size("q") == dims)
    words = int(max(1, min(WORDS, round((n / CELL_ROWS) ** 0.5))))
    share = 1.0 if n <= SAMPLE else 0.97 * SAMPLE / n
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "q")
    fitted = some.groupBy(F.lit(0).alias("all")).applyInPandas(lambda t: _fit(t.sort_values("vec_id"), words), "first binary, second binary, words int").first()
    zero = np.zeros(dims).tobytes()
    books = spark.sparkContext.broadcast(Books(dims, *(fitted or (zero[: (dims + 1) // 2 * 8], zero[: dims // 2 * 8], 1))))

    index = staged(rows.mapInArrow(_cells(books), "vec_id long, label long, q array<long>, __anchor boolean, i int, r1 double, j int, r2 double"), "negatives-index")
    # Rows in order of their cells are dealt into slices; a row has a place of its own among those of its cell, so a cell may lie in several.
    cells = index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))  # WORDS ** 2 rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = max(min(slice_rows, -(-n // spark.sparkContext.defaultParallelism)), -(-n // SLICES))
    cells = F.broadcast(cells.select("i", "j", before.alias("before"), F.col("n").alias("held")))
    place = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("held"))
    index = staged(index.join(cells, ["i", "j"]).withColumn("slice", F.floor(place / size).cast("int")).drop("before", "held"), "negatives-slices")
    # At most WORDS ** 2 + SLICES rows: slices follow one another in the order of cells.
    table = index.groupBy("slice", "i", "j").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).select("slice", "i", "r1", "j", "r2").toPandas()
    cells = spark.sparkContext.broadcast([table[c].to_numpy() for c in ("slice", "i", "r1", "j", "r2")])

    key = F.xxhash64("vec_id", "label", "q")
    asking = staged(index.where("__anchor").select(F.col("vec_id").alias("anchor_id"), key.alias("anchor_key"), "label", "q").dropDuplicates(["anchor_id", "anchor_key"]), "negatives-anchors")
    blocks = max(1, -(-asking.count() // block))
    members = index.select("slice", "vec_id", "label", "q", "i", "j")

    def searched(who: DataFrame, home: bool, k: int) -> DataFrame:
        """who (ASKING and known) -> what they find in the slice that they search first, or in all others that they must search."""
        found = who.mapInArrow(_ask(books, cells, home, k, low, high), "anchor_id long, anchor_key long, label long, q array<long>, scores array<long>, slices array<int>")
        found = staged(found.select(*ASKING, F.explode("slices").alias("slice"), F.pmod(F.col("anchor_key"), F.lit(blocks)).alias("block")), "negatives-asked")
        looked = small(staged(found.select("slice", "block").distinct(), "negatives-looked"))
        both = members.join(looked, "slice").groupBy("slice", "block").cogroup(found.groupBy("slice", "block"))
        return staged(both.applyInArrow(_search(books, k, low, high), FOUND), "negatives-found")

    def twice(who: DataFrame, k: int) -> DataFrame:
        """Search at home, then wherever the best found there might be surpassed."""
        at_home = searched(who.withColumn("known", F.lit(None).cast("array<struct<place int, held long, least long>>")), True, k)
        known = _best(at_home, k).groupBy("anchor_id", "anchor_key", "place").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
        known = known.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct("place", "held", "least")).alias("known"))  # a row for each positive
        return _best(at_home.unionByName(searched(who.join(known, ["anchor_id", "anchor_key"], "left"), False, k)), k)

    found = twice(asking.withColumn("scores", F.lit(None).cast("array<long>")), positives)
    of = found.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))  # some rows each
    of = staged(asking.join(of, ["anchor_id", "anchor_key"]).withColumn("scores", F.transform("best", lambda x: x["score"])), "negatives-positives")
    pairs = twice(of.drop("best"), negatives).join(of.select("anchor_id", "anchor_key", "best"), ["anchor_id", "anchor_key"])
    mine = F.get("best", F.col("place"))
    return pairs.select("anchor_id", mine["vec_id"].alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), mine["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op11_multi_index(spark, sf_dir):
    """Hard negatives of each row whose vec_id is divisible by 100, among all embeddings; where vec_id is divisible by 7, the label is one further (modulo 10).

    Rows with a null label, a null vector or any null or non-finite component take no part; an empty table gives an empty result.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("q")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH V AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
S AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM V a JOIN V b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
P AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM S WHERE same) WHERE n <= 5),
N AS (SELECT P.anchor_id, P.vec_id AS positive_id, row_number() OVER (PARTITION BY P.anchor_id, P.vec_id ORDER BY S.score DESC, S.vec_id) AS rank, S.vec_id AS negative_id, P.score AS positive_score, S.score AS negative_score
  FROM P JOIN S ON S.anchor_id = P.anchor_id AND NOT S.same AND 30 * P.score <= 100 * S.score AND 100 * S.score <= 90 * P.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM N WHERE rank <= 10
"""
