"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook; each codebook is fitted on what
the earlier ones leave over, and a vector's codes are found by beam search. With the squared norm of the
approximation stored, its distance to a query differs from ``norm - 2 * sum(query . codeword)`` by a constant, which is read from one
table for each query. The best of that scoring are ranked again by exact distance.

Not all codes are scored for each query: vectors are kept in lists by their nearest coarse centre, and a query looks into as many lists, nearest
first, as on the sample hold COVERED of all true neighbours, and into more until they hold as many vectors as candidates are wanted, so that no answer is short because lists are.
Where vectors have no clusters these are most lists; where they have, few.

Equal vectors are indexed once, with the few smallest ids that any answer can need; so large groups of copies
neither crowd the candidates nor meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import small, staged

#: The codebooks and coarse centres are fitted on so many vectors at most, chosen by the hash of their id.
SAMPLE = 12_000
BOOKS, WORDS, BEAM, ROUNDS = 24, 256, 4, 8
#: Candidates that are ranked again exactly, for each query.
SHORTLIST = 400
SLICE_ROWS, BLOCK_QUERIES = 50_000, 1_000
#: Lists at most; the share of the sample's true neighbours that the lists probed must hold; queries of the sample that measure it.
LISTS, COVERED, TRIALS = 512, 0.99, 500


def usable(vec: Column) -> Column:
    """Not null, not zero, and all components finite."""
    v = F.transform(vec, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _means(x: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres after some rounds of k-means, and the nearest one of each row."""
    for again in range(rounds + 1):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        if again < rounds:
            order = np.argsort(near, kind="stable")
            filled, at = np.unique(near[order], return_index=True)
            centres[filled] = np.add.reduceat(x[order], at, axis=0) / np.diff(at, append=len(near))[:, None]
    return centres, near


def _probed(x: np.ndarray, centres: np.ndarray, near: np.ndarray, k: int = 10) -> int:
    """How many lists, nearest first, hold COVERED of the true neighbours of some rows among all."""
    queries = x[:: max(1, len(x) // TRIALS)]
    far = (x * x).sum(1) - 2 * queries @ x.T
    far[np.arange(len(queries)), np.arange(len(queries)) * max(1, len(x) // TRIALS)] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centres)
    hits = near[np.argpartition(far, k - 1, axis=1)[:, :k]]
    ranks = np.argsort(np.argsort((centres * centres).sum(1) - 2 * queries @ centres.T, axis=1), axis=1)
    return int(np.quantile(ranks[np.arange(len(queries))[:, None], hits], COVERED, method="higher")) + 1


def _fit(table: pd.DataFrame, lists: int) -> pd.DataFrame:
    sizes = table["vec"].map(len)
    dims = int(sizes.mode().min()) if len(table) else 0
    x = np.stack(table["vec"][sizes == dims].to_numpy()).astype(np.float32)[:SAMPLE]
    rng, books, left = np.random.default_rng(7), [], x
    for _ in range(BOOKS):
        words, near = _means(left, left[rng.permutation(len(left))[: min(WORDS, len(left))]].copy(), ROUNDS)
        left = left - words[near]
        books.append(words.astype(np.float64))
    centres, near = _means(x, x[rng.permutation(len(x))[: max(1, min(lists, len(x) // 16))]].copy(), ROUNDS)
    # Lists in order of the direction in which centres differ most, so that lists with near numbers are near.
    off = centres - centres.mean(0)
    order = np.argsort(off @ np.linalg.svd(off, full_matrices=False)[2][0], kind="stable")
    near = np.argsort(order)[near]
    pack = lambda a: [a.astype("<f8").tobytes()]
    return pd.DataFrame({"dims": [dims], "books": pack(np.concatenate(books)), "centres": pack(centres[order]), "probes": [_probed(x, centres[order], near)]})


class Model:
    """Codebooks (BOOKS x words x dimensions), coarse centres (lists x dimensions), and how many lists a query looks into."""

    def __init__(self, dims: int = 0, books: bytes = b"", centres: bytes = b"", probes: int = 0):
        self.dims, self.probes = dims, probes
        self.books = np.frombuffer(books, "<f8").reshape(BOOKS, -1, dims) if dims else np.zeros((BOOKS, 0, 0))
        self.centres = np.frombuffer(centres, "<f8").reshape(-1, dims) if dims else np.zeros((0, 0))

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of each row's n nearest lists, nearest first."""
        return np.argsort((self.centres * self.centres).sum(1) - 2 * x @ self.centres.T, axis=1, kind="stable")[:, :n].astype(np.int32)


def fit_model(vectors: DataFrame) -> Model:
    """vectors (id, vec) -> the model, fitted on SAMPLE of them at most. Dimensions: the most frequent number in the sample."""
    n = vectors.count()
    if not n:
        return Model()
    share = 1.0 if n <= SAMPLE else 0.97 * SAMPLE / n
    lists = min(LISTS, max(1, round(n**0.5 / 2)))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(lambda t: _fit(t.sort_values("id"), lists), "dims int, books binary, centres binary, probes int").first()
    return Model() if got is None else Model(*got)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared norms of the approximations. At each codebook the beam keeps the sums nearest to the vector."""
    n, books = len(x), books.astype(np.float32)
    left, codes = x.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for words in books:
        far = (left * left).sum(2)[:, :, None] + (words * words).sum(1) - 2 * left @ words.T
        width = min(beam, far.shape[1] * far.shape[2])
        flat = far.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
        from_, word = best // far.shape[2], best % far.shape[2]
        row = np.arange(n)[:, None]
        left = left[row, from_] - words[word]
        codes = np.concatenate([codes[row, from_], word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((left * left).sum(2), axis=1)
    row = np.arange(n)
    codes = codes[row, best]
    approx = sum(words[codes[:, m]].astype(np.float64) for m, words in enumerate(books))
    return codes, (approx * approx).sum(1)


def _encode(model):
    def run(batches):
        dims = model.value.dims
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vecs = part.column("vec").to_pylist()
                fits = [i for i, v in enumerate(vecs) if len(v) == dims]
                if fits:
                    x = np.array([vecs[i] for i in fits], np.float64)
                    codes, norms = encode(x, model.value.books)
                    near = model.value.nearest_lists(x, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(fits)), pa.array(near), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["rep", "list", "codes", "norm"])

    return run


def _ask(model, held, least: int):
    """Queries with the lists that they look into: as many as the model says, and on until these hold at least so many vectors. held: vectors by list."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = model.value.nearest_lists(np.array(batch.column("vec").to_pylist(), np.float64), len(held))
                enough = (np.cumsum(np.array(held)[near], axis=1) < least).sum(1) + 1
                lists = [row[: max(model.value.probes, n)].tolist() for row, n in zip(near, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), pa.array(lists, pa.list_(pa.int32())), pa.array(near[:, 0])], ["query_id", "vec", "lists", "home"])

    return run


def _scan(model, shortlist: int):
    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_r, out_s = [], [], []
        if codes.num_rows and queries.num_rows:
            words, n = model.value.books, len(model.value.centres)
            rep, norms, of = (codes.column(c).to_numpy() for c in ("rep", "norm", "list"))
            order = np.lexsort((rep, of))
            rep, norms, of = rep[order], norms[order], of[order]
            code = np.frombuffer(b"".join(codes.column("codes").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
            ends = np.searchsorted(of, np.arange(n + 1))
            for qid, q, lists in zip(*(queries.column(c).to_pylist() for c in ("query_id", "vec", "lists")), strict=True):
                rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in sorted(lists)])
                table = words @ np.array(q, np.float64)
                score, c = norms[rows], code[rows]
                for m in range(len(words)):
                    score -= 2 * table[m][c[:, m]]
                best = np.argsort(score, kind="stable")[:shortlist] if len(score) <= 4 * shortlist else np.argpartition(score, shortlist)[:shortlist]
                out_q += [qid] * len(best)
                out_r.append(rep[rows[best]])
                out_s.append(score[best])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "rep": pa.array(cat(out_r, np.int64), pa.int64()), "approx": pa.array(cat(out_s, np.float64), pa.float64())})

    return run


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shortlist: int = SHORTLIST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Return query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors, but not the row of its own id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
    dimension than most. Ties go to the smaller vec_id. Rows that repeat id and vector count once. Null ids take no part.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = lambda df, name: df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("bigint").alias(name), F.col(vec_col).alias("vec"))
    # The k + 1 smallest ids of equal vectors: enough for any answer.
    few = valid(vectors, "id").withColumn("nth", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = staged(few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "vec"), "ann-vectors")
    asked = staged(valid(queries, "query_id").dropDuplicates(["query_id", "vec"]), "ann-queries")
    model = spark.sparkContext.broadcast(fit_model(classes.select(F.col("rep").alias("id"), "vec")))
    asked = asked.where(F.size("vec") == model.value.dims)
    index = staged(classes.select("rep", "vec").mapInArrow(_encode(model), "rep long, list int, codes binary, norm double"), "ann-codes")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # LISTS rows at most
    held = [sizes.get(i, 0) for i in range(len(model.value.centres))]
    probing = staged(asked.mapInArrow(_ask(model, held, max(shortlist, k + 1)), f"query_id long, vec {asked.schema['vec'].dataType.simpleString()}, lists array<int>, home int"), "ann-probes")
    # Cells of bounded size: queries of neighbouring lists in blocks, by slices of the codes in the lists that a block looks into.
    homes = probing.groupBy("home").agg(F.count(F.lit(1)).alias("n"))  # a row for each list, LISTS at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    homes = homes.select("home", F.floor(before / BLOCK_QUERIES).alias("block"), F.ceil(F.col("n") / BLOCK_QUERIES).alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    blocked = staged(probing.join(F.broadcast(homes), "home").select("query_id", "vec", "lists", "block", part.alias("part")), "ann-blocks")
    slices = max(8, -(-index.count() // SLICE_ROWS))
    looked = small(staged(blocked.select("block", "part", F.explode("lists").alias("list")).distinct(), "ann-looked"))
    codes = index.join(looked, "list").withColumn("slice", F.pmod(F.xxhash64("rep"), F.lit(slices)))
    sliced = blocked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    cell = ("block", "part", "slice")
    found = codes.groupBy(*cell).cogroup(sliced.groupBy(*cell)).applyInArrow(_scan(model, shortlist), "query_id long, rep long, approx double")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("approx", "rep"))).where(F.col("nth") <= shortlist).select("query_id", "rep")
    exact = found.join(classes, "rep").join(asked.withColumnRenamed("vec", "query_vec"), "query_id")
    exact = exact.select("query_id", distance(F.col("query_vec"), F.col("vec")).alias("score"), F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_additive_quantisation(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
