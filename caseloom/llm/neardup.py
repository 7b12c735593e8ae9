"""Near duplicates by an inverted join of MinHash signature coordinates.

1. A document's set of word shingles is hashed; its signature has COORDINATES coordinates, each three minima combined.
   Documents with the same sequence of words (by SHA-256) are one class from here on.
2. Classes are posted under each (coordinate, value) pair of the signature's prefix. A pair of classes that agrees in at least
   MATCHES coordinates agrees in one of the first COORDINATES - MATCHES + 1, so the rest need no postings. Values that one class
   alone has are dropped.
3. Each list is joined with its first class, and the collisions of these pairs are counted over all lists. Pairs with MATCHES
   of them or more are confirmed and form components. Lists within one component are done, whatever their size.
4. The lists that are left are cut into cells of bounded size. In a cell the posting lists of all coordinates are merged: each class counts its
   collisions with all others at once. A pair is skipped in all lists but that of its first agreeing coordinate, and within one component. Pairs
   with MATCHES collisions or more are held against the LOWEST smallest hashes of both sets (all of them, for most documents).
5. Pairs that remain are confirmed on the full shingle sets of the texts, and their links join the components.

At a similarity of 0.8 a coordinate agrees with probability 0.51, so a pair has fewer than MATCHES collisions about once in ten million.
No list, group or component is collected, capped or expanded into all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import discard, only, lean, small, staged, text_slices

COORDINATES, MATCHES, MINIMA = 40, 5, 3
PREFIX = COORDINATES - MATCHES + 1
BLOCK = 2048
#: Hashes of a set that travel with its signature; by how many standard deviations an estimate from them may fall short.
LOWEST, SLACK = 256, 5.5
#: Rows by rows of a cell whose collisions are counted without merging lists.
SMALL_CELL = 4096
#: Pairs of one document that are confirmed together, about; those of a document with more are dealt out.
CONFIRM_ROWS = 512
#: Lists (a key and an id each) up to this many may be broadcast.
LIST_ROWS = 1_000_000

_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, COORDINATES * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


SIGNATURE = "doc_id long, n long, digest binary, keys array<long>, sig binary, low binary"
LOW = "doc_id long, n long, low binary"

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (int(_BASE), inverse)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, in order, and each text's number of words."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _power(len(raw) + 1)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    borders = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, borders), prepend=0)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of k words; of the whole sequence, if it is shorter."""
    words, counts = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        runs = runs * _STEP + words[i : i + len(runs)]
    runs = _mix(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(runs[at : at + n - k + 1]))
        elif n:
            whole = np.uint64(n)
            for w in words[at : at + n]:
                whole = whole * _STEP + w
            out.append(_mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _low(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([(s[:LOWEST] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())


def _signatures(k: int):
    def run(batches):
        for batch in text_slices(batches, "text", 1_000_000):
            with np.errstate(over="ignore"):
                texts = pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist()
                sets = shingle_sets(texts, k)
                minima = np.zeros((len(sets), len(_ODD)), np.uint64)
                for i, s in enumerate(sets):
                    for at in range(0, len(s), 4096):
                        least = (s[at : at + 4096, None] * _ODD).min(axis=0)
                        minima[i] = least if at == 0 else np.minimum(minima[i], least)
                minima = _mix(minima)
                keys = np.broadcast_to(np.arange(COORDINATES, dtype=np.uint64), (len(sets), COORDINATES))
                for j in range(MINIMA):
                    keys = keys * _STEP + minima[:, j::MINIMA]
                keys = _mix(keys).astype("<i8")
                n = np.array([len(s) for s in sets], np.int64)
                digests = pa.array([hashlib.sha256(b" ".join(t.split())).digest() for t in texts], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PREFIX), pa.array(keys[:, :PREFIX].reshape(-1)))
                sigs = pa.array([x.tobytes() for x in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), digests, lists, sigs, _low(sets)], ["doc_id", "n", "digest", "keys", "sig", "low"])

    return lean(run)


def _lowest(k: int):
    def run(batches):
        for batch in text_slices(batches, "text", 1_000_000):
            with np.errstate(over="ignore"):
                sets = shingle_sets(pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _low(sets)], ["doc_id", "n", "low"])

    return lean(run)


def _may_be_alike(percent: int):
    def run(batches):
        for batch in batches:
            low = [[np.frombuffer(x, "<u4") for x in batch.column(c).to_pylist()] for c in ("low_a", "low_b")]
            good = [_may_link(a, n, b, m, percent) for a, n, b, m in zip(low[0], batch.column("n_a").to_pylist(), low[1], batch.column("n_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return lean(run)


def likely_copies(pairs: DataFrame, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Those of the staged pairs (a, b) of documents (doc_id, text) whose smallest shingle hashes allow this similarity.

    Rows that repeat a doc_id count each; documents without words, or without a row, are in no pair. An empty table gives an empty result.
    """
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "alike-wanted")
    lows = staged(only(docs.select("doc_id", "text"), wanted, "doc_id").mapInArrow(_lowest(k), LOW).where("n > 0").dropDuplicates(), "alike-lows")
    side = lambda s: lows.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("low").alias(f"low_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_may_be_alike(percent), "a long, b long").distinct()


def _may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """Whether sets of n and m elements can be similar enough, by the smallest hashes of each."""
    top = min(int(a[-1]) if n > len(a) else 1 << 32, int(b[-1]) if m > len(b) else 1 << 32)
    x, y = (a, b) if top == 1 << 32 else (a[a <= top], b[b <= top])
    common = len(np.intersect1d(x, y, assume_unique=True)) if n == len(a) and m == len(b) else len(np.intersect1d(x, y))
    union = len(x) + len(y) - common
    slack = 0.0 if top == 1 << 32 else SLACK * 100 * np.sqrt(percent / 100 * (1 - percent / 100) * union)
    return 100 * common + slack >= percent * union


def _cell_pairs(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of one cell: rows of one side with each other, or of two sides across."""
    side = np.array([r["side"] for r in rows])
    ids, comp = np.array([r["rid"] for r in rows], np.int64), np.array([r["comp"] for r in rows], np.int64)
    keys = np.frombuffer(b"".join(r["sig"] for r in rows), "<i8").reshape(len(rows), -1)
    low = [np.frombuffer(r["low"], "<u4") for r in rows]
    own, c = rows[0]["own"], rows[0]["c"]
    left = np.flatnonzero(side == 0)
    right = left if own else np.flatnonzero(side == 1)
    if len(left) * len(right) <= SMALL_CELL:
        collisions = (keys[left][:, None] == keys[right][None]).sum(2)
    else:
        collisions = _merged(keys[left], keys[right])
    far = (collisions >= MATCHES) & (comp[left][:, None] != comp[right][None]) & (ids[left][:, None] != ids[right][None])
    x, y = np.nonzero(np.triu(far, 1) if own else far)
    x, y = left[x], right[y]
    here = (keys[x] == keys[y]).argmax(1) == c if len(x) else np.zeros(0, bool)
    out = []
    for i, j in zip(x[here].tolist(), y[here].tolist(), strict=True):
        if _may_link(low[i], rows[i]["n"], low[j], rows[j]["n"], percent):
            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


def _merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collisions of each left row with each right one, by merging the posting lists that hold the left row: only what collides is touched."""
    order = np.argsort(right, axis=0, kind="stable")
    values = np.take_along_axis(right, order, 0)
    starts, ends = (np.stack([np.searchsorted(values[:, j], left[:, j], side) for j in range(left.shape[1])], 1) for side in ("left", "right"))
    out = np.zeros((len(left), len(right)), np.uint8)
    for i in range(len(left)):
        lists = [order[starts[i, j] : ends[i, j], j] for j in np.flatnonzero(starts[i] < ends[i])]
        if lists:
            out[i] = np.bincount(np.concatenate(lists), minlength=len(right))
    return out


def _cells(percent: int):
    def run(batches):
        """Rows in order of their cell -> candidate pairs; only the rows of one cell are held."""
        cell, rows = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    if len(rows) > 1:
                        out += _cell_pairs(rows, percent)
                    cell, rows = r["cell"], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(rows) > 1:
            out = _cell_pairs(rows, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return lean(run)


def shingles(text: str, k: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def _confirm(k: int, percent: int):
    def run(batches):
        """Rows in order of (a, part): the text of a, then those of the documents to hold against it."""
        key, heads = None, []
        for batch in text_slices(batches, "text"):
            good = []
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text")), strict=True):
                if (a, part) != key:
                    key, heads = (a, part), []
                y, similar = shingles(text, k), False
                if b is None:
                    heads.append(y)
                else:
                    for x in heads:
                        common = len(x & y)
                        similar = similar or (common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                good.append(similar)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return lean(run)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, among: bool = False) -> DataFrame:
    """Those of the staged pairs (a, b) whose texts' full shingle sets are similar enough. among: docs holds the documents of the pairs alone.

    The pairs of one a are dealt into parts of bounded size; each part has its text once, and its other texts stream past. Of rows that repeat a doc_id any may confirm.
    """
    texts = docs.select("doc_id", "text")
    if not among:
        texts = only(texts, staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-wanted"), "doc_id")
    texts = texts.repartition("doc_id").dropDuplicates(["doc_id", "text"])
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CONFIRM_ROWS).alias("parts")).where("parts > 1")
    dealt = pairs.join(small(staged(parts, "near-parts")), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    others = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    rows = heads.unionAll(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(k, percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> id, comp: the smallest id that each can reach. Neighbours are led to the smallest one known, larger and smaller ones in turn, until nothing changes."""
    e = staged(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "near-edges")
    seen = None
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u != v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        below = large.join(least, "v")
        before, e = e, staged(below.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(below.select("v", F.col("m").alias("u"))).where("u != v").distinct(), "near-edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(before)
        if now == seen or not now[0]:
            return e.select(F.col("v").alias("id"), F.col("u").alias("comp"))
        seen = now


def _within(column: str, comps: DataFrame) -> tuple[DataFrame, F.Column]:
    """comps to join on column, and the component of its value (itself, if it has none)."""
    named = small(comps).select(F.col("id").alias(column), F.col("comp").alias(f"comp_{column}"))
    return named, F.coalesce(f"comp_{column}", column)


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_shingles, component_id and kept for each row.

    Words are lower-cased in A-Z. Documents with fewer than k words have their whole sequence as the only shingle; those without
    words, or with null text, have none and are linked with nothing. Rows that repeat a doc_id are one document: what any of them is linked with,
    all are, and they have one component; each keeps its own n_shingles. A null doc_id takes no part: its component is null and it is kept. Empty tables give empty results.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = staged(docs.mapInArrow(_signatures(k), SIGNATURE), "near-signatures")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL")
    same = linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    same = small(staged(same, "near-classes"))
    reps = linked.join(same, "digest", "left").where("rep IS NULL OR rep = doc_id").withColumnRenamed("doc_id", "rid")
    # Rows that repeat a doc_id with other words: their classes are linked.
    split = staged(linked.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("doc_id"), "near-repeated")
    own = linked.join(small(split), "doc_id", "left_semi").join(same, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("b"))
    own = own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b").where("a < b").distinct()
    # Postings of values that several classes have, with the first class of each list.
    posts = reps.select("rid", F.posexplode("keys").alias("c", "key"))
    lists = posts.groupBy("key").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).where("leader < last").drop("last")
    posts = staged(posts.join(small(staged(lists, "near-lists"), LIST_ROWS), "key").select("key", "c", "rid", "leader"), "near-postings")
    sigs = staged(reps.join(small(staged(posts.select("rid").distinct(), "near-posted")), "rid", "left_semi").select("rid", "n", "sig", "low").dropDuplicates(["rid", "sig"]), "near-posted-signatures")
    first = posts.where("rid != leader").groupBy(F.col("leader").alias("a"), F.col("rid").alias("b")).agg(F.countDistinct("c").alias("collisions"))
    first = staged(first.where(F.col("collisions") >= MATCHES).select("a", "b"), "near-first-pairs")
    links = staged(confirmed(first, docs, k, percent).unionAll(own), "near-links")
    comps = components(links)
    # Lists that hold more than one component, in cells of two blocks.
    names, comp = _within("rid", comps)
    named = staged(posts.join(names, "rid", "left").select("key", "c", "rid", comp.alias("comp")), "near-named")
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    mixed = mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cells = named.join(small(staged(mixed, "near-mixed"), LIST_ROWS), "key").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    cells = cells.join(sigs, "rid").select(F.xxhash64("key", "first", "second").alias("cell"), "key", "c", "rid", "comp", "side", (F.col("first") == F.col("second")).alias("own"), "n", "sig", "low")
    found = cells.repartition("cell").sortWithinPartitions("cell", "rid").select("cell", "c", "rid", "comp", "side", "own", "n", "sig", "low").mapInArrow(_cells(percent), "a long, b long")
    found = staged(found.distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "near-pairs")
    # Their links join whole components.
    (of_a, a), (of_b, b) = _within("a", comps), _within("b", comps)
    more = confirmed(found, docs, k, percent).join(of_a, "a", "left").join(of_b, "b", "left").select(a.alias("a"), b.alias("b"))
    joined = components(more)
    out = rows.select("doc_id", "n", "digest").join(same, "digest", "left").withColumn("id", F.coalesce("rep", "doc_id"))
    names, comp = _within("id", comps)
    out = out.join(names, "id", "left").withColumn("one", comp)
    names, comp = _within("one", joined)
    out = out.join(names, "one", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, comp).otherwise(F.col("doc_id"))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
         s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
         l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
         e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
         r AS (SELECT a AS id, b AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a),
         m AS (SELECT id, min(to_id) AS least FROM r GROUP BY id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = doc_id"""


def op3_coordinate_join(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
