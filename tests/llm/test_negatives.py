"""Hard negatives against brute force, and that certified windows spare cells."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import negatives


def plain(rows, every, low=30, high=90):
    rows = sorted({(i, label, tuple(q)) for i, label, q in rows if None not in (i, label, q)})
    out = []
    for i, label, q in rows:
        if i % every:
            continue
        scored = sorted((-sum(map(int.__mul__, q, r[2])), r[0], r[1]) for r in rows if r[0] != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:10]
            out += [(i, p, rank, n, -s, -v) for rank, (v, n, _) in enumerate(inside, 1)]
    return sorted(out)


def clusters(seed, n, dims, spread, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (8, dims))
    x = np.floor(centres[rng.integers(0, 8, n)] + rng.normal(0, spread, (n, dims))).astype(int)
    return [(i, int(rng.integers(0, labels)), x[i].tolist()) for i in range(n)]


SCHEMA = "vec_id long, label int, q array<long>"


@pytest.mark.parametrize(("rows", "every"), [
    (clusters(1, 500, 8, 10), 10),
    (clusters(2, 300, 5, 90), 7),
    ([(i, i % 2, [1, 2, 3]) for i in range(120)] + [(i, i % 3, [i % 5, 1, 0]) for i in range(120, 200)], 10),
    ([(i, i % 2, [(-1) ** i * (i % 7)]) for i in range(60)], 5),
    ([(i, 0, [i, 1]) for i in range(30)], 5),
    ([(i, i % 2, [(1 << 28) + i, -(1 << 27) + 3 * i]) for i in range(40)], 5),
])
@pytest.mark.parametrize("shape", [(37, 3)])
def test_brute_force(spark, rows, every, shape):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, slice_rows=shape[0], block=shape[1])
    assert sorted(map(tuple, got.collect())) == plain(rows, every)


def test_windows_end_the_search():
    """Tight clusters: most cells are never looked into, and what is found is that of a full scan."""
    rows = clusters(5, 4000, 16, 3)
    x = np.array([r[2] for r in rows], np.float64)
    rng = random.Random(3)
    halves = [x[:, :8], x[:, 8:]]
    words = [h[rng.sample(range(len(h)), 16)] for h in halves]
    books = negatives.Books(16, words[0].tobytes(), words[1].tobytes(), 16)
    codes = [np.argmin(((h[:, None] - w[None]) ** 2).sum(2), axis=1).astype(np.int32) for h, w in zip(halves, words, strict=True)]
    table = pa.table({"vec_id": [r[0] for r in rows], "label": pa.array([r[1] for r in rows], pa.int64()), "q": [r[2] for r in rows], "i": codes[0], "j": codes[1]})
    s = negatives.Slice(books, table)
    looked = []
    scores = s.scores
    s.scores = lambda q, a, b: looked.append(b - a) or scores(q, a, b)
    for i, label, q in rows[:20]:
        best = negatives.positives_in(s, i, label, q, 5)
        want = sorted((-sum(map(int.__mul__, q, r[2])), r[0]) for r in rows if r[0] != i and r[1] == label)[:5]
        assert [(-v, k) for v, k in zip(best.scores.tolist(), best.ids.tolist(), strict=True)] == want
    assert sum(looked) < 0.5 * 20 * len(rows)
    bounds = [b for b, _, _ in s.visit(rows[0][2])]
    assert bounds == sorted(bounds, reverse=True) and sum(e - a for _, a, e in s.visit(rows[0][2])) == len(rows)
    assert all((s.exact[a:e] @ np.array(rows[0][2], float)).max() <= b for b, a, e in s.visit(rows[0][2]))


def test_odd_rows(spark, tmp_path):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.3], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (8, [0.5, 0.3], None), (9, [0.0, 0.0], 3), (10, [1.0, 2.0, 3.0], 3), (11, [], 1), (None, [1.0, 1.0], 1), (100, [0.5, 0.3], 2), (100, [0.1, 0.3], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, slice int, i int, q int")
    df.write.parquet(str(tmp_path / "odd" / "embeddings.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    label = lambda i, v: (v + 1) % 10 if i % 7 == 0 else v
    kept = [(i, label(i, v), [math.floor(256 * x) for x in q]) for i, q, v in rows if i is not None and v is not None and q is not None and len(q) == 2 and all(x is not None and math.isfinite(x) for x in q)]
    assert sorted(map(tuple, negatives.op11_multi_index(spark, str(tmp_path / "odd")).collect())) == plain(kept, 100)
    assert negatives.op11_multi_index(spark, str(tmp_path / "none")).count() == 0
