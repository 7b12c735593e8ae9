import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from caseloom.llm import ann


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            out[q] = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q})[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    hot = rows[5][1]
    rows += [(600 + i, hot) for i in range(300)]
    return [*rows, (900, None), (901, [0.0] * 8), (902, [1.0, None] * 4), (920, [math.nan] + [1.0] * 7), (921, [math.inf] + [1.0] * 7), (922, [1.0, 2.0]), (None, hot), (605, hot)]


def test_recall_ties_and_odd_vectors(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rep int").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(vectors)
    assert set(got) == set(want)
    hit, of = 0, {i: np.array(v, float) for i, v in vectors if i is not None and v and None not in v}
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hit += len({i for _, i, _ in rows} & {i for _, i in want[q]})
        assert [s for _, _, s in rows] == pytest.approx([float(np.sqrt(((of[q] - of[i]) ** 2).sum())) for _, i, _ in rows], rel=1e-12)
    assert hit >= 0.9 * 10 * len(want)
    hot = sorted(got[600])
    assert [i for _, i, _ in hot] == [5, *range(601, 610)] and {s for _, _, s in hot} == {0.0}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_far_queries_find_ten_too(spark, monkeypatch):
    """2,000 vectors in tight clusters and three far ones, which a starting centre is drawn from: their list holds three vectors, their answers ten."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 8)) * 10
    x = np.concatenate([centres[rng.integers(0, 100, 2000)] + 0.01 * rng.normal(size=(2000, 8)), 1000 + rng.normal(size=(3, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    fitted = []

    def fit(vectors):
        m = ann._fit(pd.DataFrame(rows, columns=["id", "vec"]), 22).iloc[0]
        fitted.append(ann.Model(8, m["books"], np.concatenate([np.frombuffer(m["centres"], "<f8").reshape(-1, 8), x[2000:2001]]).tobytes(), 1))
        return fitted[0]

    monkeypatch.setattr(ann, "fit_model", fit)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 100 = 0 OR vec_id >= 2000")).toPandas()
    assert fitted[0].probes == 1 and (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == 23
    for q in (2000, 2001, 2002):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert got[got.query_id == q].sort_values("rank")["vec_id"].tolist()[:2] == np.argsort(far)[1:3].tolist()


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x, books = rng.normal(size=(200, 8)), rng.normal(size=(4, 16, 8)) * 0.5
    far = lambda codes: sum(((x - sum(b[codes[:, m]] for m, b in enumerate(books))) ** 2).sum(1))
    assert far(ann.encode(x, books, 8)[0]) <= far(ann.encode(x, books, 1)[0])


@pytest.mark.parametrize("clusters", [0, 200])
def test_recall_on_many_vectors(spark, monkeypatch, clusters):
    """50,000 vectors against brute force, without clusters and with; where there are clusters, few lists are looked into. Small blocks make many cells."""
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 24)).astype(np.float32)
    if clusters:
        x = (0.3 * x + 2 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 50_000)]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 24).cast(pa.list_(pa.float32()))})).repartition(4)
    models = []
    fit = ann.fit_model
    monkeypatch.setattr(ann, "fit_model", lambda v: models.append(fit(v)) or models[-1])
    got = ann.nearest(df, df.where("vec_id % 250 = 0")).toPandas().groupby("query_id")["vec_id"].agg(set)
    queries = np.arange(0, 50_000, 250)
    assert set(got.index) == set(queries)
    y = x.astype(np.float64)
    far = (y * y).sum(1) - 2 * y[queries] @ y.T
    far[np.arange(200), queries] = np.inf
    true = np.argpartition(far, 9, axis=1)[:, :10]
    recall = sum(len(got[q] & set(t.tolist())) for q, t in zip(queries, true, strict=True)) / 2000
    assert recall >= 0.95
    if clusters:
        assert models[0].probes <= len(models[0].centres) / 4
