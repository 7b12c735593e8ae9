import itertools
import random

import duckdb
import numpy as np
import pytest

from caseloom.llm import neardup


def brute(rows, k, percent=80):
    """Components by comparing all pairs."""
    sets = [(i, neardup.shingles(t or "", k)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            top[y] = x
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for i, s in sets)


def found(df, k):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_groups(df, k).collect())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = [rnd.choice(words) for _ in range(40)]
    rows = []
    for base in range(30):
        text = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            t = list(text)
            for _ in range(rnd.choice([0, 1, len(t) // 60, len(t) // 40, len(t) // 20])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t + (common if base % 3 == 0 else [])))
    rows += [rows[3]] * 60 + [rows[7].upper()] * 3
    hot = [rnd.choice(words) for _ in range(200)]
    for _ in range(80):
        t = list(hot)
        t[rnd.randrange(200)] = "changed"
        t[rnd.randrange(200)] = rnd.choice(words)
        rows.append(" ".join(t))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 8])
@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, corpus, monkeypatch, block, k):
    monkeypatch.setattr(neardup, "BLOCK", block)
    if block == 8:
        monkeypatch.setattr(neardup, "small", lambda df, limit=0: df)
        monkeypatch.setattr(neardup, "CONFIRM_ROWS", 3)
    got = found(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5), k)
    assert got == brute(corpus, k)


def test_odd_rows(odd, none):
    assert found(odd, 4) == brute([(r.doc_id, r.text) for r in odd.collect()], 4)
    assert found(none, 4) == []
    kept = {(r.doc_id, r.kept) for r in neardup.near_groups(odd, 4).collect()}
    assert {(1, True), (2, False), (7, False), (None, True), (3, True), (4, True)} <= kept


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.comp) for r in neardup.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_repeated_ids_are_one_document(spark):
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    df = spark.createDataFrame([(1, x), (5, x), (5, y), (7, y), (8, "none of these")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_groups(df, 4).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (8, 8, True)}


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op3_coordinate_join(spark, sf).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert got == sorted(c.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({neardup.ORACLE})").fetchall())


@pytest.mark.parametrize("small", [0, 4096])
def test_collisions_are_counted_in_cells(monkeypatch, small):
    """Merged posting lists give the pairs that comparing all signatures would give."""
    monkeypatch.setattr(neardup, "SMALL_CELL", small)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, (6, neardup.COORDINATES))
    keys = base[rng.integers(0, 6, 60)]
    keys = np.where(rng.random(keys.shape) < 0.6, rng.integers(0, 1 << 60, keys.shape), keys)
    keys[:, 2] = 77
    low = np.arange(9, dtype="<u4").tobytes()
    for own in (True, False):
        rows = [{"rid": i, "comp": i % 50, "side": 0 if own else i % 2, "own": own, "c": 2, "n": 9, "sig": keys[i].astype("<i8").tobytes(), "low": low} for i in range(60)]
        want = set()
        for i, j in itertools.combinations(range(60), 2):
            same = keys[i] == keys[j]
            if same.sum() >= neardup.MATCHES and same.argmax() == 2 and i % 50 != j % 50 and (own or i % 2 != j % 2):
                want.add((i, j))
        assert set(neardup._cell_pairs(rows, 80)) == want and want
