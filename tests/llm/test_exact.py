import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from caseloom.llm import common, exact


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.integers(0, 40))
def test_golomb_round_trip(values, shift):
    v = np.array(sorted({x >> shift for x in values}), np.uint64)
    k, code = exact.golomb_encode(v)
    assert (exact.golomb_decode(len(v), k, code) == v).all()


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ids = {}
    for i, t in rows:
        ids.setdefault(lower(t), []).append(i)
    top = {t: max((i for i in x if i is not None), default=None) for t, x in ids.items()}
    return sorted(((i, top[lower(t)], len(ids[lower(t)]), i == top[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(df).collect()), key=str)


def test_odd_rows(odd, none):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("unit", [1 << 15, 40])
def test_many_units_and_a_hot_group(spark, monkeypatch, parts, unit):
    """unit = 40: units are joined before they send, as in large tables. SPARE = 1: half of the fingerprints meet others by chance."""
    monkeypatch.setattr(exact, "small", lambda df, limit=0: df)
    monkeypatch.setattr(exact, "UNIT", unit)
    if unit == 40:
        monkeypatch.setattr(exact, "SPARE", 1)
        monkeypatch.setattr(exact, "OWNER_ROWS", 100)
    rows = [(i, "same Text" if i % 3 == 0 else f"text {i // 2 % 700} É") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert found(df) == brute(rows)


def test_bloom_filtered_joins(spark, monkeypatch):
    """Semi- and anti-joins lose no row however full the filter is, and move few rows beside those wanted."""
    df = spark.range(5000).select(F.when(F.col("id") != 17, F.col("id")).alias("k"), F.lit("text").alias("t"))
    ids = common.staged(df.where("k % 50 = 3").select("k"), "ids")
    assert {r.k for r in common.only(df, ids, "k").collect()} == set(range(3, 5000, 50))
    assert common.may_be_among(df, ids, "k").count() <= 110 and common.may_be_among(df, ids, "k", other=True).count() >= 4890
    left = common.without(df, ids, "k")
    assert left.columns == ["k", "t"] and left.count() == 4900 and left.where("k IS NULL").count() == 1
    with monkeypatch.context() as m:
        m.setattr(common, "LEAST_WORDS", 1)
        m.setattr(common, "WORDS", 2)
        assert {r.k for r in common.only(df, ids, "k").collect()} == set(range(3, 5000, 50)) and common.without(df, ids, "k").count() == 4900
    assert common.only(df, ids.limit(0), "k").count() == 0 and common.without(df, ids.limit(0), "k").count() == 5000
