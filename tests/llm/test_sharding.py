import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import sharding


def check(rows, shards, equal):
    slots, sizes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    if equal:
        assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= equal
    return sizes


def test_even_shards_with_a_hot_text(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text of some length").otherwise(F.concat(F.lit("t"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")))).alias("text"))
    rows = sharding.shard(docs, 16).collect()
    total = sum(r["size"] for r in rows)
    check(rows, 16, 0.021 * total / 16 + 200)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows[:50]} == {(r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.where(F.col("doc_id").isin([r.doc_id for r in rows[:50]])).collect()}


def test_groups_stay_together_where_they_can(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 4)).alias("text"))
    rows = sharding.shard(docs, 8).collect()
    of = {}
    for r in rows:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, of.values())) == 1
    check(rows, 8, 0.021 * sum(r["size"] for r in rows) / 8 + 200)


def test_odd_rows(odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    check(rows, 4, None)
    assert sharding.shard(none).count() == 0
    again = {(r.doc_id, r.slot, r.shard) for r in sharding.shard(odd.repartition(3), 4).where("doc_id != 7").collect()}
    assert again == {(r.doc_id, r.slot, r.shard) for r in rows if r.doc_id not in (7, None)}


@pytest.mark.parametrize("hot", [False, True])
def test_equals_exact_splitters(spark, monkeypatch, hot):
    """All rows in order of the key, with running bytes: boundaries lie where these say, within tolerance, and slots follow that order."""
    monkeypatch.setattr(sharding, "RUN_ROWS", 700)
    text = F.concat(F.lit("text "), F.floor(F.col("id") / 3), F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(400))).cast("int")))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when((F.col("id") % 3 == 0) & F.lit(hot), F.lit("one text of a third of all rows, and no short one at that")).otherwise(text).alias("text"))
    keys = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 4).alias("h"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "doc_id"), 4).alias("d"))
    got = sharding.shard(docs, 16).join(keys, "doc_id").orderBy("h", "d").toPandas()
    assert len(got) == 9000 and got["shard"].is_monotonic_increasing
    assert (got.groupby("shard").cumcount() == got["slot"]).all()
    ends, share = got.groupby("shard")["size"].sum().cumsum().to_numpy(), got["size"].sum() / 16
    exact = got["size"].cumsum().to_numpy()
    for i, end in enumerate(ends[:-1]):
        nearest = exact[np.argmin(abs(exact - share * (i + 1)))]
        assert abs(end - share * (i + 1)) <= max(sharding.GROUP_TOLERANCE * share, abs(nearest - share * (i + 1)))
