import math

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom.llm import mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [2_000, 3])
def test_matches_sql(spark, monkeypatch, few):
    """All columns; few = 3 makes every source divide its ranks several times."""
    monkeypatch.setattr(mixing, "FEW", few)
    df = mixing.op1_pareto_mix(spark, SF)
    assert df.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Share and reshare, literally."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left, share = total - sum(full.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / share > cap * sizes[s]]
        if not over:
            return full | {s: left * w[s] / share for s in rest}
        full |= {s: cap * sizes[s] for s in over}


def test_targets_and_words(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r["size"] and r.copies <= 3
    assert {r.taken for r in rows if r["size"] == 0} == {0}


def test_taken_words_come_near_targets_and_repeat(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17)).alias("source"), F.repeat(F.lit("w "), (1 + F.pmod(F.xxhash64("id"), F.lit(90))).cast("int")).alias("text"))
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in a} == {(r.doc_id, r.copies) for r in b}
    per = {}
    for r in a:
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - got) <= 3 for t, got in per.values())
    assert all(math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size) for r in a)


def test_inclusion_probabilities_are_unequal_and_held(spark):
    """One source of three sizes, its missing words a third: over many documents, shares taken are as the square roots of sizes."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.repeat(F.lit("w "), F.when(F.col("id") % 6 < 2, 4).when(F.col("id") % 6 < 4, 16).otherwise(36).cast("int")).alias("text"),
    )
    got = {r["size"]: r.c for r in mixing.mix(docs, weights=(1, 3)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("c")).collect()}
    # Words missing: half of the source. With p = factor * root: factor * (2 * 4 + 4 * 16 + 6 * 36) = 28.
    assert got == {n: pytest.approx(28 / 288 * n**0.5, abs=0.02) for n in (4, 16, 36)}


def test_measures_that_are_certain(spark):
    """A document that p would exceed 1 for is taken, and the words of the others still end at the target."""
    docs = spark.createDataFrame([(i, "a", "w " * (10_000 if i == 0 else 10)) for i in range(1500)] + [(i, "b", "w " * 10) for i in range(1500, 3000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, weights=(1, 1)).where("source = 'a'").collect()
    assert {r.copies for r in rows if r["size"] == 10_000} == {1}
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 10


def test_priority_raises_the_chance(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 4 < 2, 1.6).otherwise(0.4).alias("p"))
    got = {r.p: r.c for r in mixing.mix(docs, weights=(1, 3), priority_col="p", whole=True).select("row.p", "copies", "source").where("source = 's0'").groupBy("p").agg(F.avg("copies").alias("c")).collect()}
    assert got[1.6] > 2.5 * got[0.4]


def test_the_mix_keeps_rows_and_columns(odd, none):
    out = mixing.repeated(odd)
    assert out.columns == odd.columns and out.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_no_python_in_the_plan(spark, odd):
    text = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
