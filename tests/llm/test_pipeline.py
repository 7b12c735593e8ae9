import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.llm import toxicity
from tests.llm.test_linedup import brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if n + 1 < len(pipeline.STAGES):
            assert after.columns == columns and 0 < after.count()
        if n < 3:
            assert after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        if n == 4:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}
        before = after
    assert before.where("length > 4096").count() == 0


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, none, n):
    stage = pipeline.STAGES[n][1]
    assert stage(spark, odd, SF).count() > 0 and stage(spark, none, SF).count() == 0
    if n < 4:
        assert stage(spark, odd, SF).columns == odd.columns
    if n != 4:
        assert {(r["toxicity"], r["size"], r["row"], r["n"]) for r in stage(spark, odd, SF).select("toxicity", F.col("size"), "row", "n").collect()} == {(0.5, 1, 2, 3)}
    if n < 3:
        left = {r.doc_id for r in stage(spark, odd, SF).collect()}
        assert {1, 3, 4, 5, 6, 8, 10, None} <= left


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_equal_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {i for i in root if find(i) == i} and len(got) < len(rows)


def test_toxic_documents_are_those_that_the_scores_say(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_documents(docs, labels))
    plain = toxicity.Scorer({r["feature"]: r["weight"] for r in model.collect()})
    want = {r.doc_id for r in docs.collect() if plain.document(r.text or "")[0] < 0.5}
    assert {r.doc_id for r in pipeline.toxic_documents(spark, docs, SF).collect()} == want


def test_line_duplicates_equal_a_plain_version_and_leave_copies(spark):
    """Documents that share passages lose them as in the plain version; two that are copies as wholes are left to the next stage."""
    rnd = random.Random(9)
    passages = [" ".join(rnd.choice("abcdefgh") * 4 for _ in range(14)) for _ in range(6)]
    own = lambda i: [f"line {n} of document {i} which no other document has, {rnd.random()}" for n in range(8)]
    rows = [(i, "\n".join([*own(i), *rnd.sample(passages, 2)])) for i in range(40)]
    long = "\n".join(f"a line of number {n} and so on for some words {rnd.random()}" for n in range(60))
    copies = [(100, long), (101, long + "\nand one word more")]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.line_duplicates(spark, docs, SF).collect()}
    assert got == brute(rows, 10) | dict(copies)
