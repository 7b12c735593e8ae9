"""The quality cascade against a plain version, and what its order costs."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "a b c a b c a b", "a a a a", "a b c", "", None, "x\nx\n\nx \ny", "é ü ß z 🙂 🙂 🙂 🙂", "\x0b\x0c tab\tword\r\nnext # $ |",
    "a b c d e f g a b c x y z d e f", "\n".join(["same line of text here"] * 30), " ".join(f"w{i}" for i in range(40_000)) + " w0 w1 w2",
]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in quality.with_statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_any_order_gives_the_same_verdict(spark, odd):
    names = list(quality.RULES)
    a = {(r.doc_id, r.text): r.failed_rule is None for r in quality.cascade(odd, order=names).collect()}
    b = {(r.doc_id, r.text): r.failed_rule is None for r in quality.cascade(odd, order=names[::-1]).collect()}
    assert a == b and len(a) == odd.distinct().count()


def test_a_rule_after_a_rejection_is_not_evaluated(spark):
    """The second rule fails on texts that the first one rejects."""
    rules = {"first": lambda t, s: t == "bad", "second": lambda t, s: F.when(t == "bad", F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(t == "poor")}
    df = spark.createDataFrame([("bad",), ("poor",), ("good",)], "text string")
    assert {r.text: r.failed_rule for r in quality.cascade(df, rules, ["first", "second"]).collect()} == {"bad": "first", "poor": "second", "good": None}
    with pytest.raises(Exception, match="evaluated"):
        quality.cascade(df, rules, ["second", "first"]).collect()


def test_order_by_rejections_for_what_they_cost(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(100)], "n int").select(F.col("n").cast("string").alias("text"))
    n = lambda t: t.cast("int")
    rules = {"none": lambda t, s: F.lit(False), "dear": lambda t, s: n(t) < 60, "same": lambda t, s: n(t) < 50, "cheap": lambda t, s: n(t) < 40, "other": lambda t, s: n(t) >= 95}
    times = {"none": 1.0, "dear": 3.0, "same": 2.6, "cheap": 1.0, "other": 1.0}
    order = iter(times)
    took = [0.0] * quality.TIMINGS
    monkeypatch.setattr(quality, "_seconds", lambda df: took.pop(0) if took else next(feed))
    feed = iter([times[k] for k in order for _ in range(quality.TIMINGS)])
    found = quality.estimate(df, rules)
    assert [(e.rule, e.rejected) for e in found] == [("cheap", 40), ("dear", 20), ("other", 5), ("none", 0), ("same", 0)]


def test_odd_rows(spark, odd, none, tmp_path):
    odd = odd.withColumn("a.b", F.lit(1)).withColumn("__text", F.lit("x"))
    out = quality.cascade(odd)
    assert out.columns == [*odd.columns, "failed_rule"] and out.count() == odd.count()
    assert quality.cascade(none).count() == 0
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = quality.op12_cascade(spark, str(tmp_path / name))
        rows = got.collect()
        want = sorted((plain(r.text) for r in df.collect()))
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_no_python_in_the_plan(spark, odd):
    plan = quality.cascade(quality.with_statistics(odd), order=list(quality.RULES), columns={n: n for n in quality.STATISTICS})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
