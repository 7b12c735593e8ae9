import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from caseloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    rows = toxicity.op10_noisy_or(spark, SF).toPandas()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    both = rows[rows.held_out].merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert len(both) > 50 and (both["predicted"] == both["toxic"]).mean() > 0.93
    assert both[both.toxic == 1]["predicted"].mean() > 0.7
    assert both[both.toxic == 0]["predicted"].mean() < 0.02


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"clean words number {i}. they go on here.\n" + ("you total idiot there. " if i % 4 == 0 else "you are there. ") + f"and so it ends {i % 13}", int(i % 4 == 0)) for i in range(400)]
    return toxicity.fit(spark.createDataFrame([*rows, (900, None, None), (901, None, 0)], "doc_id long, text string, toxic int")).persist()


def test_offending_sentences(spark, model):
    text = "Clean words number one. You total IDIOT there! They go on here."
    r = toxicity.score(spark, spark.createDataFrame([(1, text), (2, "they go on here.")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert r[0].toxicity > 0.5 > r[1].toxicity and [text[s.start : s.end].strip() for s in r[0].toxic_spans] == ["You total IDIOT there!"] and r[1].toxic_spans == []


def test_odd_rows(spark, model, odd, none):
    got = toxicity.score(spark, odd, model)
    assert got.count() == odd.count() and got.where("toxicity >= 0.5").count() == 0
    assert {r.toxicity for r in got.where("doc_id IN (3, 4, 5)").collect()} == {0.0}
    kept = toxicity.score(spark, odd, model, keep=True)
    assert set(odd.columns) <= set(kept.columns) and kept.where("doc_id = 1").first().text.startswith("The quick")
    assert toxicity.score(spark, none, model).count() == 0


def test_no_labels_give_no_model_that_rejects(spark):
    empty = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score(spark, spark.createDataFrame([(1, "any text.")], "doc_id long, text string"), empty).first().toxicity < 0.5


def plain_score(text, weights):
    """One minus the product, sentence by sentence and word by word."""
    clean = 1.0
    for sentence in re.findall(r"[^.!?\n]+[.!?]*", text.lower()):
        if sentence.strip():
            found = {f for word in sentence.split() for f in toxicity.features(word)}
            clean *= 1 - 1 / (1 + math.exp(-(weights.get("", toxicity.START) + sum(weights.get(f, 0.0) for f in found))))
    return 1 - clean


def test_scores_equal_a_plain_noisy_or(spark, model):
    weights = {r.feature: r.weight for r in model.collect()}
    assert any(x > 0.5 for f, x in weights.items() if f)
    texts = ["You total idiot there! total", "they go on here.\n\nIdiot. idiots, IDIOT?", "", "...", "clean words number 5. you are there", "one line\nyou total idiot " * 40]
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got == {i: pytest.approx(plain_score(t, weights), abs=1e-9) for i, t in enumerate(texts)}


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    texts = [". ".join(" ".join(f"w{rng.integers(9)}" for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(0, 4))) for _ in range(12)]
    data = toxicity._sentences(texts, {f"w{i}{end}": [i] for i in range(9) for end in ("", ".")})
    y, w, bias = rng.integers(0, 2, 12).astype(float), rng.normal(size=9), -1.0
    loss, g, g_bias = toxicity.loss_and_slope(w, bias, *data, y, 2, 12)
    # The loss itself, document by document.
    each = [plain_score(t, {"": bias} | {f"w{i}": x for i, x in enumerate(w)}) if t else 1 / (1 + math.exp(-bias)) for t in texts]
    assert loss == pytest.approx(-np.mean([math.log(p if t else 1 - p) for p, t in zip(each[2:], y[2:], strict=True)]))
    at = lambda w, bias: toxicity.loss_and_slope(w, bias, *data, y, 2, 12)[0]
    for i in range(9):
        d = np.eye(9)[i] * 1e-6
        assert g[i] == pytest.approx((at(w + d, bias) - at(w - d, bias)) / 2e-6, abs=1e-6)
    assert g_bias == pytest.approx((at(w, bias + 1e-6) - at(w, bias - 1e-6)) / 2e-6, abs=1e-6)


def test_fitting_lowers_the_loss(spark, model):
    rows = [f"clean words number {i}. they go on here.\n" + ("you total idiot there. " if i % 4 == 0 else "you are there. ") + f"and so it ends {i % 13}" for i in range(400)]
    weights, y = {r.feature: r.weight for r in model.collect()}, np.array([i % 4 == 0 for i in range(400)])
    loss = lambda weights: -np.mean(np.log(np.where(y, s := np.clip([plain_score(t, weights) for t in rows], 1e-9, 1 - 1e-9), 1 - s)))
    assert loss(weights) < 0.1 < 0.5 < loss({"": -1.0})
