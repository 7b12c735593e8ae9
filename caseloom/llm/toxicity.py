"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is the logistic function of the summed weights of its words' features (the word, and its first four to eight
letters, for languages that inflect); a document's score is the noisy-or ``1 - prod(1 - score)``. Weights are learnt
from document labels alone, so the sentences that carry a label are found by the model itself.

Fitting uses at most ``sample`` labelled documents, chosen by the hash of their id, and of each of these
all sentences. Scoring covers every sentence of every text.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import held, release, text_slices

#: The bound of the sample that the classifier is fitted on, in documents.
SAMPLE = 12_000
#: A feature must occur in toxic documents so often (once for each document and word), and so many standard deviations more often than by their share of all.
LEAST_DOCS, LEAST_Z = 4, 5.0
EPOCHS, RATE, DECAY, START = 30, 0.5, 1e-6, -7.0
MEMO = 150_000
SCORE, SPANS = "toxicity", "toxic_spans"
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
STRIP = "\"'()[]{}<>.,;:!?-_*#«»¿¡"


def features(word: str) -> list[str]:
    word = word.strip(STRIP)
    return [word, *(f"{word[:n]}+" for n in (4, 5, 6, 7, 8) if len(word) > n)] if word else []


def _sentences(texts, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all sentences (each once a sentence), where sentences end, and where documents end. A text without sentences has an empty one."""
    flat, s_ends, d_ends = array("i"), array("q", [0]), array("q", [0])
    for text in texts:
        for s in [s for s in SENTENCE.findall(text.lower()) if not s.isspace()] or [""]:
            flat.extend(set().union(*(known[w] for w in s.split() if w in known)))
            s_ends.append(len(flat))
        d_ends.append(len(s_ends) - 1)
    return np.array(flat, np.int64), np.array(s_ends), np.array(d_ends)


def loss_and_slope(w: np.ndarray, bias: float, flat: np.ndarray, s_ends: np.ndarray, d_ends: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[float, np.ndarray, float]:
    """The mean log loss of documents a to b under noisy-or, without decay, and its slopes by weight and by bias."""
    s0, s1 = d_ends[a], d_ends[b]
    f = flat[s_ends[s0] : s_ends[s1]]
    of_s = np.repeat(np.arange(s1 - s0), np.diff(s_ends[s0 : s1 + 1]))
    of_d = np.repeat(np.arange(b - a), np.diff(d_ends[a : b + 1]))
    z = bias + np.bincount(of_s, w[f], s1 - s0)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    log_clean = np.bincount(of_d, np.log1p(-np.minimum(p, 1 - 1e-12)), b - a)
    clean = np.exp(log_clean)
    loss = -np.where(y[a:b] > 0, np.log(np.maximum(1 - clean, 1e-9)), log_clean).mean() if b > a else 0.0
    pull = np.where(y[a:b] > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)  # of the loss, by a sentence's logit, over its score
    g_s = pull[of_d] * p / (b - a)
    return loss, np.bincount(f, g_s[of_s], len(w)), g_s.sum()


def _fit(table: pd.DataFrame) -> pd.DataFrame:
    """text, toxic -> feature, weight; the bias has the empty feature."""
    release()
    # Documents that have a word, and toxic ones among them in the high bits; then the same by feature, of words that toxic documents have.
    seen: dict[str, int] = {}
    for text, toxic in zip(table["text"], table["toxic"], strict=True):
        for word in set(text.lower().split()):
            seen[word] = seen.get(word, 0) + 1 + (int(toxic) << 32)
    tally = {f: 0 for word, n in seen.items() if n >> 32 for f in features(word)}
    for word, n in seen.items():
        for f in features(word):
            if f in tally:
                tally[f] += n
    share = float(table["toxic"].mean()) if len(table) else 0.0
    counts = ((f, n & 0xFFFFFFFF, n >> 32) for f, n in tally.items())
    names = [f for f, df, hit in counts if hit >= LEAST_DOCS and hit - df * share >= LEAST_Z * math.sqrt(df * share * (1 - share) + 1e-9)]
    index = {f: i for i, f in enumerate(names)}
    known = {word: ids for word in seen if (ids := [index[f] for f in features(word) if f in index])}
    data, y = _sentences(table["text"], known), table["toxic"].to_numpy(np.float64)
    w, bias = np.zeros(len(names)), START
    sq_w, sq_b = np.full(len(names), 1e-8), 1e-8
    step = max(1, min(256, len(y) // 8))
    for _ in range(EPOCHS):
        for a in range(0, len(y), step):
            _, g, g_bias = loss_and_slope(w, bias, *data, y, a, min(a + step, len(y)))
            g = g + DECAY * w
            sq_w += g * g
            w -= RATE * g / np.sqrt(sq_w)
            sq_b += g_bias**2
            bias -= 0.1 * RATE * g_bias / math.sqrt(sq_b)
    strong = [(f, x) for f, x in zip(names, w.tolist(), strict=True) if abs(x) > 0.01]
    return pd.DataFrame({"feature": ["", *(f for f, _ in strong)], "weight": [bias, *(x for _, x in strong)]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """labelled (doc_id, text, toxic) -> feature, weight. Rows without a label are left out; null texts count as empty."""
    chosen = labelled.where(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"))
    chosen = chosen.orderBy("order", "text").limit(sample)
    return chosen.groupBy(F.lit(0).alias("all")).applyInPandas(lambda t: _fit(t.sort_values(["order", "text"])), "feature string, weight double")


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.bias, self.words = weights, weights.get("", START), {}

    def word(self, word: str) -> float:
        get = self.weights.get
        found = sum(get(f, 0.0) for f in features(word))
        if len(self.words) < MEMO:
            self.words[word] = found
        return found

    def sentence(self, text: str) -> float:
        """The summed weights of the distinct words; a feature that several words share counts once."""
        known, hot = self.words.get, []
        for w in set(text.split()):
            v = known(w)
            if v is None:
                v = self.word(w)
            if v:
                hot.append(w)
        if len(hot) < 2:
            z = self.bias + (self.words.get(hot[0]) or self.word(hot[0])) if hot else self.bias
        else:
            z = self.bias + sum(self.weights.get(f, 0.0) for f in set().union(*map(features, hot)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and the sentences (start, end, score) that are more likely toxic than not."""
        clean, spans, at = 0.0, [], 0
        low = text.lower()
        for m in SENTENCE.finditer(low):
            if m[0].isspace():
                continue
            p = self.sentence(m[0])
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                spans.append((m.start(), m.end(), p))
        return max(0.0, -math.expm1(clean)), spans


def _score(key: str, shared, text_col: str, keep: bool, names: tuple[str, str]):
    def score(batches):
        scorer = held(("toxicity", key), lambda: Scorer(shared.value))
        for batch in text_slices(batches, text_col):
            got = [scorer.document(t or "") for t in batch.column(text_col).to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in got], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "score": pa.float64()})))
            kept = [c for c in batch.schema.names if keep or c != text_col]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([p for p, _ in got], pa.float64()), spans], [*kept, *names])

    return score


def score(spark: SparkSession, docs: DataFrame, model: DataFrame, keep: bool = False, names: tuple[str, str] = (SCORE, SPANS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, toxicity and toxic_spans (start, end, score of the offending sentences, in characters of the lower-cased text) for each row.

    With keep, all columns of docs instead of doc_id alone; columns of docs named as the two new ones are replaced. Empty and null texts get
    the score of no sentence at all, 0. An empty table gives an empty result. The model has a row for each feature that the bounded sample
    supports, so it may be sent to all executors.
    """
    weights = {r["feature"]: r["weight"] for r in model.collect()}
    key = str(zlib.crc32(repr(sorted(weights.items())).encode()))
    docs = docs.drop(*names) if keep else docs.select(id_col, text_col)
    # Columns go through the tasks by number: mapInArrow takes no name with a dot.
    at, kept = {c: f"c{i}" for i, c in enumerate(docs.columns)}, [f for f in docs.schema if keep or f.name != text_col]
    fields = [f"{at[f.name]} {f.dataType.simpleString()}" for f in kept]
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    scored = numbered.mapInArrow(_score(key, spark.sparkContext.broadcast(weights), at[text_col], keep, ("score", "spans")), ", ".join([*fields, "score double", "spans array<struct<start:int,end:int,score:double>>"]))
    return scored.toDF(*[f.name for f in kept], *names)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents that may be learnt from; chosen before their texts are fetched.

    Rows without label or doc_id, and those held out, are left out; of several labels of a document the largest holds. Documents that repeat a doc_id
    count each. Empty tables give an empty result.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounded = known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(SAMPLE)
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id")


def op10_noisy_or(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score(spark, docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
