"""Token counts, token files and packing against the tokenizers library."""

import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import common, packing, tokcount, tokenfile, tokens

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "the", " The", "'", "'s", "'re", " ", "  ", "\n", "\t", "é", "É", "ß", "1", "23", ".", ",", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "日本", "🙂", "\xa0", " ", "\x1c", "\x85", "Hello", "ing", "'LL", "Σ", "İ", "-----", "thedtiou"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=25).filter(lambda s: s.isprintable())


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts_of_all_prefixes(text):
    got = np.cumsum(np.frombuffer(tokcount.counter().changes(text), np.int8), dtype=int).tolist()
    assert got == [len(BYTE.encode(text[:n], add_special_tokens=False).ids) for n in range(1, len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_ids(text):
    got = np.frombuffer(tokens.encoder().encode([text.encode()])[0], "<u4").tolist()
    assert got == WORD.encode(text, add_special_tokens=False).ids


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    monkeypatch.setattr(tokcount, "MEMO", 5)
    text = "the Quick brown fox, jumped over. the lazy dogs! the fox " * 3
    coder, counter = tokens.WordEncoder("word_bpe_49k.json"), tokcount.PrefixCounter("byte_bpe_50k.json")
    for _ in range(2):
        assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == WORD.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(counter.changes(text), np.int8).sum() == len(BYTE.encode(text, add_special_tokens=False).ids)
    assert len(coder) <= 5


def test_counts_answer_truncation(odd, none):
    df = tokcount.token_counts(odd.where("doc_id IN (1, 10)"))
    rows = df.select("doc_id", tokcount.tokens_in("prefix_counts", 9).alias("t"), tokcount.chars_within("prefix_counts", 5).alias("c")).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        assert r.t == len(BYTE.encode(text[r.doc_id][:9], add_special_tokens=False).ids)
        assert r.c == max(n for n in range(40) if len(BYTE.encode(text[r.doc_id][:n], add_special_tokens=False).ids) <= 5)
    assert tokcount.token_counts(none).count() == 0
    nulls = df.select(F.lit(None).cast("binary").alias("prefix_counts")).limit(1)
    assert nulls.select(tokcount.tokens_in("prefix_counts", 9), tokcount.chars_within("prefix_counts", 5)).collect() == [(None, None)]


def test_counts_of_odd_rows(odd):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokcount.token_counts(odd).collect())
    assert got == sorted((str(r.doc_id), len((r.text or "").encode()), len(BYTE.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())


def ids_of(text):
    return WORD.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file_rows", [8192, 3])
def test_token_file(spark, odd, none, tmp_path, file_rows):
    docs = odd.where("doc_id IS NULL OR doc_id != 7")
    tokenfile.write_token_file(docs, str(tmp_path / "orc"), file_rows=file_rows)
    stored = tokenfile.read_token_file(spark, str(tmp_path / "orc"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_file_index(stored).collect())
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id):
        ids = [*ids_of(r.text), 2]
        want.append((at, r.doc_id, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    tokenfile.write_token_file(none, str(tmp_path / "none"))
    assert tokenfile.token_file_index(tokenfile.read_token_file(spark, str(tmp_path / "none"))).count() == 0


def scanned(df):
    """Rows that the scan handed on."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_stripes_row_indexes_and_bloom_filters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "STRIPE_BYTES", 1 << 16)
    monkeypatch.setattr(tokenfile, "LEAST_ROWS", 10_000)
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("some words "), F.xxhash64("id")).alias("text"))
    tokenfile.write_token_file(docs.coalesce(1), str(tmp_path / "orc"), file_rows=10_000)
    files = [orc.ORCFile(f) for f in sorted((tmp_path / "orc").glob("*.orc"))]
    assert len(files) >= 2 and sum(f.nrows for f in files) == 20_000
    assert all(f.nstripes >= 3 and f.row_index_stride == 1000 and f.compression == "SNAPPY" for f in files)
    # Integer run-length encoding, then compression: below the four bytes of an id.
    plain = sum(r.n_ids for r in tokenfile.read_token_file(spark, str(tmp_path / "orc")).select("n_ids").collect()) * 4
    assert sum(f.stat().st_size for f in (tmp_path / "orc").glob("*.orc")) < 0.8 * plain
    stored = tokenfile.read_token_file(spark, str(tmp_path / "orc"))
    # One row group, by minimum and maximum; none, by the Bloom filter, for an id between those stored.
    assert 1 <= scanned(stored.where("doc_id = 20000")) <= 1000
    assert min(scanned(stored.where(f"doc_id = {n}")) for n in (20_001, 20_003, 20_005)) == 0
    # Stripes are read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 17))
    try:
        parts = tokenfile.read_token_file(spark, str(tmp_path / "orc")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) > len(files) and sum(r["count"] for r in parts) == 20_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=40))
def test_bin_completion_holds_all_within_capacity(lengths):
    bins = packing.complete_bins(lengths, 100)
    assert sorted(n for b in bins for n in b) == sorted(lengths) and all(sum(b) <= 100 for b in bins)
    assert -(-sum(lengths) // 100) <= len(bins) <= len(packing.best_fit(sorted(lengths, reverse=True), 100))


def optimum(lengths, capacity):
    """The fewest sequences, by dynamic programming over all subsets: (sequences, room used in the last)."""
    best = {0: (1, 0)}
    for done in range(1 << len(lengths)):
        bins, used = best[done]
        for i, n in enumerate(lengths):
            if not done >> i & 1:
                new = (bins, used + n) if used + n <= capacity else (bins + 1, n)
                best[done | 1 << i] = min(best.get(done | 1 << i, (99, 0)), new)
    return best[(1 << len(lengths)) - 1][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(8, 60), min_size=1, max_size=10))
def test_bin_completion_is_optimal(lengths):
    assert len(packing.complete_bins(lengths, 100, budget=None)) == optimum(lengths, 100)


def test_bin_completion_beats_best_fit():
    """Random cases in which best fit is not optimal, with every one solved to the optimum."""
    rng, beaten = np.random.default_rng(4), 0
    for _ in range(400):
        lengths = rng.integers(10, 55, 10).tolist()
        greedy, best = len(packing.best_fit(sorted(lengths, reverse=True), 100)), optimum(lengths, 100)
        beaten += greedy > best
        assert len(packing.complete_bins(lengths, 100, budget=None)) == best
    assert beaten >= 5
    exact = [60, 50, 30, 20, 20, 20]  # best fit: 60+30, 50+20+20, 20; completed: 60+20+20, 50+30+20
    assert len(packing.best_fit(sorted(exact, reverse=True), 100)) == 3 and len(packing.complete_bins(exact, 100)) == 2
    # Hundreds of pieces, packed without any waste.
    big = [n for _ in range(40) for n in (44, 33, 23)] + [n for _ in range(40) for n in (47, 36, 17)]
    assert len(packing.complete_bins(big, 100)) == 80


def listed(sizes, room):
    count = {n: sizes.count(n) for n in sizes}
    return list(packing.fillings(sorted(count), count, room, lambda: room, lambda n: None))


def test_fillings_are_undominated_and_complete():
    assert listed([8, 9], 10) == [(1, (9,))]
    assert listed([5, 5, 10], 10) == [(0, (10,))]
    assert listed([1] * 4000, 4000) == [(0, (1,) * 4000)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes, room = rng.integers(1, 30, 7).tolist(), int(rng.integers(10, 60))
        subsets = {tuple(sorted((sizes[i] for i in range(7) if m >> i & 1), reverse=True)): m for m in range(1 << 7)}
        fit = [f for f in subsets if sum(f) <= room]

        def better(f):
            """Whether some pieces of f could be exchanged for one other piece that is larger, or as large as several."""
            rest = [n for i, n in enumerate(sizes) if not subsets[f] >> i & 1]
            parts = [[f[i] for i in range(len(f)) if m >> i & 1] for m in range(1 << len(f))]
            return any(sum(f) - sum(p) + x <= room and (x > sum(p) or (len(p) > 1 and x == sum(p))) for p in parts for x in rest)

        assert sorted(f for _, f in listed(sizes, room)) == sorted(f for f in fit if not better(f))


def test_packing_of_odd_rows(odd, none):
    df = packing.pack(odd, with_ids=True).persist()
    rows = df.collect()
    pieces, bins = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 4096
    for r in odd.collect():
        got = sorted(pieces[r.doc_id])
        if r.doc_id != 7:
            assert sum((ids for _, _, ids in got), []) == [*ids_of(r.text), 1] and [s for _, s, _ in got] == [4096 * i for i in range(len(got))]
    assert len(pieces[7]) == 2 * len(pieces[6]) and len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert {(r.sequence_id, len(r.ids) // 4) for r in packing.sequences(df).collect()} == {(k, sum(n for _, n in b)) for k, b in bins.items()}
    assert packing.waste(df).first().sequences == len(bins)
    assert packing.pack(none).count() == 0


def test_waiting_searches_of_a_block_hold_no_tables():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1200, 1500, 3000).tolist()
    tracemalloc.start()
    try:
        bins = packing.complete_bins(lengths, 4096, budget=60_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(n for b in bins for n in b) == sorted(lengths) and max(map(sum, bins)) <= 4096
    assert peak < 12 << 20


def test_a_packing_worker_gives_its_tokenizer_back(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing._pieces(tokens.WORD_TOKENIZER, 1, 4096, False)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})])
    assert next(run).num_rows == 1 and common._held
    assert not list(run) and not common._held
