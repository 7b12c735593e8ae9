"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One scan turns each text into its SHA-256. The rows are kept in units of up to UNIT documents, as one row with the hashes in ascending
   order. Large tables join units to larger ones, so that units times owners, the most messages there can be, stay below the number of documents.
2. The fingerprint is the hash's leading bits: SPARE more than the number of documents needs, so about one unique text in 2**SPARE is suspected.
   A unit sends its distinct fingerprints to their owners (the leading bits choose the owner),
   as Golomb-Rice codes of the gaps. Owners answer with a bitmap of those that other units sent too.
3. Documents whose fingerprint is repeated, by bitmap or within their unit, are suspects. Only their texts are
   shuffled, combined before the shuffle, and compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import ascii_lower, only, small, staged, text_slices

UNIT = 1 << 15
OWNER_ROWS = 1 << 18
SPARE = 8


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 -> (bits of a remainder, code). Gaps: unary quotients, then plain remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(gaps[-1] if len(gaps) == 1 else (int(values[-1]) // len(values))).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :] if k else np.zeros((0, 0), np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(bits.reshape(-1)).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    tail = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - k :] = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k)
        gaps |= np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _unit(number: int, ids: list, shas: list) -> pa.RecordBatch:
    raw = np.frombuffer(b"".join(shas), np.uint8).reshape(-1, 32)
    order = np.argsort(np.ascontiguousarray(raw[:, :8]).view(">u8").reshape(-1), kind="stable")
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([raw[order].tobytes()], pa.binary())], ["unit", "ids", "shas"]
    )


def _hash(batches):
    part, n, ids, shas = TaskContext.get().partitionId(), 0, [], []
    for batch in text_slices(batches, "text"):
        texts = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary())
        ids += batch.column("doc_id").to_pylist()
        shas += [hashlib.sha256(t).digest() for t in texts.to_pylist()]
        while len(ids) >= UNIT:
            yield _unit(part << 32 | n, ids[:UNIT], shas[:UNIT])
            n, ids, shas = n + 1, ids[UNIT:], shas[UNIT:]
    if ids:
        yield _unit(part << 32 | n, ids, shas)


def _join_units(table: pa.Table) -> pa.Table:
    ids = [i for x in table.column("ids").to_pylist() for i in x]
    shas = b"".join(table.column("shas").to_pylist())
    return pa.Table.from_batches([_unit(table.column("sender")[0].as_py(), ids, [shas[i : i + 32] for i in range(0, len(shas), 32)])])


def _fingerprints(shas: bytes, width: int) -> np.ndarray:
    """The leading width bits (64 at most) of each hash."""
    whole = np.ascontiguousarray(np.frombuffer(shas, np.uint8).reshape(-1, 32)[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
    return whole >> np.uint64(64 - width)


def _send(width: int, owner_bits: int):
    low = np.uint64(width - owner_bits)

    def send(batches):
        for batch in batches:
            out = []
            for unit, shas in zip(batch.column("unit").to_pylist(), batch.column("shas").to_pylist(), strict=True):
                fps = np.unique(_fingerprints(shas, width))
                owner = (fps >> low).astype(np.int64)
                for block in np.split(fps, np.flatnonzero(np.diff(owner)) + 1):
                    o = int(block[0] >> low)
                    k, code = golomb_encode(block - (np.uint64(o) << low))
                    out.append((o, unit, len(block), k, code))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["owner", "unit", "n", "k", "code"])

    return send


def _answer(table: pa.Table) -> pa.Table:
    """One owner: a bitmap for each unit that sent a fingerprint which another unit sent too."""
    rows = table.select(["owner", "unit", "n", "k", "code"]).to_pylist()
    lists = [golomb_decode(r["n"], r["k"], r["code"]) for r in rows]
    values = np.concatenate(lists)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    marks = np.split(counts[inverse] > 1, np.cumsum([len(x) for x in lists])[:-1])
    got = [(r["unit"], r["owner"], np.packbits(m).tobytes()) for r, m in zip(rows, marks, strict=True) if m.any()]
    return pa.table([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["unit", "owner", "bits"])


def _suspects(width: int, owner_bits: int):
    """Units with their bitmaps -> a row for each document, with its hash and whether it is suspected."""

    def suspects(batches):
        for batch in batches:
            for ids, shas, marks in zip(batch.column("ids").to_pylist(), batch.column("shas").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                fps, inverse, counts = np.unique(_fingerprints(shas, width), return_inverse=True, return_counts=True)
                hit, owner = counts > 1, (fps >> np.uint64(width - owner_bits)).astype(np.int64)
                for m in marks or ():
                    at = np.searchsorted(owner, [m["owner"], m["owner"] + 1])
                    hit[at[0] : at[1]] |= np.unpackbits(np.frombuffer(m["bits"], np.uint8))[: at[1] - at[0]].astype(bool)
                hexes = pa.array([shas[i : i + 32].hex() for i in range(0, len(shas), 32)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), hexes, pa.array(hit[inverse])], ["doc_id", "text_sha256", "suspect"])

    return suspects


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return a row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z only; null counts as empty, so null and empty
    texts are one group. Of a group the largest doc_id stays; rows that repeat both its doc_id and text are all kept.
    A null doc_id is smaller than any other. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = staged(docs.mapInArrow(_hash, "unit long, ids array<long>, shas binary"), "exact-units")
    n = int(units.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])
    # Of a unit and of an owner, in documents: their product grows with n, so messages (n / unit * n / owner) do no more than n.
    even = 1 << (64 * n).bit_length() // 2
    if even > UNIT:
        dealt = units.withColumn("sender", F.pmod(F.xxhash64("unit"), F.lit(max(1, n // even))))
        units = staged(dealt.groupBy("sender").applyInArrow(_join_units, "unit long, ids array<long>, shas binary"), "exact-joined-units")
    owner_bits = max(6, (n // max(OWNER_ROWS, even)).bit_length())
    width = min(64, max(owner_bits + 1, n.bit_length() + SPARE))
    sent = units.select("unit", "shas").mapInArrow(_send(width, owner_bits), "owner long, unit long, n int, k int, code binary")
    marks = sent.groupBy("owner").applyInArrow(_answer, "unit long, owner long, bits binary")
    marks = marks.groupBy("unit").agg(F.collect_list(F.struct("owner", "bits")).alias("marks"))
    rows = units.join(marks, "unit", "left").select("ids", "shas", "marks").mapInArrow(_suspects(width, owner_bits), "doc_id long, text_sha256 string, suspect boolean")
    rows = staged(rows, "exact-rows")
    suspects = staged(rows.where("suspect").select("doc_id").distinct(), "exact-suspects")
    texts = only(docs, suspects, "doc_id").select("doc_id", ascii_lower(F.col("text")).alias("text"))
    groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = small(staged(groups.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups"))
    alone = rows.where("NOT suspect").select("doc_id", "text_sha256", F.lit(None).cast("bigint").alias("keep_id"), F.lit(None).cast("bigint").alias("group_size"))
    found = rows.where("suspect").drop("suspect").join(groups, "text_sha256", "left").select(alone.columns).unionAll(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


def op4_golomb_exact(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
