"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most this many rows (of a few numbers each) may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a folder of this machine; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, such as the last round's of a loop."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, a staged table of a few numbers a row, marked for broadcast if its counted rows are few; Spark's own choice otherwise.

    For joins of narrow tables only. Where the other side holds texts, see only() and without().
    """
    return F.broadcast(df) if df.count() <= limit else df


#: A Bloom filter is a table of 64-bit words, one for every KEYS_A_WORD keys and WORDS at most (32 MB). A fuller filter lets more rows pass, and loses none.
KEYS_A_WORD, WORDS, LEAST_WORDS = 4, 1 << 21, 1 << 10


def _bloom(ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The filter of the staged ids' keys, to broadcast, and the condition that a row of another table with column key may be among them."""
    words = min(WORDS, max(LEAST_WORDS, 1 << (ids.count() // KEYS_A_WORD).bit_length()))
    h = F.xxhash64(key)
    word = F.pmod(h, F.lit(words))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`), {at}) & 63 as int))") for at in (40, 46, 52, 58)]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    table = ids.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits"))
    return F.broadcast(table), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(mask) == mask)


def may_be_among(df: DataFrame, ids: DataFrame, key: str, other: bool = False) -> DataFrame:
    """Rows of df whose key may be one of the staged ids' (surely those whose key is, nulls too); with other, all others.

    So a semi- or anti-join moves only the rows that matter, whatever their number; the filter's size is bounded, and nothing else is sent around.
    """
    table, there = _bloom(ids, key)
    return df.join(table, there, "left_anti" if other else "left_semi")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among the staged ids (a null key: if a null is). Texts of other rows don't move."""
    return may_be_among(df, ids, key).join(ids.select(F.col(key).alias("__id")), F.col(key).eqNullSafe(F.col("__id")), "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among the staged ids. Only rows whose key may be are joined; the others pass as they are."""
    doubtful = may_be_among(df, ids, key).join(ids.select(F.col(key).alias("__id")), F.col(key) == F.col("__id"), "left_anti")
    return may_be_among(df, ids, key, other=True).unionByName(doubtful)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_held: dict = {}


def held(key, build):
    """What this Python worker keeps between tasks: one thing at a time, so that the stages of a long job don't add up."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Give back what was kept, before a task that needs its memory for something else, and what the C library holds of it."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function of a task's batches, with the worker's memory given back before it and after it, so that workers that wait hold little."""

    @functools.wraps(run)
    def lean_run(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def text_slices(batches, column: str, most: int = 2_000_000):
    """Cut Arrow batches into slices of some megabytes of text, so that one batch of long texts stays small."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n) + 64
        if start < batch.num_rows:
            yield batch.slice(start)
