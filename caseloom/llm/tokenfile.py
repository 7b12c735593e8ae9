"""Token ids as ORC: integer run-length encoding in stripes, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, so each file holds one range in ascending order, in several stripes that can be read in parallel; a reader that wants
some documents skips files, stripes and row groups by their minimum and maximum, and by the Bloom filter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import shared_path, text_slices
from caseloom.llm.tokens import WORD_TOKENIZER, encoder

END_ID = 2
#: Documents of a file; smaller tables are spread over TASKS files for each core instead, of at least LEAST_ROWS.
FILE_ROWS, LEAST_ROWS, TASKS = 65_536, 4_096, 4
#: Encoded bytes of a stripe, rows after which they are counted, rows of an index entry and of a Bloom filter.
STRIPE_BYTES, CHECK_ROWS, STRIDE = 2 << 20, 500, 1_000
COLUMNS = "doc_id long, part int, n_ids int, ids array<int>"


def _encode(tokenizer: str, end: int):
    def encode(batches):
        coder, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in text_slices(batches, "text"):
            coded = coder.encode(batch.column("text").cast(pa.binary()).to_pylist())
            flat = np.frombuffer(b"".join([c + last for c in coded]), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(c) // 4 + 1 for c in coded)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(ends)), lists], ["doc_id", "part", "n_ids", "ids"])

    return encode


def write_token_file(docs: DataFrame, path: str, tokenizer: str = WORD_TOKENIZER, end: int = END_ID, file_rows: int = FILE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, part, n_ids and ids (array<int>, with the end id) of every row as ORC.

    Null texts count as empty and hold the end id alone. Rows without doc_id come first; rows that repeat a
    doc_id are in the order of their texts' hashes. Texts are whole; other columns are left out. An empty table leaves a readable table without rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n, cores = docs.count(), docs.sparkSession.sparkContext.defaultParallelism
    ranged = docs.repartitionByRange(max(1, -(-n // file_rows), min(n // LEAST_ROWS, TASKS * cores)), *order).sortWithinPartitions(*order)
    coded = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(tokenizer, end), COLUMNS)
    layout = {
        "orc.compress": "SNAPPY", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
        "orc.stripe.size": str(STRIPE_BYTES), "orc.rows.between.memory.checks": str(CHECK_ROWS),
    }
    coded.write.options(**layout).orc(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).orc(path)


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        raw = memoryview(flat.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column("text_order")], ["doc_id", "part", "n_tokens", "ids_crc32", "text_order"])


def token_file_index(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a token file, in its order: null doc_ids first, repeated ones in the order they are stored. An empty file has none.

    Starts are running sums within a part plus what all earlier parts hold, so no task orders more than a part.
    """
    got = stored.select("doc_id", "part", "ids", F.monotonically_increasing_id().alias("text_order")).mapInArrow(_digest, "doc_id long, part int, n_tokens long, ids_crc32 long, text_order long")
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("held"))
    parts = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_order").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return got.join(parts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_orc_tokens(spark, sf_dir):
    path = shared_path(spark, "tokens-orc")
    write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_file_index(read_token_file(spark, path))
