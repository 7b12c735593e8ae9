"""Tables that a job reads several times, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of a few numbers a row with at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a few short columns that one task groups; Spark's own parts are of 64 MB compressed, which hold several millions.
TASK_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session that names none, as in tests, gets a folder of this machine; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read back: it is computed once, and lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, a staged narrow table, marked for broadcast if its counted rows are few; else Spark chooses."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def parts(spark: SparkSession, rows: int, most: int = TASK_ROWS) -> int:
    """Into how many parts to divide rows, so that the memory of a task that groups one does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))
