"""Intermediate tables in the folder that the whole cluster shares.

Iterative jobs cut their lineage by writing a table under
``spark.checkpoint.dir`` and reading it again, so a lost executor costs a
re-read, not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.shared import shared_dir


#: Bytes of one batch of rows sent to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of Python workers by bytes (a session setting, changed only from its default): texts are long, and a worker never gives memory back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864", "67108864b"):
        spark.conf.set(name, BATCH_BYTES)


class Scratch:
    """Tables of one job, in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, job: str):
        small_batches(spark)
        self.spark = spark
        self.written: set[str] = set()
        self.root = f"{shared_dir(spark)}/weftline-{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the table as read back (with the same schema, also when empty)."""
        self.written.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but these, once what was made of the others is written."""
        for name in self.written - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.written.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if df, which must be cheap to count, has at most this many (short) rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else by_shuffle(df)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df with the hint that its next join broadcasts neither side.

    Spark takes a table's size from its files and column types: an explode
    counts as one row a row, and well compressed columns as what they take on
    disk, so by size alone it would broadcast gigabytes through the driver.
    """
    return df.hint("merge")
