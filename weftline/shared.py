"""The folder that all executors share, and tables of a job in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task holds as Python objects at once, of what it reads and of what it gives.
ROWS_IN, ROWS_OUT = 64, 1024


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, if it is there."""
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def python_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python values, a few at once."""
    for at in range(0, batch.num_rows, ROWS_IN):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS_IN).columns), strict=True)


def arrow_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size, made while the rows come."""
    for some in batched(rows, ROWS_OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


class Steps:
    """Tables that a job writes to cut its lineage, in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{job}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the table as read back (with the same schema, also when empty)."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, f"{self.root}/{name}")
