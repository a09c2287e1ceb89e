"""A graph's tables bucketed by the keys that its queries join on, so that they meet without a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"weftline_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """df as Parquet below path, dealt over buckets by key and sorted by it in each, and as the session reads it back.

    Rows are brought together by key first, so each bucket is one file.
    """
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))
    return df.sparkSession.table(_name(path))


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Takes a table off the session's catalogue; its files stay and read as plain Parquet."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")


@contextmanager
def bucketed_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(nodes by node_id, edges by src) in as many buckets each: a node meets its own edges without a shuffle, and an aggregate by src needs none.

    Inside the block queries may be made and run; after it the files are still there, the tables are not.
    """
    spark = nodes.sparkSession
    try:
        yield write_bucketed(nodes, f"{path}/nodes", "node_id", buckets), write_bucketed(edges, f"{path}/edges", "src", buckets)
    finally:
        for name in ("nodes", "edges"):
            forget_bucketed(spark, f"{path}/{name}")
