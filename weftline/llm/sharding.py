"""Shards as runs of a Hilbert curve through quantised metadata."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from weftline.llm.storage import Scratch, tasks

#: monotonically_increasing_id keeps the row's place in its partition in the low bits.
ROW_BITS = 33
#: Columns that hilbert_shards adds, to its result or on the way.
OWN_COLUMNS = {"curve", "shard", "slot", "_at", "_part", "_n", "_before", "_all", "_rank"}


def curve_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points with ``bits`` bits an axis.

    Skilling's transform ("Programming the Hilbert curve", 2004), on whole columns.
    """
    x = [np.asarray(a, dtype=np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for axis in x:
            out = (out << 1) | (((axis ^ turn) >> bit) & 1)
    return out


def _text_borders(df: DataFrame, names: list[str], steps: list[float], scratch: Scratch) -> dict[str, list[str]]:
    """Quantiles of string columns, exactly, in the order of their UTF-8 bytes.

    Rows are counted by column and value before anything is ordered; the values
    of all columns are range-partitioned together, and counts are cumulated
    inside partitions, on top of the partitions' sums. Only the borders reach the driver.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names))).alias("e")
    values = df.select(each).where("e.value is not null").groupBy("e.name", "e.value").agg(F.count("*").alias("n"))
    ranged = scratch.write(values.repartitionByRange(tasks(df.sparkSession), "name", "value").withColumn("part", F.spark_partition_id()), "values")
    sums = ranged.groupBy("name", "part").agg(F.sum("n").alias("m"))  # a row for each partition and column
    before = sums.select("name", "part", (F.sum("m").over(Window.partitionBy("name").orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("name")).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("name", "part").orderBy("value"))
    upto = ranged.withColumn("inside", inside).join(F.broadcast(before), ["name", "part"]).select("name", "value", ((F.col("before") + F.col("inside")) / F.col("all")).alias("share"))
    found = upto.groupBy("name").agg(*(F.min(F.when(F.col("share") >= s, F.col("value"))).alias(f"q{i}") for i, s in enumerate(steps))).collect()
    scratch.drop("values")
    return {c: [] for c in names} | {r["name"]: [b for b in r[1:] if b is not None] for r in found}


def hilbert_shards(df: DataFrame, key: str, dims: list[str], shards: int, bits: int = 4) -> DataFrame:
    """Adds ``curve`` (place on the Hilbert curve), ``shard`` and ``slot`` to df.

    Every dimension is cut at its quantiles into 2**bits bins (null: bin 0),
    rows are sorted by curve index, key and dimensions, and the sorted rows are
    cut into ``shards`` runs whose row counts differ by one at most. Neighbours
    on the curve are neighbours in all dimensions, so a file of a run has a
    narrow range in each of them and readers skip it by its statistics.

    The sort is one range exchange, with the key as a tie-breaker so that one
    crowded cell spreads over many tasks; only row counts a partition and
    (2**bits - 1) bin borders a dimension reach the driver. Nulls sort first;
    equal rows are interchangeable; an empty table gives no rows. Columns of
    df that are named like one of OWN_COLUMNS are left out; the key and the
    dimensions may not be.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    if taken := OWN_COLUMNS & {key, *dims}:
        raise ValueError(f"a key or dimension may not be named {sorted(taken)}")
    df = df.drop(*OWN_COLUMNS)
    steps = [k / 2**bits for k in range(1, 2**bits)]
    texts = [c for c in dict.fromkeys(dims) if isinstance(df.schema[c].dataType, T.StringType)]
    cuts = _text_borders(df, texts, steps, scratch) if texts else {}
    if numbers := [c for c in dict.fromkeys(dims) if c not in texts]:
        found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(f"q{i}") for i, c in enumerate(numbers))).first()
        cuts |= {c: found[i] or [] for i, c in enumerate(numbers)}
    number = lambda c: F.col(c) if c in texts else F.col(c).cast("double")

    def place(*bins: pd.Series) -> pd.Series:
        return pd.Series(curve_index([b.to_numpy() for b in bins], bits))

    place = F.pandas_udf(place, "long")
    bins = [reduce(add, (F.coalesce(number(c) > F.lit(b), F.lit(False)).cast("long") for b in cuts[c]), F.lit(0).cast("long")) for c in dims]
    at = df.select("*", place(*bins).alias("curve"))
    order = list(dict.fromkeys(["curve", key, *dims]))
    ranged = at.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    placed = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1))
    shard = F.expr(f"(_rank * {shards} + {shards} - 1) div _all")
    first = F.expr(f"(shard * _all) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - first).select(*df.columns, "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in curve order inside it."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of every document, under the ``rows`` law.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32: of the text,
    null as the empty text. Documents with one doc_id are separate rows.
    """
    bare = docs.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"))
    out = hilbert_shards(bare, "doc_id", ["lang", "source", "size", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
