"""A graph made from the star-schema tables, in Spark and as SQL, for the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"
CUSTOMER, SUPPLIER, PART, ORDER = 10_000_000, 20_000_000, 30_000_000, 100_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, node_id: Column, labels: Column, text: Column, path: Column, flags: Column, at: Column | None = None) -> DataFrame:
        link = F.when(path.isNotNull(), F.struct(path.alias("path"), none.alias("query")))
        return df.select(F.lit("tg").alias("project_id"), node_id.cast("long").alias("node_id"), labels.alias("labels"), text.alias("text"), link.alias("link"), flags.cast("int").alias("flags"), (F.lit(START).cast("timestamp") if at is None else at.cast("timestamp")).alias("written_at"))

    named = lambda *labels: F.array(*map(F.lit, labels))
    zero, c = F.lit(0), F.col
    kind = F.when(c("p_partkey") % 3 == 0, "Title").when(c("p_partkey") % 3 == 1, "Heading").otherwise("Paragraph")
    return reduce(DataFrame.unionByName, [
        rows(t("region"), c("r_regionkey"), named("AddedByUser", "Objective"), c("r_name"), none, zero),
        rows(t("nation"), 1000 + c("n_nationkey"), named("DomainName"), F.concat(F.lower("n_name"), F.lit(".example")), none, c("n_nationkey") % 16),
        rows(t("nation").where("n_nationkey % 2 = 0"), 2000 + c("n_nationkey"), named("RobotsTxt"), F.lit("User-agent: *"), none, c("n_nationkey") % 16),
        rows(t("customer"), CUSTOMER + c("c_custkey"), named("Link"), none, F.concat(F.lit("/c/"), c("c_custkey").cast("string")), c("c_custkey") % 16),
        rows(t("supplier"), SUPPLIER + c("s_suppkey"), named("AddedByWebSearch", "Link"), none, F.concat(F.lit("/s/"), c("s_suppkey").cast("string")), c("s_suppkey") % 16),
        rows(t("orders"), ORDER + c("o_orderkey"), named("Content", "WebPage"), c("o_orderpriority"), none, c("o_orderkey") % 16, c("o_orderdate")),
        rows(t("part"), PART + c("p_partkey"), F.array(kind, F.lit("Partial")), c("p_name"), none, zero),
    ])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, label, inverse, row, k1, k2): the edge pairs; row and keys give the order of a source's edges."""
    t = lambda name: _table(spark, sf_dir, name)
    c = F.col

    def rows(df: DataFrame, a: Column, b: Column, label: str, inverse: str, row: int, k1: Column, k2: Column | None = None) -> DataFrame:
        return df.select(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(label).alias("label"), F.lit(inverse).alias("inverse"), F.lit(row).alias("row"), k1.cast("long").alias("k1"), (F.lit(0) if k2 is None else k2).cast("long").alias("k2"))

    supplied = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    even = t("nation").where("n_nationkey % 2 = 0")
    return reduce(DataFrame.unionByName, [
        rows(t("nation"), c("n_regionkey"), 1000 + c("n_nationkey"), "Suggests", "SuggestedFor", 1, c("n_nationkey")),
        rows(supplied, c("n_regionkey"), SUPPLIER + c("s_suppkey"), "Suggests", "SuggestedFor", 2, c("s_suppkey")),
        rows(even, 1000 + c("n_nationkey"), 2000 + c("n_nationkey"), "OwnerOf", "BelongsTo", 3, c("n_nationkey")),
        rows(t("customer"), 1000 + c("c_nationkey"), CUSTOMER + c("c_custkey"), "OwnerOf", "BelongsTo", 4, c("c_custkey")),
        rows(t("supplier"), 1000 + c("s_nationkey"), SUPPLIER + c("s_suppkey"), "OwnerOf", "BelongsTo", 5, c("s_suppkey")),
        rows(t("orders"), CUSTOMER + c("o_custkey"), ORDER + c("o_orderkey"), "PathOf", "ContentOf", 6, c("o_orderkey")),
        rows(t("lineitem"), ORDER + c("l_orderkey"), PART + c("l_partkey"), "ParentOf", "ChildOf", 7, c("l_linenumber"), c("l_partkey")),
    ])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    both = p.select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "label", "row", "k1", "k2"),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("inverse").alias("label"), "row", F.col("a").alias("k1"), F.lit(0).cast("long").alias("k2")),
    )).alias("e")).select("e.*")
    pos = F.row_number().over(Window.partitionBy("src").orderBy("row", "k1", "k2"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + (F.col("src") + F.col("dst")) % 365 * 86400)
    return both.select(F.lit("tg").alias("project_id"), "src", pos.alias("pos"), "dst", "label", at.alias("written_at"))


NODES_SQL = f"""nodes AS (
  SELECT r_regionkey::BIGINT AS node_id, ['AddedByUser', 'Objective'] AS labels, r_name AS text, NULL::VARCHAR AS path, 0 AS flags, TIMESTAMP '{START}' AS written_at FROM region
  UNION ALL SELECT 1000 + n_nationkey, ['DomainName'], lower(n_name) || '.example', NULL, n_nationkey % 16, TIMESTAMP '{START}' FROM nation
  UNION ALL SELECT 2000 + n_nationkey, ['RobotsTxt'], 'User-agent: *', NULL, n_nationkey % 16, TIMESTAMP '{START}' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT {CUSTOMER} + c_custkey, ['Link'], NULL, '/c/' || c_custkey, c_custkey % 16, TIMESTAMP '{START}' FROM customer
  UNION ALL SELECT {SUPPLIER} + s_suppkey, ['AddedByWebSearch', 'Link'], NULL, '/s/' || s_suppkey, s_suppkey % 16, TIMESTAMP '{START}' FROM supplier
  UNION ALL SELECT {ORDER} + o_orderkey, ['Content', 'WebPage'], o_orderpriority, NULL, o_orderkey % 16, o_orderdate FROM orders
  UNION ALL SELECT {PART} + p_partkey, [CASE p_partkey % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading' ELSE 'Paragraph' END, 'Partial'], p_name, NULL, 0, TIMESTAMP '{START}' FROM part)"""
EDGES_SQL = f"""pairs AS (
  SELECT n_regionkey::BIGINT AS a, 1000 + n_nationkey AS b, 'Suggests' AS label, 'SuggestedFor' AS inverse, 1 AS r, n_nationkey AS k1, 0 AS k2 FROM nation
  UNION ALL SELECT n_regionkey, {SUPPLIER} + s_suppkey, 'Suggests', 'SuggestedFor', 2, s_suppkey, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 1000 + n_nationkey, 2000 + n_nationkey, 'OwnerOf', 'BelongsTo', 3, n_nationkey, 0 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 1000 + c_nationkey, {CUSTOMER} + c_custkey, 'OwnerOf', 'BelongsTo', 4, c_custkey, 0 FROM customer
  UNION ALL SELECT 1000 + s_nationkey, {SUPPLIER} + s_suppkey, 'OwnerOf', 'BelongsTo', 5, s_suppkey, 0 FROM supplier
  UNION ALL SELECT {CUSTOMER} + o_custkey, {ORDER} + o_orderkey, 'PathOf', 'ContentOf', 6, o_orderkey, 0 FROM orders
  UNION ALL SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'ParentOf', 'ChildOf', 7, l_linenumber, l_partkey FROM lineitem),
edges AS (
  SELECT src, row_number() OVER (PARTITION BY src ORDER BY r, k1, k2) AS pos, dst, label, TIMESTAMP '{START}' + to_days(((src + dst) % 365)::INT) AS written_at
  FROM (SELECT a AS src, b AS dst, label, r, k1, k2 FROM pairs UNION ALL SELECT b, a, inverse, r, a, 0 FROM pairs))"""
