"""Inputs of the registered queries, derived from the pages, documents and star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id of a search term beside the documents.
TERM_ID = -1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives: a text with two URLs for each page; projects are pages."""
    say = F.concat(F.lit("Track "), F.col("url"), F.lit(" and "), F.col("url"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("project_id"), say.alias("text"))


def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search answer with two results for each page."""
    result = lambda title: F.struct(F.lit(title).alias("title"), F.col("url"), F.lit("d").alias("description"))
    body = F.to_json(F.struct(F.struct(F.lit("search").alias("type"), F.array(result("first"), result("second")).alias("results")).alias("web")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("search_id"), body.alias("body"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about documents from the labels: every seventh has two items (and must fail), every fifth no fence."""
    k = F.col("doc_id")
    value = F.to_json(F.struct((F.col("quality") == 1).alias("is_relevant"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reason"), F.when(F.col("quality") == 1, F.concat(F.lit("doc "), k.cast("string"))).alias("insight_if_classified_as_relevant")))
    said = F.when(k % 5 == 0, value).otherwise(F.concat(F.lit("```json\n"), value, F.lit("\n```")))
    item = F.struct(F.lit("text").alias("type"), said.alias("text"))
    content = F.when(k % 7 == 0, F.array(item, item)).otherwise(F.array(item))
    return table(spark, sf_dir, "labels").select(k.alias("page_id"), F.to_json(F.struct(F.lit("m").alias("id"), content.alias("content"))).alias("answer"))


def robots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """A robots file for each domain but those that begin with ``m.``; of names with an even length it is empty."""
    rules = "User-agent: *\nDisallow: /en/ # English\nAllow: /en/6*\n\nUser-agent: other\nUser-agent: more\nDisallow: /"
    hosts = links.select("domain").distinct().where(~F.col("domain").startswith("m."))
    return hosts.select("domain", F.when(F.length("domain") % 2 == 0, "").otherwise(rules).alias("contents"))


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as parts of pages."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("page_id", "pos", "text")


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("docs").alias("project_id"), F.col("doc_id").alias("node_id"), F.array(F.lit("Paragraph"), F.lit("Partial")).alias("labels"), "text")


def search_term_node(spark: SparkSession, term: str) -> DataFrame:
    return spark.createDataFrame([("docs", TERM_ID, ["SearchTerm"], term)], "project_id string, node_id long, labels array<string>, text string")


def metadata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose heads carry metadata of many kinds, made from page ids."""
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<html><head><meta property="og:title" content="T'), n, F.lit('"><title>Other</title><meta name="description" content="one"><meta name="description" content="two '), n,
        F.lit('"><meta name="keywords" content="a, b"><meta property="article:tags" content="c"><link rel="shortcut icon" href="/i.ico"><meta property="og:image:width" content="1200"><meta property="og:image" content="/img/'), n,
        F.lit('.png"><meta property="og:image" content="/late.png"><meta property="og:site_name" content="S'), n, F.lit('"><meta name="author" content=""><meta name="author" content="A"></head><body></body></html>'),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("url"), html.alias("html"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a request log."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("domain"), F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"))
