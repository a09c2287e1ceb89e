"""A training-corpus pipeline over ``documents``: five stages, each an operator of weftline.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, near_copies, pieces, suffixes
from weftline.llm.storage import Scratch, by_shuffle

#: Shortest repeated passage that is cut, in bytes: below 50 words of any of the languages.
PASSAGE_BYTES = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; texts without letters or a likely language go."""
    return language.in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Near duplicates have a Jaccard similarity of 0.8 or more over five-word
    shingles, exactly; SimHash at a few bits would miss most of them, so its
    candidates are joined by MinHash ones before the exact check. A row is
    named by its doc_id and text, so rows that share the doc_id alone are
    documents of their own; those that share both are copies, of which one
    stays. Rows without a doc_id come after all others in a group.
    """
    name = F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("none")), F.xxhash64("text").cast("string"))
    named = docs.withColumn("_name", name)
    groups = near_copies.copy_groups(named.select(F.col("_name").alias("doc_id"), "text"), shingle=5, percent=80)
    others = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_name")).distinct()
    return by_shuffle(named).join(others, "_name", "left_anti").dropDuplicates(["_name"]).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere, n_chars (if there) with them; a document that loses all of its text, or has none (null or blank), goes."""
    cut = suffixes.without_repeats(docs, length=PASSAGE_BYTES)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike(r"\S"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, round_trip): SentencePiece ids, and whether they decode to the text (null: as the empty text, without ids)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = F.coalesce(F.replace("text", F.lit(pieces.SPACE), F.lit(" ")), F.lit(""))
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", F.sha2(plain, 256).alias("_sha"), "text"), model)
    back = pieces.decode(encoded.withColumn("_ids", F.col("ids")), model)
    return back.select("doc_id", "lang", "source", "n_pieces", F.col("_ids").alias("ids"), (F.sha2("text", 256) == F.col("_sha")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", encoding),
]

#: Model fitting, fingerprints and suffix removal have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the ``documents`` table of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
