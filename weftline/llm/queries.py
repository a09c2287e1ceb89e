"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import conversations, dac, decontaminate, language, pieces, quality, sharding, simhash, spelling, suffixes, url_lists, vector_graph, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"), 24)


def op2_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op5_url_lists_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_lists.derived_captures(pages), url_lists.derived_entries(pages))


def op6_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.vector_groups(_table(spark, sf_dir, "embeddings"), least=0.9)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), distance=4, shingle=4)


def op8_suffix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_report(_table(spark, sf_dir, "documents"), length=400)


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(_table(spark, sf_dir, "conversations"))


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_shards, op2_dac_tokens, op3_language_fusion, op4_winnow_decontamination, op5_url_lists_asof, op6_pruned_graph, op7_simhash_groups, op8_suffix_removal, op9_piece_lattice, op10_warc_store, op11_spelling_variants, op12_conversation_repair, op13_quality_trees)}
ORACLE_SQL: dict[str, str] = {"op4_winnow_decontamination": decontaminate.ORACLE, "op5_url_lists_asof": url_lists.ORACLE, "op6_pruned_graph": vector_graph.ORACLE, "op10_warc_store": warc.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_conversation_repair": conversations.ORACLE}
