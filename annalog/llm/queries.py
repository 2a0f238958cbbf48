"""Registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.llm import (
    bpe,
    clusters,
    decontamination,
    language,
    mixing,
    neighbours,
    oracles,
    paragraphs,
    pii,
    prefix_trie,
    simhash,
    token_counts,
    toxicity,
    url_filters,
)
from annalog.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.SITE_RULES + url_filters.WORD_RULES
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def tokenizer() -> str:
    import public_tokenizers

    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after the first line is cut and personal data is masked."""
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_edited(docs, token_counts.redactions(F.col("text")), tokenizer(), keep_tree=False)
    return counted.drop("tree")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_paragraphs": op2_paragraphs,
    "op7_neighbours": op7_neighbours,
    "op4_simhash": op4_simhash,
    "op3_url_filters": op3_url_filters,
    "op5_token_counts": op5_token_counts,
    "op8_bpe": op8_bpe,
    "op6_language": op6_language,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_mixing": op11_mixing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_clusters": op13_clusters,
}

# Fingerprints, learned scores, token ids and searches by index are not SQL; tests/llm holds
# their brute-force versions.
ORACLES: dict[str, str] = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op3_url_filters": oracles.URL_FILTERS,
    "op10_pii": oracles.PII,
    "op11_mixing": oracles.MIXING,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_clusters": oracles.CLUSTERS,
}
