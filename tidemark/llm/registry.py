"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import bpe, ftrl, html, langid, licenses, mixing, quality, ranking, simhash, substring, suffix, topk, trie
from tidemark.llm.shared import tokenizer_path, use_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_checkpoints(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are left without later copies of 100-byte strings. Nulls, ties and empty tables: see the operator's module."""
    return suffix.digests(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests. Nulls, ties and empty tables: see the operator's module."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Nulls, ties and empty tables: see the operator's module."""
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Nulls, ties and empty tables: see the operator's module."""
    return mixing.shares(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document. Nulls, ties and empty tables: see the operator's module."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, against all. Nulls, ties and empty tables: see the operator's module."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without windows of 13 that an earlier one has. Nulls, ties and empty tables: see the operator's module."""
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Nulls, ties and empty tables: see the operator's module."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices in every document. Nulls, ties and empty tables: see the operator's module."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document. Nulls, ties and empty tables: see the operator's module."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document as learned from the labels of those not held out. Empty texts and a table without labels have a score, too: see the operator's module."""
    return ftrl.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations. A null conversation id takes no part; an empty table gives no node; other cases: see the operator's module."""
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item. Items without terms and documents with score 0 have no rows; other cases: see the operator's module."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run, "op1_suffix_dedup": op1_suffix_dedup, "op2_bpe": op2_bpe, "op3_html": op3_html, "op4_mixing": op4_mixing, "op5_quality_rules": op5_quality_rules, "op6_topk": op6_topk, "op7_substring_dedup": op7_substring_dedup, "op8_simhash": op8_simhash, "op9_licenses": op9_licenses, "op10_language_id": op10_language_id, "op11_quality_classifier": op11_quality_classifier, "op12_prefix_trie": op12_prefix_trie, "op13_ranked_search": op13_ranked_search}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": topk.SQL, "op9_licenses": licenses.sql(), "op12_prefix_trie": trie.SQL, "op13_ranked_search": ranking.SQL}
