"""A pipeline from raw documents to token ids, in five stages.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and all but
the last return the columns of documents. SQL can express none of the stages; tests hold each against a plain version or the library it stands for.

Edge cases, in every stage: columns other than those of documents are left out, whatever their names; an empty table gives an empty result; repeated rows
and rows with equal ids are rows of their own (near_dedup keeps one of those with equal texts); a null id is kept as null, and near_dedup prefers a copy
that has one; a null or empty text has no letter, so language_id rejects it, and later stages pass one on or, in mix_sources, take nothing
of it; a null source is a source of its own; texts of any length are taken whole; of ties the smaller id, language or source by code points wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, simhash, suffix
from tidemark.llm.shared import remove, shared_path, tokenizer_path, use_checkpoints

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with the language that their text shows as ``lang``, whatever it was before; those without a letter go, and with ``wanted`` those in other languages, too."""
    use_checkpoints(spark)
    profiles = langid.learn(docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True))))
    known = langid.predict(docs.select(*COLUMNS), profiles).where(F.col("lang_pred") != langid.UNKNOWN)
    if wanted is not None:
        known = known.where(F.col("lang_pred").isin(*wanted))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of texts whose sets of five-word shingles are 0.8 similar or more."""
    use_checkpoints(spark)
    return simhash.keep_first(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of later copies; a character of which some bytes go is left out as a whole."""
    use_checkpoints(spark)
    found = suffix.dedup(docs.select(*COLUMNS), carried=("lang", "source"), whole_characters=True)
    return found.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats included."""
    use_checkpoints(spark)
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and their number."""
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), keep=["doc_id", "lang", "source"], remembered=150_000)
    return tokens.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder, read by the next, and deleted once that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
