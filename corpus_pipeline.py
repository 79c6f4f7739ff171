"""A training corpus from raw documents: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the
last one returns token ids. Columns that a table has beside those go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefold.llm import bpe, language, mixing, neardup, secrets_ledger
from sablefold.llm.common import folder, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows teach stay; those without a letter, and those that no
    language's regression claims (best margin 0 or less, a score of at most 0.5), go; a model of one
    language claims every text with a letter. A null lang takes the predicted one."""
    found = language.predict(docs, language.fit(docs), "lang_pred_", "lang_score_")
    kept = found.filter((F.col("lang_pred_") != language.UNKNOWN) & (F.col("lang_score_") > 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred_")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return neardup.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; no document goes."""
    return secrets_ledger.redact_documents(docs, folder(spark, "pipeline-ledger"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the sources' target weights say."""
    return mixing.repeat_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, proven by decoding them: doc_id, lang, source, n_tokens, ids, ids_sha256,
    decoded_sha256."""
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Neither the language model nor the forest is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
