"""The corpus build as one plan: clean, deduplicate, filter, slice, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup, quality
from textloom.scratch import written
from textloom.tables import table


def build_corpus(documents: DataFrame, min_chars: int = 200) -> DataFrame:
    """``(doc_id, slice, source, n_chars, n_words, role, representative, keep)``.

    Near-duplicates go before the filter, as the choice of representatives
    depends on the filter's verdict; the cleaned texts are written once and
    read by both.
    """
    clean = written(documents.select("doc_id", "source", F.coalesce("slice", F.lit("backbone")).alias("slice"), T.clean(F.coalesce("text", F.lit(""))).alias("text")), "corpus-clean")
    judged = written(quality.quality_verdict(quality.quality_metrics(clean), {"min_chars": min_chars}).select("doc_id", "n_chars", "n_words", "keep"), "corpus-verdicts")
    roles = dedup.near_dedup(clean.join(judged, "doc_id"), F.col("keep"))
    return (
        clean.select("doc_id", "source", "slice")
        .join(judged, "doc_id")
        .join(roles.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("role", F.coalesce("role", F.lit("kept")))
    )


def corpus_summary(spark: SparkSession, directory: str) -> DataFrame:
    """``(slice, documents, duplicates, rejected, kept, kept_words)``."""
    c = build_corpus(table(spark, directory, "documents"))
    lost = F.col("role") == "loser"
    return c.groupBy("slice").agg(
        F.count("*").alias("documents"),
        F.count(F.when(lost, 1)).alias("duplicates"),
        F.count(F.when(~lost & ~F.col("keep"), 1)).alias("rejected"),
        F.count(F.when(~lost & F.col("keep"), 1)).alias("kept"),
        F.coalesce(F.sum(F.when(~lost & F.col("keep"), F.col("n_words"))), F.lit(0)).alias("kept_words"),
    )
