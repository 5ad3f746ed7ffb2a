"""Noise metrics per text and per document, and the scanned flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions import noise

METRICS = ["total_len", "noise_len", "words", "has_text"]


def noise_metrics(df: DataFrame, text_col: str) -> DataFrame:
    """Add the metric columns and ``is_noisy`` for one text column."""
    with_metrics = df.select("*", *[c.alias(n) for n, c in noise.metrics(F.col(text_col)).items()])
    return with_metrics.withColumn("is_noisy", noise.is_noisy(*[F.col(n) for n in METRICS]))


def document_noise(fragments: DataFrame, text_col: str = "content_text") -> DataFrame:
    """Metrics of a document's fragments put together, each after one space.

    No run crosses a space, so the metrics of the whole are sums over the
    fragments.  The sums are built before the shuffle: a document with any
    number of fragments sends one row per task.
    """
    parts = fragments.where(F.col("document_id") != "").select(
        "document_id", *[c.alias(n) for n, c in noise.metrics(F.col(text_col)).items()]
    )
    whole = parts.groupBy("document_id").agg(
        F.sum(F.col("total_len") + 1).alias("total_len"),
        F.sum("noise_len").alias("noise_len"),
        F.sum("words").alias("words"),
        F.bool_or("has_text").alias("has_text"),
    )
    return whole.withColumn("is_noisy", noise.is_noisy(*[F.col(n) for n in METRICS]))


def scanned_documents(fragments: DataFrame, text_col: str = "content_text") -> DataFrame:
    """Ids of documents whose text is noise."""
    return document_noise(fragments, text_col).where("is_noisy").select("document_id")


def scanned_markdown(docs: DataFrame) -> DataFrame:
    """Ids of documents whose raw Markdown is noise (the other place the rule is applied)."""
    return docs.where(noise.is_text_noisy(F.col("markdown"))).select("document_id")
