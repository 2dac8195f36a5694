"""Bounded samples of labelled documents, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labelled rows from which a classifier is fitted, at most: those with the smallest hashes of their ids.
MOST_ROWS = 8000
#: Bytes of features that are brought to the driver at most; rows beyond are not part of the sample.
MOST_BYTES = 256 << 20


def held_out() -> Column:
    """True for ids whose crc32 is divisible by FOLDS; their labels are never learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id long, text, label) of at most ``most`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; a label given twice counts with its smaller
    value, and of several texts of one id the one with the smallest hash.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(~held_out() & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``most`` rows
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", F.col("x.text").alias("text"), "label")
