"""From raw documents to tokens: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written and
read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import byte_bpe, mixing, near_dedup, quality_rules, suffix_dedup
from kinweave.llm.common import kept, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts fail them, so they go. Equal documents are judged alike, rows that repeat an
    id each by itself. All columns stay, whatever their names; an empty table stays empty.
    """
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id.

    Texts without a word are copies of one another; rows with a null id all stay; rows that repeat an id are
    one document, and stay or go together. All columns stay; an empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that an earlier document has in a string of 50.

    A cut may fall inside a character: its remaining bytes become U+FFFD.
    Rows without a removal keep their text, null too; n_chars counts the new text. Rows with a null id
    neither lose bytes nor remove any; rows that repeat an id don't remove each other's. All columns stay,
    whatever their names, also those the work itself uses; an empty table stays empty.
    """
    marked = docs.select(*(F.col(f"`{c}`").alias(f"x{i}" if c not in ("doc_id", "text") else c) for i, c in enumerate(docs.columns)), F.col("text").alias("old_text"))
    out = suffix_dedup.remove_repeats(marked).withColumn("text", F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept_text").cast("string"))).otherwise(F.col("old_text")))
    named = out.select(*(F.col(f"x{i}" if c not in ("doc_id", "text") else c).alias(c) for i, c in enumerate(docs.columns)))
    if "n_chars" not in docs.columns:
        return named
    return named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; documents without a word are taken as often as the seeded order has it, as they
    cost nothing. Rows equal in id and text are taken together. All columns stay, whatever their names.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row a document; null texts have no token.

    The tables are smaller than the operator's own, as executors still hold earlier stages' heap; the result is
    the same.
    """
    return byte_bpe.digest(docs, most_states=500_000, most_pieces=300_000)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: Suffix sorting, banding and merging can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, name.replace(" ", "-").lower())
    return docs
