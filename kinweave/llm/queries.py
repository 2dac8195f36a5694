"""The operators on the driver's tables, one query each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import byte_bpe, fingerprints, html_extract, license_scan, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, toxicity
from kinweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def mixing_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix where each document belongs to its source and to its language, and may fill either's quota."""
    member = F.array_compact(F.array(F.concat(F.lit("source "), F.col("source")), F.concat(F.lit("language "), F.col("lang"))))
    return mixing.overlapping(table(spark, sf_dir, "documents"), member)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_suffix_dedup, op3_quality_rules, op4_byte_bpe, op5_license_scan, op6_toxicity, op7_near_dedup, op8_mixing, mixing_overlap, op9_quality_classifier, op10_html_extract)}

ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
