"""What the operators share: session settings, scratch tables, wrapped columns."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.shared import kept, partitions, scratch  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to a Python worker at once, where the session has Spark's default: texts may be long.
BATCH_ROWS = 500
_ROWS_SETTING, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import this library from where it lies; bounds their batches."""
    if spark.conf.get(_ROWS_SETTING) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
