"""Tables written to the folder that all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor loses
nothing that was computed before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or one of our own where it is unset under a local master (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; it is deleted by dropped(), or when the program ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/kinweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() gave, once nothing will read them again."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            _forget(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
