"""Files and folders wherever Spark reads them: all go through its file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return bool(system.exists(target))


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return bool(system.exists(target)) and bool(system.getFileStatus(target).isDirectory())


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.mkdirs(target)


def delete(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return bool(system.delete(target, True))


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of what a folder holds, by name; paths keep the form they were asked by."""
    system, target = _at(spark, path)
    if not system.exists(target):
        return []
    found = [(str(s.getPath().getName()), bool(s.isDirectory())) for s in system.listStatus(target)]
    return [(f"{path.rstrip('/')}/{name}", folder) for name, folder in sorted(found)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's whole text."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file."""
    system, target = _at(spark, path)
    out = system.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def base_name(path: str) -> str:
    """A path's last part without its ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of lines of a file or folder."""
    return spark.read.text(path).agg(F.count("*").alias("n"))
