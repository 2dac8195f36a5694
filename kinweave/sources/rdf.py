"""Files of triples in any known format, by the ends of their names.

N-Triples and N-Quads are read line by line, in as many tasks as Spark cuts the files into.
The others can only be read from their start: one file a task, so a large graph in them
should come in many files.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.sources import json_ld, person_csv, rdf_xml, triples, turtle

#: Formats by the end of a file's name (fixed values); each may be followed by .gz.
FORMATS = {
    "nt": "lines", "nq": "lines", "ttl": "turtle", "ttls": "turtle", "n3": "turtle", "trig": "turtle", "trigs": "turtle", "jsonld": "json-ld",
    "rdf": "xml", "rdfs": "xml", "owl": "xml", "xml": "xml", "csv": "people",
}
_PARSERS = {"turtle": turtle.read, "xml": rdf_xml.read, "json-ld": json_ld.read}
#: Statements that a task holds before it hands them on.
_BATCH = 10_000


def format_of(path: str) -> str:
    name = path.lower().rstrip("/").removesuffix(".gz")
    end = name.rsplit(".", 1)[-1]
    if end not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[end]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=triples.COLUMNS)


def _parse(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            rows: list = []
            for statement in _PARSERS[kind](raw if kind == "xml" else raw.decode("utf-8-sig"), path, hashlib.md5(path.encode()).hexdigest()[:8]):
                rows.append(statement)
                if len(rows) == _BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a file, each once. What can't be read raises ValueError, at once or in the task."""
    kind = format_of(path)
    if kind == "lines":
        return triples.read(spark, path)
    if kind == "people":
        return person_csv.triples(person_csv.read(spark, path))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_parse, kind=kind), triples.SCHEMA).dropDuplicates()
