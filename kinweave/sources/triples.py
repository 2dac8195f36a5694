"""N-Triples and N-Quads as a DataFrame, and graph patterns on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang", "g"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)

_BLANK = r"_:[^\s<\".]+(?:\.+[^\s<\".]+)*"
_LINE = rf'^\s*(<[^>]*>|{_BLANK})\s*<([^>]*)>\s*(?:<([^>]*)>|({_BLANK})|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:(<[^>]*>|{_BLANK})\s*)?\.\s*(?:#.*)?$'
_PIECE = r"(\\u[dD][89aAbB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[^uU]|\\|[^\\]+)"
#: Characters that follow a backslash, and what they stand for (fixed values).
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: Column) -> Column:
    """text with its escapes decoded from left to right, each once; code points that don't exist become U+FFFD."""

    def decoded(piece: Column) -> Column:
        hexes = F.replace(F.substring(piece, F.lit(3), F.lit(12)), F.lit("\\u"), F.lit(""))
        lone = F.upper(hexes).rlike("^D[89A-F]..$")
        beyond = (F.upper(hexes) > "0010FFFF") | F.upper(hexes).rlike("^0000D[89A-F]")
        out = F.when(piece.startswith("\\u"), F.when(lone, "\ufffd").otherwise(F.decode(F.unhex(F.when(~lone, hexes)), "UTF-16BE")))
        out = out.when(piece.startswith("\\U"), F.when(beyond, "\ufffd").otherwise(F.decode(F.unhex(F.when(~beyond, hexes)), "UTF-32")))
        for escape, char in _ESCAPES.items():
            out = out.when(piece == f"\\{escape}", char)
        return out.otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def parse(lines: DataFrame, tag: Column | None = None) -> DataFrame:
    """Triples of lines(value); comments and lines that are no statement are left out; each statement once.

    tag: goes into the names of blank nodes, which hold within a file only.
    """
    part = lambda k: F.nullif(F.regexp_extract("value", _LINE, k), F.lit(""))
    rows = lines.filter(F.col("value").rlike(_LINE))

    def node(k: int) -> Column:
        value = F.regexp_extract("value", _LINE, k)
        blank = value if tag is None else F.concat(F.lit("_:"), tag, F.substring(value, F.lit(3), F.length(value)))
        return F.when(value.startswith("_:"), blank).when(value != "", unescaped(F.regexp_replace(value, "^<|>$", "")))

    literal = part(3).isNull() & part(4).isNull()
    out = rows.select(
        node(1).alias("s"), unescaped(part(2)).alias("p"), F.coalesce(unescaped(part(3)), node(4), unescaped(F.regexp_extract("value", _LINE, 5))).alias("o"),
        F.when(literal, "literal").when(part(3).isNotNull(), "iri").otherwise("bnode").alias("o_kind"), unescaped(part(6)).alias("o_datatype"), part(7).alias("o_lang"), node(8).alias("g"),
    )
    return out.dropDuplicates()


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path), F.substring(F.md5(F.input_file_name()), 1, 8))


def statement_count(triples: DataFrame) -> DataFrame:
    """One row: the number of statements."""
    return triples.agg(F.count("*").alias("n"))


def pattern(triples: DataFrame, predicate: str, subject: str = "s", value: str = "o") -> DataFrame:
    """Rows of one predicate as (subject, value)."""
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(value))


def class_counts(triples: DataFrame) -> DataFrame:
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    return triples.filter(F.col("p") == kind).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))
