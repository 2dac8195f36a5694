"""Link tables as CSV folders: names, columns, writing, finding and reading them again.

A table is written in as many part files as it has partitions, each with a header.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources import files

MISSING = "N.A."

#: Columns of a certificate link file, and the number each holds (fixed values).
CERTIFICATE_COLUMNS = {
    "certificate_A": "a_event",
    "certificate_B": "b_event",
    "family_line": "family_line",
    "levenshtein_total_AB": "s_lev_total",
    "levenshtein_max_AB": "s_lev_max",
    "levenshtein_total_AB_female_relative": "m_lev_total",
    "levenshtein_max_AB_female_relative": "m_lev_max",
    "levenshtein_total_AB_male_relative": "f_lev_total",
    "levenshtein_max_AB_male_relative": "f_lev_max",
    "matched_names_AB": "s_matched",
    "number_names_A": "s_n_a",
    "number_names_B": "s_n_b",
    "matched_names_AB_female_relative": "m_matched",
    "number_names_A_female_relative": "m_n_a",
    "number_names_B_female_relative": "m_n_b",
    "matched_names_subject_AB_male_relative": "f_matched",
    "number_names_subject_A_male_relative": "f_n_a",
    "number_names_subject_B_male_relative": "f_n_b",
    "year_diff": "year_diff",
}

#: Columns of a person link file, and where each comes from (fixed values).
PERSON_COLUMNS = {
    "id_certificate_A": "id1",
    "id_certificate_B": "id2",
    "link": "link",
    "process": "process",
    "family_line": "family_line",
    "number_certificate_matches": "n_matched",
    "id_event_A": "a_event",
    "id_event_B": "b_event",
    "levenshtein_total_AB": "lev_total",
    "levenshtein_max_AB": "lev_max",
    "number_names_matches_AB": "matched",
    "number_names_A": "n_a",
    "number_names_B": "n_b",
    "year_diff": "year_diff",
}

_FILE = re.compile(r"(within|between)[-_]([bmd])[-_]([bmd])", re.I)


def suffix(most: int = 4, fixed: bool = False, single: bool = False, ignore_date: bool = False, ignore_block: bool = False) -> str:
    """The options' part of a file name."""
    return f"-maxLev-{most}" + "-fixed" * fixed + "-singleInd" * single + "-ignoreDate" * ignore_date + "-ignoreBlock" * ignore_block


def title(process: str) -> str:
    """within_b_m as WITHIN_B-M."""
    kind, a, b = process.upper().split("_")
    return f"{kind}_{a}-{b}"


def short_title(process: str) -> str:
    """within_b_m as W_B-M."""
    kind, a, b = process.upper().split("_")
    return f"{kind[0]}_{a}-{b}"


def place(folder: str, process: str, options: str) -> str:
    name = title(process)
    return f"{folder.rstrip('/')}/{name.lower()}{options}/results/{name}{options}.csv"


def _shown(df: DataFrame, source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(MISSING)) if source in df.columns else F.lit(MISSING)


def as_certificate_file(links: DataFrame) -> DataFrame:
    """Links with the columns of the file, missing numbers as N.A.; between links name the relatives female and male."""
    if "female_lev_total" in links.columns:
        links = links.withColumnsRenamed({c: c.replace("female_", "m_", 1) if c.startswith("female_") else c.replace("male_", "f_", 1) for c in links.columns if c.startswith(("female_", "male_"))})
    return links.select(*(_shown(links, source).alias(name) for name, source in CERTIFICATE_COLUMNS.items()))


def as_person_file(links: DataFrame) -> DataFrame:
    return links.select(*(_shown(links, source).alias(name) for name, source in PERSON_COLUMNS.items()))


def write(table: DataFrame, path: str, mode: str = "overwrite") -> str:
    table.write.mode(mode).option("header", True).csv(path)
    return path


def _known(column: str, kind: str) -> Column:
    value = F.when(F.col(column) != MISSING, F.col(column))
    return value if kind == "string" else value.cast(kind)


def read_certificate_file(spark: SparkSession, path: str) -> DataFrame:
    """A link file with the columns of the operators; for between links the relatives are female and male."""
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in CERTIFICATE_COLUMNS)).csv(path)
    texts = ("a_event", "b_event", "family_line")
    out = raw.select(*(_known(name, "string" if source in texts else "int").alias(source) for name, source in CERTIFICATE_COLUMNS.items()))
    if process_of(path).startswith("between"):
        out = out.withColumnsRenamed({c: {"m": "female", "f": "male"}[c[0]] + c[1:] for c in out.columns if c.startswith(("m_", "f_"))})
    return out


def process_of(path: str) -> str:
    """The process a file name tells, or an empty string."""
    m = _FILE.search(path.rstrip("/").rsplit("/", 1)[-1])
    return "_".join(m.groups()).lower() if m else ""


def found(spark: SparkSession, folder: str) -> list[str]:
    """Link files and folders below a folder, by path, on any file system; what a link folder holds is not looked at."""
    hits = []
    for path, is_folder in files.children(spark, folder):
        if path.endswith(".csv") and process_of(path):
            hits.append(path)
        elif is_folder:
            hits += found(spark, path)
    return sorted(hits)


def as_triples(links: DataFrame, namespace: str = "https://www.example.org/links/") -> DataFrame:
    """N-Triples lines (value) of a link file's rows: a node a link, with each column that isn't missing.

    Certificates are IRIs, counts whole numbers; the node is named by the certificates and the line between them.
    """
    columns = links.columns
    node = F.concat(F.lit("_:l"), F.md5(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns[:5]))))
    shown = []
    for c in columns:
        if c.startswith(("certificate_", "id_")):
            term = F.concat(F.lit("<"), F.col(c), F.lit(">"))
        elif c in ("family_line", "link", "process"):
            term = F.concat(F.lit('"'), F.col(c), F.lit('"'))
        else:
            term = F.concat(F.lit('"'), F.col(c), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>'))
        shown.append(F.when(F.col(c) != MISSING, F.concat(node, F.lit(f" <{namespace}{c}> "), term, F.lit(" ."))))
    kind = F.concat(node, F.lit(f" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{namespace}Link> ."))
    return links.select(F.explode(F.array_compact(F.array(kind, *shown))).alias("value"))


def closure_terms(members: DataFrame) -> DataFrame:
    """Lines of the class file: class and members, joined by commas; a row a class, so a class must fit in one."""
    return members.groupBy("class_id").agg(F.array_sort(F.collect_set("person")).alias("people")).select(F.concat_ws(",", F.concat(F.array("class_id"), F.col("people"))).alias("value"))
