"""Data models given as queries: a YAML file with a SELECT query for births, deaths and marriages.

A query gives event, eventDate and, for each role, a variable with the person and others
with GivenName, FamilyName, Gender and Age appended.
"""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.sources import sparql
from kinweave.sources.certificates import PERSON

KEYS = ("BIRTHS", "DEATHS", "MARRIAGES")
#: Variables of the roles by kind of certificate, and our columns (fixed values).
VARIABLES = {
    "births": {"newborn": "subject", "newbornFather": "subject_father", "newbornMother": "subject_mother"},
    "deaths": {"deceased": "subject", "deceasedFather": "subject_father", "deceasedMother": "subject_mother", "partner": "partner"},
    "marriages": {"bride": "subject", "groom": "partner", "brideFather": "subject_father", "brideMother": "subject_mother", "groomFather": "partner_father", "groomMother": "partner_mother"},
}
_PARTS = ("", "GivenName", "FamilyName", "Gender", "Age")


def load(text: str) -> dict[str, str]:
    """Queries by kind (births, deaths, marriages)."""
    found = yaml.safe_load(text)
    missing = [k for k in KEYS if not isinstance(found, dict) or not isinstance(found.get(k), str)]
    if missing:
        raise ValueError(f"the data model lacks {', '.join(missing)}")
    return {k.lower(): found[k] for k in KEYS}


def wanted(kind: str) -> list[str]:
    """The variables a query of a kind should give; partners of the deceased have no age."""
    return ["event", "eventDate", *(r + p for r in VARIABLES[kind] for p in _PARTS if not (r == "partner" and p == "Age"))]


def missing(model: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, variable) of what a model's queries don't name; those columns will be null."""
    return [(k, v) for k, text in model.items() for v in wanted(k) if not re.search(rf"[?$]{v}\b", text)]


def certificates(graph: DataFrame, kind: str, model: dict[str, str]) -> DataFrame:
    """Certificates of a kind as the model's query finds them; one row a solution."""
    rows = sparql.query(graph, model[kind])
    have = set(rows.columns)
    text = lambda v: F.col(v).cast("string") if v in have else F.lit(None).cast("string")

    def person(r: str):
        age = F.nullif(names.whole_number(text(f"{r}Age")), F.lit(-1))
        whole = F.struct(text(r).alias("iri"), text(f"{r}GivenName").alias("given"), text(f"{r}FamilyName").alias("family"), text(f"{r}Gender").alias("gender"), age.alias("age")).cast(PERSON)
        return F.when(text(r).isNotNull(), whole)

    return rows.select(text("event").alias("event"), names.iso_date(text("eventDate")).alias("event_date"), *(person(r).alias(c) for r, c in VARIABLES[kind].items()))
