"""Triples from a CSV of people, one row a person and registration: CIV, or PiCo with PNV names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.shared import partitions
from kinweave.sources import csvw
from kinweave.sources.certificates import CIV, PICOM, PICOT, PNV, PROV, SCHEMA
from kinweave.sources.triples import COLUMNS

_XSD, _TYPE = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

#: Names of values in a column map (fixed values), by ours.
NAMES = {
    "event": "eventID", "date": "eventDate", "person": "subjectID", "given": "subjectFirstName", "family": "subjectFamilyName", "prefix": "subjectFamilyNamePrefix", "gender": "subjectGender",
    "age": "subjectAge", "role": "subjectRole",
}

#: Column titles of the standard layout (fixed values).
TITLES = {
    "eventID": "id_registration", "subjectID": "id_person", "subjectFirstName": "firstname", "subjectFamilyNamePrefix": "prefix", "subjectFamilyName": "familyname", "subjectGender": "sex",
    "subjectAge": "age_year", "subjectRole": "role",
}

#: Role and gender codes of the standard layout, and the start of the date columns by role (fixed values).
ROLES = {"1": "newborn", "2": "mother", "3": "father", "4": "bride", "5": "motherBride", "6": "fatherBride", "7": "groom", "8": "motherGroom", "9": "fatherGroom", "10": "deceased", "11": "partner"}
GENDERS = {"f": "female", "m": "male"}
DATED = {"newborn": "birth", "bride": "mar", "deceased": "death"}

#: By the role that a registration is about: its class, its source type and its role number (fixed values).
KINDS = {"newborn": ("Birth", "551"), "bride": ("Marriage", "552"), "deceased": ("Death", "553")}
ROLE_NUMBERS = {"newborn": "575", "partner": "574", "bride": "574", "groom": "574", "deceased": "479"}


def _chosen(codes: dict[str, str], **more: dict[str, str]) -> list[dict]:
    items = [{"rdf:value": k, "rdfs:label": v} | {p.replace("_", ":"): d[v] for p, d in more.items() if v in d} for k, v in codes.items()]
    return [{"type": "Annotation", "body": {"type": "Choice", "items": items}}]


def standard_map() -> dict[str, dict]:
    """The column map of the standard layout."""
    out = {name: {"name": name, "titles": title} for name, title in TITLES.items()}
    out["subjectGender"]["notes"] = _chosen(GENDERS)
    out["subjectRole"]["notes"] = _chosen(ROLES, sdo_alternateName=DATED)
    for part in ("Year", "Month", "Day"):
        out[f"event{part}"] = {"name": f"event{part}", "titles": f"{{subjectRole.sdo:alternateName}}_{part.lower()}"}
    out["eventDate"] = {"name": "eventDate", "virtual": True, "value": "{eventYear}-{eventMonth}-{eventDay}"}
    return out


def read(spark: SparkSession, path: str, columns: dict[str, dict] | None = None, sep: str = ";") -> DataFrame:
    """The file's rows with the columns of NAMES, by a column map (the standard layout's if none is given); empty cells are null."""
    raw = spark.read.option("header", True).option("sep", sep).option("emptyValue", None).option("nullValue", "").csv(path)
    return csvw.values(raw, columns or standard_map(), NAMES)


def _iri(o: Column) -> tuple:
    return o, F.lit("iri"), F.lit(None).cast("string")


def _literal(o: Column, datatype: str) -> tuple:
    return o, F.lit("literal"), F.lit(_XSD + datatype)


def _coded(values: dict[str, str]) -> Column:
    """The value of the row's role, null for others."""
    return reduce(lambda out, x: F.when(F.col("role") == x[0], x[1]).otherwise(out), values.items(), F.lit(None).cast("string"))


def _said(rows: DataFrame, found: list[tuple]) -> DataFrame:
    all_of = F.array(*(F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), datatype.alias("o_datatype")) for s, p, o, kind, datatype in found))
    out = rows.select(F.explode(all_of).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")
    return out.select("s", "p", "o", "o_kind", "o_datatype", F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("g")).select(*COLUMNS)


def _once(triples: DataFrame) -> DataFrame:
    """Each triple once. They are dealt first: what a task holds then depends on the number of partitions, not on how few tasks read the rows."""
    return triples.repartition(partitions(triples.sparkSession), "s", "p", "o").distinct()


def _parts(namespace: str) -> dict[str, Column]:
    """IRIs and derived values of a row; what depends on a missing part is null."""
    person = F.concat(F.lit(f"{namespace}person/p-"), F.col("person"))
    event = F.when(person.isNotNull(), F.concat(F.lit(f"{namespace}event/e-"), F.col("event")))
    family = F.when(F.col("family").isNotNull(), F.concat_ws(" ", "prefix", "family"))
    gender = F.lower("gender")
    date = F.when(F.col("role").isin(*KINDS) & ~F.col("date").rlike("^0000-|-00-|-00$"), F.col("date"))
    return {
        "person": person, "event": event, "family": family, "name": F.when(F.col("given").isNotNull() & family.isNotNull(), F.concat_ws(" ", "given", family)),
        "gender": F.when(gender == "female", f"{SCHEMA}Female").when(gender == "male", f"{SCHEMA}Male"), "date": date,
    }


def triples(rows: DataFrame, namespace: str = "http://example.org/") -> DataFrame:
    """CIV triples of read()'s rows, each once.

    Rows without a person or event id, and without a role, give none of what depends on
    them; a role the map doesn't translate is taken as it is. A date with a part that is missing or 0 gives none; it is the date of the row the
    registration is about.
    """
    x = _parts(namespace)
    person, event = x["person"], x["event"]
    found = [
        (person, F.lit(_TYPE), *_iri(F.lit(f"{SCHEMA}Person"))),
        (person, F.lit(f"{SCHEMA}givenName"), *_literal(F.col("given"), "string")),
        (person, F.lit(f"{CIV}prefixFamilyName"), *_literal(F.col("prefix"), "string")),
        (person, F.lit(f"{SCHEMA}familyName"), *_literal(x["family"], "string")),
        (person, F.lit(f"{SCHEMA}name"), *_literal(x["name"], "string")),
        (person, F.lit(f"{SCHEMA}gender"), *_iri(x["gender"])),
        (person, F.lit(f"{CIV}age"), *_literal(F.col("age"), "nonNegativeInteger")),
        (event, F.lit(_TYPE), *_iri(F.concat(F.lit(CIV), _coded({k: v[0] for k, v in KINDS.items()})))),
        (event, F.lit(f"{CIV}eventDate"), *_literal(x["date"], "date")),
        (event, F.concat(F.lit(CIV), F.col("role")), *_iri(person)),
    ]
    return _once(_said(rows, found))


def pico_triples(rows: DataFrame, namespace: str = "http://example.org/", parents_as_spouses: bool = True) -> DataFrame:
    """PiCo triples of read()'s rows, each once; names also by PNV, on a blank node for each person.

    People of one registration are joined by parent, children and spouse, by their roles in it; a pair
    of parents is joined by spouse if parents_as_spouses.
    """
    x = _parts(namespace)
    person, event = x["person"], x["event"]
    node = F.concat(F.lit("_:n"), F.md5(person))
    of_node = lambda p, o: (node, F.lit(f"{PNV}{p}"), *_literal(o, "string"))
    placed = F.when(F.col("role").isNotNull(), event)
    found = [
        (person, F.lit(_TYPE), *_iri(F.lit(f"{PICOM}PersonObservation"))),
        (person, F.lit(f"{SCHEMA}additionalName"), node, F.lit("bnode"), F.lit(None).cast("string")),
        (node, F.lit(_TYPE), *_iri(F.lit(f"{PNV}PersonName"))),
        (person, F.lit(f"{SCHEMA}givenName"), *_literal(F.col("given"), "string")),
        of_node("givenName", F.col("given")),
        of_node("surnamePrefix", F.col("prefix")),
        (person, F.lit(f"{SCHEMA}familyName"), *_literal(x["family"], "string")),
        of_node("baseSurname", F.col("family")),
        (person, F.lit(f"{SCHEMA}name"), *_literal(x["name"], "string")),
        of_node("literalName", x["name"]),
        (person, F.lit(f"{SCHEMA}gender"), *_iri(x["gender"])),
        (person, F.lit(f"{PICOM}hasAge"), *_literal(F.col("age"), "nonNegativeInteger")),
        (event, F.lit(_TYPE), *_iri(F.lit(f"{SCHEMA}ArchiveComponent"))),
        (person, F.lit(f"{PROV}hadPrimarySource"), *_iri(event)),
        (F.when(placed.isNotNull(), person), F.lit(f"{PICOM}hasRole"), *_iri(F.concat(F.lit(f"{PICOT}roles/"), _coded(ROLE_NUMBERS)))),
        (placed, F.lit(f"{SCHEMA}additionalType"), *_iri(F.concat(F.lit(f"{PICOT}sourcetypes/"), _coded({k: v[1] for k, v in KINDS.items()})))),
        (placed, F.lit(f"{SCHEMA}dateCreated"), *_literal(x["date"], "date")),
    ]
    return _once(_said(rows, found).unionByName(_relations(rows, person, placed, parents_as_spouses)))


def _relations(rows: DataFrame, person: Column, event: Column, parents_as_spouses: bool) -> DataFrame:
    """Edges between the people of each registration."""
    held = rows.select(event.alias("event"), "role", person.alias("iri")).filter("event is not null")
    events = held.groupBy("event").agg(*(F.collect_set(F.when(F.col("role") == r, F.col("iri"))).alias(r) for r in ROLES.values()))
    single = (F.size("newborn") > 0) | (F.size("deceased") > 0)
    subject = F.when(F.size("newborn") > 0, F.col("newborn")).otherwise(F.col("deceased"))
    none = F.array().cast("array<string>")
    pairs = [(F.when(single, subject).otherwise(none), p, F.col(r), back) for r, p, back in (("mother", "parent", "children"), ("father", "parent", "children"), ("partner", "spouse", "spouse"))]
    couple = lambda r: F.when(single, none).otherwise(F.col(r))
    pairs += [(couple("bride"), "parent", F.col("motherBride"), None), (couple("bride"), "parent", F.col("fatherBride"), None), (couple("groom"), "parent", F.col("motherGroom"), None), (couple("groom"), "parent", F.col("fatherGroom"), None)]
    pairs += [(couple("bride"), "spouse", F.col("groom"), "spouse")]
    if parents_as_spouses:
        pairs += [(F.col(m), "spouse", F.col(f), "spouse") for m, f in (("mother", "father"), ("motherBride", "fatherBride"), ("motherGroom", "fatherGroom"))]
    edge = lambda s, p, o: F.struct(s.alias("s"), F.lit(f"{SCHEMA}{p}").alias("p"), o.alias("o"))

    def of(xs: Column, p: str, ys: Column) -> Column:
        return F.flatten(F.transform(xs, lambda s: F.transform(ys, lambda o: edge(s, p, o))))

    all_of = F.flatten(F.array(*(of(xs, p, ys) for xs, p, ys, _ in pairs), *(of(ys, back, xs) for xs, _, ys, back in pairs if back)))
    return _said(events.select(F.explode(all_of).alias("e")).select("e.*"), [(F.col("s"), F.col("p"), *_iri(F.col("o")))])
