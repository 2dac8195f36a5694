"""Certificates from triples that say who had which role in an event.

One grouping gives people, one join puts them to their roles, and one grouping
gives certificates, however many roles there are. Several values of a property give several
rows, as a query with optional parts would.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.shared import kept

#: Vocabularies of the records (fixed values).
CIV, SCHEMA = "https://iisg.amsterdam/id/civ/", "https://schema.org/"
PICOM, PICOT = "https://personsincontext.org/model#", "https://terms.personsincontext.org/"
PNV, PROV = "https://w3id.org/pnv#", "http://www.w3.org/ns/prov#"
PERSON = "struct<iri:string,given:string,family:string,gender:string,age:int>"
#: Roles of a kind of certificate beside the subject.
RELATIVES = {
    "births": ("subject_father", "subject_mother"),
    "deaths": ("subject_father", "subject_mother", "partner"),
    "marriages": ("partner", "subject_father", "subject_mother", "partner_father", "partner_mother"),
}


@dataclass(frozen=True)
class Model:
    """Events point to people by a predicate for each role; roles maps a kind of certificate to (column, predicate, needed)."""

    date: str = f"{CIV}eventDate"
    given: str = f"{SCHEMA}givenName"
    family: str = f"{SCHEMA}familyName"
    gender: str = f"{SCHEMA}gender"
    age: str = f"{CIV}age"
    roles: dict[str, tuple[tuple[str, str, bool], ...]] = field(
        default_factory=lambda: {
            "births": (("subject", f"{CIV}newborn", True), ("subject_father", f"{CIV}father", False), ("subject_mother", f"{CIV}mother", False)),
            "deaths": (("subject", f"{CIV}deceased", True), ("subject_father", f"{CIV}father", False), ("subject_mother", f"{CIV}mother", False), ("partner", f"{CIV}partner", False)),
            "marriages": (
                ("subject", f"{CIV}bride", True), ("partner", f"{CIV}groom", True), ("subject_father", f"{CIV}fatherBride", False), ("subject_mother", f"{CIV}motherBride", False),
                ("partner_father", f"{CIV}fatherGroom", False), ("partner_mother", f"{CIV}motherGroom", False),
            ),
        }
    )
    #: Whether spouses must be named.
    named_spouses: bool = False

    def needed(self, kind: str) -> list[str]:
        """The predicates that certificates of a kind are made of."""
        return [self.date, self.given, self.family, self.gender, self.age, *(p for _, p, _ in self.roles[kind])]

    def people(self, triples: DataFrame) -> DataFrame:
        """(s, p, o): the values of given, family, gender and age of people."""
        return triples.filter(F.col("p").isin(self.given, self.family, self.gender, self.age)).select("s", "p", "o")

    def edges(self, triples: DataFrame, kind: str) -> DataFrame:
        """(event, role, iri)"""
        named = {p: c for c, p, _ in self.roles[kind]}
        found = triples.filter(F.col("p").isin(*named)).select(F.col("s").alias("event"), "p", F.col("o").alias("iri"))
        return found.select("event", F.coalesce(*(F.when(F.col("p") == p, c) for p, c in named.items())).alias("role"), "iri")

    def dates(self, triples: DataFrame) -> DataFrame:
        return triples.filter(F.col("p") == self.date).select(F.col("s").alias("event"), F.col("o").alias("day"))


@dataclass(frozen=True)
class PersonsInContext(Model):
    """People point to their source and role in it; relatives are joined to them. Names by schema.org, or by PNV on a node of their own."""

    date: str = f"{SCHEMA}dateCreated"
    age: str = f"{PICOM}hasAge"
    pnv: bool = False
    named_spouses: bool = True

    #: Source type and role of the people a certificate is about (fixed values).
    ABOUT = {"births": ("551", "575"), "deaths": ("553", "479"), "marriages": ("552", "574")}

    def needed(self, kind: str) -> list[str]:
        names_by = [f"{SCHEMA}additionalName", f"{PNV}givenName", f"{PNV}baseSurname"] if self.pnv else [self.given, self.family]
        return [self.date, self.gender, self.age, *names_by, f"{SCHEMA}additionalType", f"{PICOM}hasRole", f"{PROV}hadPrimarySource", f"{SCHEMA}spouse", f"{SCHEMA}parent"]

    def people(self, triples: DataFrame) -> DataFrame:
        if not self.pnv:
            return super().people(triples)
        own = triples.filter(F.col("p").isin(self.gender, self.age)).select("s", "p", "o")
        nodes = triples.filter(F.col("p") == f"{SCHEMA}additionalName").select("s", F.col("o").alias("node"))
        named = F.when(F.col("p") == f"{PNV}givenName", self.given).when(F.col("p") == f"{PNV}baseSurname", self.family)
        names_of = triples.filter(F.col("p").isin(f"{PNV}givenName", f"{PNV}baseSurname")).select(F.col("s").alias("node"), named.alias("p"), "o")
        return own.unionByName(nodes.join(names_of, "node").select("s", "p", "o"))

    def edges(self, triples: DataFrame, kind: str) -> DataFrame:
        source, role = self.ABOUT[kind]
        pairs = lambda p, s, o: triples.filter(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
        events = pairs(f"{SCHEMA}additionalType", "event", "type").filter(F.col("type") == f"{PICOT}sourcetypes/{source}").select("event")
        roles = pairs(f"{PICOM}hasRole", "iri", "role").filter(F.col("role") == f"{PICOT}roles/{role}").select("iri")
        about = pairs(f"{PROV}hadPrimarySource", "iri", "event").join(roles.distinct(), "iri").join(events.distinct(), "event").select("event", "iri")
        sexes = pairs(self.gender, "iri", "gender")
        sex = lambda female, male: F.when(F.col("gender") == f"{SCHEMA}Female", female).when(F.col("gender") == f"{SCHEMA}Male", male)
        spouses = pairs(f"{SCHEMA}spouse", "iri", "other")
        if kind == "marriages":
            sided = about.join(sexes, "iri").select("event", "iri", sex("subject", "partner").alias("role")).filter("role is not null")
            brides, grooms = (sided.filter(F.col("role") == r).select("event", F.col("iri").alias(n)) for r, n in (("subject", "iri"), ("partner", "other")))
            couples = brides.join(spouses, "iri").join(grooms, ["event", "other"])
            main = couples.select("event", F.explode(F.array(F.struct(F.lit("subject").alias("role"), "iri"), F.struct(F.lit("partner").alias("role"), F.col("other").alias("iri")))).alias("x")).select("event", "x.*").distinct()
        else:
            main = about.select("event", F.lit("subject").alias("role"), "iri")
        parents = main.join(pairs(f"{SCHEMA}parent", "iri", "parent"), "iri").select("event", F.col("role").alias("of"), F.col("parent").alias("iri"))
        found = parents.join(sexes, "iri").select("event", F.concat("of", sex(F.lit("_mother"), F.lit("_father"))).alias("role"), "iri").filter("role is not null")
        out = main.unionByName(found)
        if kind == "deaths":
            out = out.unionByName(main.join(spouses, "iri").select("event", F.lit("partner").alias("role"), F.col("other").alias("iri")))
        return out.distinct()


#: Built-in data models by name.
MODELS = {"CIV": Model(), "PiCo-SDO": PersonsInContext(), "PiCo-PNV": PersonsInContext(pnv=True)}


def people(triples: DataFrame, model: Model = Model()) -> DataFrame:
    """(iri, person): all named people, once for each combination of their values."""
    parts = {"given": model.given, "family": model.family, "gender": model.gender, "age": model.age}
    rows = model.people(triples).groupBy(F.col("s").alias("iri")).agg(*(F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in parts.items()))
    for c in parts:
        rows = rows.withColumn(c, F.explode_outer(c))
    return rows.select("iri", F.struct("iri", "given", "family", "gender", F.nullif(names.whole_number(F.col("age")), F.lit(-1)).alias("age")).cast(PERSON).alias("person"))


def certificates(triples: DataFrame, kind: str, model: Model = Model()) -> DataFrame:
    """births, deaths or marriages: event, event_date and a person for each role.

    The subject (and a marriage's partner) and the date must be there. A relative without both names, or
    a role nobody has, is null. A date that is no ISO day is null. Partners of the
    deceased carry no age.
    """
    triples = kept(triples.filter(F.col("p").isin(model.needed(kind))).select("s", "p", "o"), "statements")  # made or parsed once for all that is asked
    needed = ("subject", "partner") if kind == "marriages" else ("subject",)
    roles = ("subject", *RELATIVES[kind])
    held = model.edges(triples, kind).join(people(triples, model), "iri", "left").withColumn("person", F.coalesce("person", F.struct("iri", *(F.lit(None).cast(t).alias(c) for c, t in (("given", "string"), ("family", "string"), ("gender", "string"), ("age", "int")))).cast(PERSON)))
    dates = model.dates(triples).select("event", F.lit(None).cast("string").alias("role"), F.lit(None).cast(PERSON).alias("person"), "day")
    named = F.col("person.given").isNotNull() & F.col("person.family").isNotNull()
    bare = lambda r: F.lit(r in needed and not (kind == "marriages" and model.named_spouses))
    one = lambda r: F.collect_set(F.when((F.col("role") == r) & (bare(r) | named), F.col("person")))
    rows = held.select("event", "role", "person", F.lit(None).cast("string").alias("day")).unionByName(dates).groupBy("event").agg(F.collect_set("day").alias("day"), *(one(r).alias(r) for r in roles))
    rows = rows.withColumn("day", F.explode("day"))
    for r in roles:
        rows = rows.withColumn(r, F.explode(r) if r in needed else F.explode_outer(r))
    if kind == "deaths":
        rows = rows.withColumn("partner", F.when(F.col("partner").isNotNull(), F.col("partner").withField("age", F.lit(None).cast("int"))))
    return rows.select("event", names.iso_date(F.col("day")).alias("event_date"), *roles)
