"""From certificate links to people: person links, classes, ids and their summaries."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import uuid3
from kinweave.operators.components import components


_NUMBERS = ("lev_total", "lev_max", "matched", "n_a", "n_b")


def _first(certificates: DataFrame, *cols) -> DataFrame:
    """One row an event: people are read from the first, in the order of their ids and names."""
    people = [c for c in certificates.columns if c not in ("event", "event_date")]
    first = certificates.select("event", F.struct(*people, "event_date").alias("_first")).groupBy("event").agg(F.min("_first").alias("_first")).select("event", "_first.*")
    return first.select("event", *cols)


def _ordered(rows: DataFrame, process: str, n_matched: Column) -> DataFrame:
    """Person links of rows(_l: x, y and numbers): the smaller id first; links with a missing person are left out."""
    out = rows.filter("_l.x is not null and _l.y is not null")
    return out.select(
        F.least("_l.x", "_l.y").alias("id1"), F.greatest("_l.x", "_l.y").alias("id2"), F.lit("sameAs").alias("link"), F.lit(process).alias("process"), "family_line", n_matched.alias("n_matched"),
        "a_event", "b_event", *(F.col(f"_l.{c}").alias(c) for c in _NUMBERS), "year_diff",
    )


def _link(x: Column, y: Column, numbers: str) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), *(F.col(f"{numbers}_{c}").alias(c) for c in _NUMBERS))


def between_person_links(links: DataFrame, a: DataFrame, b: DataFrame, process: str) -> DataFrame:
    """A's mother is B's female, A's father B's male; two people matched."""
    side = lambda r: F.struct(F.col(f"{r}_mother.iri").alias("m"), F.col(f"{r}_father.iri").alias("f"))
    two = "partner_mother" in a.columns
    about_a = _first(a, side("subject").alias("s"), *([side("partner").alias("p")] if two else []))
    female = F.col("subject.gender").endswith("Female") | F.lower("subject.gender").isin("f", "female")
    about_b = _first(b, F.when(female, F.col("subject.iri")).otherwise(F.col("partner.iri")).alias("bf"), F.when(female, F.col("partner.iri")).otherwise(F.col("subject.iri")).alias("bm"))
    rows = links.join(about_a.withColumnRenamed("event", "a_event"), "a_event").join(about_b.withColumnRenamed("event", "b_event"), "b_event")
    parents = F.when(F.col("family_line") == "22", F.col("p")).otherwise(F.col("s")) if two else F.col("s")
    rows = rows.withColumn("_p", parents)
    return _ordered(rows.withColumn("_l", F.explode(F.array(_link(F.col("_p.m"), F.col("bf"), "female"), _link(F.col("_p.f"), F.col("bm"), "male")))), process, F.lit(2))


def within_person_links(links: DataFrame, a: DataFrame, b: DataFrame, process: str) -> DataFrame:
    """A's subject is B's bride (line 21, or any death) or groom (22); so are those parents that were matched.

    A parent B doesn't name is left out, and n_matched doesn't count it.
    """
    marriage = "partner_father" in b.columns
    roles = ("subject", "subject_mother", "subject_father")
    life = lambda r: F.struct(F.col(f"{r}.iri").alias("s"), F.col(f"{r}_mother.iri").alias("m"), F.col(f"{r}_father.iri").alias("f"))
    about_a = _first(a, life(roles[0]).alias("x")).withColumnRenamed("event", "a_event")
    about_b = _first(b, life("subject").alias("_s"), *([life("partner").alias("_q")] if marriage else [])).withColumnRenamed("event", "b_event")
    rows = links.join(about_a, "a_event").join(about_b, "b_event").withColumn("y", F.when(F.col("family_line") == "22", F.col("_q")).otherwise(F.col("_s")) if marriage else F.col("_s"))
    there = {r: F.col(f"{r}_lev_total").isNotNull() & F.col(f"x.{r}").isNotNull() & F.col(f"y.{r}").isNotNull() for r in "mf"}
    n_matched = F.lit(1) + there["m"].cast("int") + there["f"].cast("int")
    found = F.array_compact(F.array(_link(F.col("x.s"), F.col("y.s"), "s"), *(F.when(there[r], _link(F.col(f"x.{r}"), F.col(f"y.{r}"), r)) for r in "fm")))
    return _ordered(rows.withColumn("n_matched", n_matched).withColumn("_l", F.explode(found)), process, F.col("n_matched"))


def classes(links: DataFrame) -> DataFrame:
    """(person, class_id, class_uuid): members of each connected class; class_id is its smallest person."""
    found = components(links.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    return found.select(F.col("node").alias("person"), F.col("component").alias("class_id"), uuid3(F.col("component")).alias("class_uuid"))


def _uuid(text: str) -> str:
    return str(uuid.UUID(bytes=hashlib.md5(text.encode()).digest(), version=3))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class names by the order of links(component, seq, id1, id2, process), one component after another."""
    at, of = None, {}  # a class is [name, people]; the smaller set moves

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(of), pa.string()), pa.array([c[0] for c in of.values()], pa.string())], names=["person", "class_id"])

    for batch in batches:
        for component, _, x, y, process in zip(*(c.to_pylist() for c in batch.columns)):
            if component != at:
                if of:
                    yield rows()
                at, of = component, {}
            new = ("I-" if process[2:3] == "B" else "U-") + _uuid(x)
            cx, cy = of.get(x), of.get(y)
            if cx is None and cy is None:
                of[x] = of[y] = [new, {x, y}]
            elif cx is None or cy is None:
                known = cx or cy
                known[0] = new if new.startswith("I-") else known[0]
                known[1].update((x, y))
                of[x] = of[y] = known
            elif cx is not cy:
                name = cx[0] if cx[0].startswith("I-") else max(cx[0], cy[0])
                big, small = (cx, cy) if len(cx[1]) >= len(cy[1]) else (cy, cx)
                big[0] = name
                big[1].update(small[1])
                for person in small[1]:
                    of[person] = big
    if of:
        yield rows()


def replayed_classes(links: DataFrame) -> DataFrame:
    """(person, class_id) with ids that follow the order of links(seq, id1, id2, process).

    Ids start with I- if a link from births gave them, else U-. The order matters
    only within a component, so components are found first and each is replayed by
    itself; a task holds the people of one component. Where components may be too
    large for that, use classes().
    """
    found = components(links.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    placed = links.select("seq", "id1", "id2", "process").join(found.withColumnRenamed("node", "id1"), "id1").select("component", "seq", "id1", "id2", "process")
    return placed.repartition("component").sortWithinPartitions("component", "seq", "id1", "id2").mapInArrow(_replay, "person string, class_id string")


def size_distribution(members: DataFrame) -> DataFrame:
    return members.groupBy("class_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_classes"))


def verify(members: DataFrame) -> DataFrame:
    """Members counted both ways, and the largest class."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.sum("size").alias("n_members"), F.count("*").alias("n_classes"), F.max("size").alias("largest"))


_RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_PROV = "http://www.w3.org/ns/prov#"


def _named(namespace: str, name: Column) -> Column:
    """An IRI in a namespace; with _: a blank node."""
    return F.concat(F.lit("_:"), name) if namespace == "_:" else F.concat(F.lit(f"<{namespace}"), name, F.lit(">"))


def class_names(members: DataFrame, namespace: str = "https://www.example.org/") -> DataFrame:
    """(person, reconstruction): each person's class as a term of N-Triples."""
    return members.select("person", _named(namespace, F.col("class_uuid")).alias("reconstruction"))


def reconstruction(members: DataFrame, namespace: str = "https://www.example.org/", activity: str | None = None) -> DataFrame:
    """N-Triples lines (value) of the reconstructed persons; activity: the term of what made them."""
    named = class_names(members, namespace)
    kinds = [f" {_RDF_TYPE} <https://personsincontext.org/model#PersonReconstruction> ."] + [f" <{_PROV}wasGeneratedBy> {activity} ."] * (activity is not None)
    kind = named.select("reconstruction").distinct().select(F.explode(F.array(*(F.concat("reconstruction", F.lit(k)) for k in kinds))).alias("value"))
    parts = named.select(F.concat("reconstruction", F.lit(f" <{_PROV}wasDerivedFrom> <"), F.col("person"), F.lit("> .")).alias("value"))
    return kind.unionByName(parts)


def activity_lines(started: str, ended: str, user: str = "", namespace: str = "https://www.example.org/") -> tuple[str, list[str]]:
    """The term of the activity that made a reconstruction, and its N-Triples lines: who did it, from when to when (ISO times)."""
    term = lambda name: f"_:{_uuid(name)}" if namespace == "_:" else f"<{namespace}{_uuid(name)}>"
    it, when = term(started), lambda p, t: f'{term(started)} <{_PROV}{p}> "{t}"^^<http://www.w3.org/2001/XMLSchema#dateTime> .'
    lines = [f"{it} {_RDF_TYPE} <{_PROV}Activity> .", when("startedAtTime", started), when("endedAtTime", ended)]
    if user:
        who, safe = f"_:{_uuid(user)}", user.replace("\\", "\\\\").replace('"', '\\"')
        lines += [f"{it} <{_PROV}wasAssociatedWith> {who} .", f"{who} {_RDF_TYPE} <{_PROV}Agent> .", f'{who} <https://schema.org/name> "{safe}" .']
    return it, lines
