"""Links between marriages, person links, class ids, files and certificates."""

import datetime
import random

import pytest

from kinweave.operators import between, closure, couples, summaries
from kinweave.sources import certificates, link_files, triples

P = "struct<iri:string,given:string,family:string,gender:string,age:int>"
SCHEMA = f"event string, event_date date, subject {P}, partner {P}, subject_father {P}, subject_mother {P}, partner_father {P}, partner_mother {P}"


def _who(iri, given, family, gender, age=None):
    return (iri, given, family, gender, age)


def _marriage(event, year, bride, groom, bf=None, bm=None, gf=None, gm=None):
    return (event, datetime.date(year, 5, 1) if year else None, bride, groom, bf, bm, gf, gm)


ANNA, BERT = _who("a", "anna", "jansen", "f"), _who("b", "bert", "smit", "m")
AF, AM, BF, BM = _who("af", "albert", "jansen", "m"), _who("am", "agatha", "klaassen", "f"), _who("bf", "bernard", "smit", "m"), _who("bm", "beatrix", "visser", "f")
CARL = _who("c", "carl", "molenaar", "m")


def _links(spark, scenes, **options):
    """Links of several scenes in one run; a scene's family names end in eight letters of its own."""
    rows = []
    for k, marriages in scenes.items():
        own = lambda p: p and (p[0], p[1], p[2] + k * 8, *p[3:])  # noqa: E731, B023
        rows += [(f"{k}{m[0]}", m[1], *map(own, m[2:])) for m in marriages]
    m = spark.createDataFrame(rows, SCHEMA)
    out = {k: set() for k in scenes}
    for r in couples.couples(m, m, **options).collect():
        assert r.a_event[0] == r.b_event[0]
        out[r.a_event[0]].add((r.a_event[1], r.b_event[1], r.link, r.family_line, r.kind))
    return out


def _aged(person, age):
    return person[:4] + (age,)


FULL = [_marriage("x", 1850, ANNA, BERT, AF, AM, BF, BM), _marriage("y", 1855, ANNA, BERT, AF, AM, BF, BM)]
BRIDE_AGAIN = [_marriage("x", 1850, ANNA, BERT, AF, AM, BF, BM), _marriage("y", 1855, ANNA, CARL, AF, AM)]


def _ages(mother, bride):
    return [_marriage("x", 1850, _aged(ANNA, 20), BERT, None, _aged(AM, mother), BF), _marriage("y", 1855, _aged(ANNA, bride), BERT, None, _aged(AM, 47), BF)]


def test_couples(spark):
    scenes = {
        "a": FULL,
        "b": [m[:1] + (None,) + m[2:] for m in FULL],
        "c": [_marriage("x", 1850, ANNA, BERT, None, AM, BF, None), _marriage("y", 1855, ANNA, BERT, None, AM, BF, None)],
        "d": _ages(40, 27),
        "e": _ages(40, 28),
        "f": _ages(39, 27),
        "g": [_marriage("x", 1850, ANNA, BERT, AF, AM, BF, BM), _marriage("y", 1855, _who("d", "dora", "pietersen", "f"), BERT, None, None, BF, BM)],
        "h": BRIDE_AGAIN,
        "i": [_marriage("x", 1850, ANNA, None, AF, AM), _marriage("y", 1855, ANNA, CARL, AF, AM)],
    }
    weak = {("x", "y", "same_couple", "21", "mother"), ("x", "y", "same_couple", "22", "father")}
    want = {
        "a": {("x", "y", "same_couple", "21", "both"), ("x", "y", "same_couple", "22", "both")},
        "b": set(),
        "c": weak,
        "d": weak,
        "e": set(),
        "f": set(),
        "g": {("x", "y", "remarriage_groom", "22", "both")},
        "h": set(),
        "i": {("x", "y", "remarriage_bride", "21", "both")},
    }
    assert _links(spark, scenes) == want


def test_couples_with_options(spark):
    got = _links(spark, {"a": FULL, "h": BRIDE_AGAIN}, ignore_date=True, bride_remarriage=True)
    assert len(got["a"]) == 4 and got["h"] == {(*e, "remarriage_bride", "21", "both") for e in (("x", "y"), ("y", "x"))}


def test_within_person_links(spark):
    births = spark.createDataFrame([("e", None, ANNA, AF, AM)], f"event string, event_date date, subject {P}, subject_father {P}, subject_mother {P}")
    marriages = spark.createDataFrame([_marriage("m", 1850, _who("a2", "anna", "jansen", "f"), BERT, None, _who("am2", "agatha", "klaassen", "f"), _who("z", "z", "z", "m"))], SCHEMA)
    numbers = ", ".join(f"{r}_{c} int" for r in "smf" for c in couples.NUMBERS)
    link = lambda line: spark.createDataFrame([("e", "m", line, "both", *range(15), 20)], f"a_event string, b_event string, family_line string, kind string, {numbers}, year_diff int")
    got = {(r.id1, r.id2, r.n_matched, r.lev_total) for r in closure.within_person_links(link("21"), births, marriages, "W_B-M").collect()}
    assert got == {("a", "a2", 2, 0), ("am", "am2", 2, 5)}
    got = {(r.id1, r.id2, r.n_matched, r.lev_total) for r in closure.within_person_links(link("22"), births, marriages, "W_B-M").collect()}
    assert got == {("a", "b", 2, 0), ("af", "z", 2, 10)}


def _in_order(links):
    """Sequential class naming over all links at once."""
    of, members = {}, {}
    for x, y, process in links:
        new = ("I-" if process[2] == "B" else "U-") + closure._uuid(x)
        cx, cy = of.get(x), of.get(y)
        people = {x, y} | members.pop(cx, set()) | members.pop(cy, set())
        if not cx and not cy:
            name = new
        elif not cx or not cy:
            name = new if new[0] == "I" else cx or cy
        else:
            name = cx if cx[0] == "I" else max(cx, cy)
        members[name] = people
        of |= dict.fromkeys(people, name)
    return of


def test_replayed_classes(spark):
    rng = random.Random(5)
    links = []
    while len(links) < 150:
        x, y = sorted((f"p{rng.randrange(160)}", f"p{rng.randrange(160)}"))
        if x != y:
            links.append((x, y, rng.choice(["W_B-M", "B_D-M", "B_M-M"])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(links)], "seq long, id1 string, id2 string, process string")
    assert dict(tuple(r) for r in closure.replayed_classes(df).collect()) == _in_order(links)


def test_files(spark, tmp_path):
    assert link_files.suffix(3, True, True, True, True) == "-maxLev-3-fixed-singleInd-ignoreDate-ignoreBlock"
    births = spark.createDataFrame([("e", datetime.date(1851, 1, 1), _who("k", "kees", "smit", "m"), BERT, ANNA)], f"event string, event_date date, subject {P}, subject_father {P}, subject_mother {P}")
    links = between.between(births, spark.createDataFrame([_marriage("m", 1850, ANNA, BERT)], SCHEMA), "between_b_m")
    path = link_files.write(link_files.as_certificate_file(links), link_files.place(str(tmp_path), "between_b_m", link_files.suffix()))
    assert path.endswith("/between_b-m-maxLev-4/results/BETWEEN_B-M-maxLev-4.csv")
    assert link_files.found(spark, str(tmp_path)) == [path] and link_files.process_of(path) == "between_b_m"
    assert spark.read.option("header", True).csv(path).first()["family_line"] == "N.A."
    back = link_files.read_certificate_file(spark, path)
    cols = [c for c in links.columns if c in back.columns]
    assert set(links.columns) == set(cols) and back.select(cols).collect() == links.select(cols).collect()


def test_certificates(spark):
    civ, sdo = certificates.CIV, certificates.SCHEMA
    lines = [f"<e> <{civ}newborn> <k> .", f'<e> <{civ}eventDate> "1850-02-03" .', f'<k> <{sdo}givenName> "kees" .', f"<e> <{civ}father> <b> .", f"<e> <{civ}mother> <a> ."]
    lines += [f'<b> <{sdo}givenName> "bert" .', f'<b> <{sdo}familyName> "smit" .', f"<b> <{sdo}gender> <{sdo}Male> .", f'<b> <{civ}age> "30" .', f'<a> <{sdo}givenName> "anna" .']
    lines += [f"<f> <{civ}newborn> <n> .", f'<f> <{civ}eventDate> "1850" .', f"<g> <{civ}newborn> <o> ."]
    t = triples.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.event: r for r in certificates.certificates(t, "births").collect()}
    assert set(got) == {"e", "f"} and got["f"].event_date is None and got["f"].subject.iri == "n"
    e = got["e"]
    assert (e.event_date, e.subject.given, e.subject.family, e.subject_mother) == (datetime.date(1850, 2, 3), "kees", None, None)
    assert tuple(e.subject_father) == ("b", "bert", "smit", f"{sdo}Male", 30)


@pytest.mark.parametrize("text", ["X within_b-m.csv", "WITHIN_B-M-maxLev-4.csv"])
def test_process_names(text):
    assert link_files.process_of(text) == "within_b_m" and link_files.title("within_b_m") == "WITHIN_B-M" and link_files.short_title("within_b_m") == "W_B-M"


def test_summaries(spark):
    m = spark.createDataFrame([_marriage("x", 1850, ANNA, BERT, AF, AM, BF, None), _marriage("y", 1850, ANNA, BERT, None, AM), _marriage("z", 1850, ANNA, None, AF), _marriage("u", 1850, None, BERT)], SCHEMA)
    assert tuple(summaries.index_summary_single(m).first()) == (4, 3) and tuple(summaries.index_summary_couples(m).first()) == (4, 2)
    assert summaries.index_summary_marriages(m).first().asDict() == {"total": 4, "indexed": 3, "mother_only": 1, "father_only": 1, "both_parents": 1, "partner": 2, "partner_mother_only": 0, "partner_father_only": 1, "partner_both_parents": 0}
    pair = "a_event string, b_event string, link string, kind string"
    all_of = spark.createDataFrame([("a", "b", "same_couple", "both"), ("a", "c", "same_couple", "mother"), ("a", "d", "remarriage_groom", "father")], pair)
    kept = spark.createDataFrame([("a", "b", "same_couple", "both"), ("a", "b", "same_couple", "both"), ("a", "c", "same_couple", "mother")], pair)
    counts = summaries.candidate_summary(all_of, kept)
    assert tuple(counts.first()) == (3, 2, 1, 1) and {tuple(r) for r in summaries.shown(counts).collect()} == {("discovered", "3"), ("passed", "2"), ("failed", "1"), ("duplicates", "1")}
    assert {tuple(r) for r in summaries.match_strength(all_of).collect()} == {("same_couple", "strong", 1), ("same_couple", "weak", 1), ("remarriage_groom", "weak", 1)}


def test_activity(spark):
    it, lines = closure.activity_lines("2020-01-01T00:00:00", "2020-01-02T00:00:00", 'me "x"', "_:")
    members = spark.createDataFrame([("p", "c1"), ("q", "c1")], "person string, class_uuid string")
    out = [r.value for r in closure.reconstruction(members, "_:", it).collect()] + lines
    assert f"_:c1 <http://www.w3.org/ns/prov#wasGeneratedBy> {it} ." in out and len(out) == 4 + 6
    assert triples.parse(spark.createDataFrame([(x,) for x in out], "value string")).count() == len(out)


def test_first_row_of_an_event(spark):
    births = [("e", None, ("k2", "x", "y", "m", 1), None, None), ("e", None, ("k1", "x", "y", "m", 1), None, None)]
    df = spark.createDataFrame(births, f"event string, event_date date, subject {P}, subject_father {P}, subject_mother {P}")
    assert closure._first(df, "subject.iri").first().iri == "k1"


def test_closure_terms(spark):
    members = spark.createDataFrame([("b", "I-1"), ("a", "I-1"), ("c", "U-2")], "person string, class_id string")
    assert sorted(r.value for r in link_files.closure_terms(members).collect()) == ["I-1,a,b", "U-2,c"]
