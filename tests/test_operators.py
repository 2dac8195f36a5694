import datetime
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import names, rules
from kinweave.operators import fuzzy
from kinweave.operators.components import components
from kinweave.sources import triples


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _allowed(n, most):
    return 0 if not n else names.ALLOWED[most][0 if n == 1 else 1 if n < 6 else 2 if n < 9 else 3 if n < 12 else 4]


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_pairs_match_brute_force(spark, most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 13))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    a, b = df.select(F.col("w").alias("a")), df.select(F.col("w").alias("b"))
    want = {(x, y, d) for x in words for y in words if (d := _lev(x, y)) <= _allowed(len(x), most)}
    assert {tuple(r) for r in fuzzy.pairs_unblocked(a, b, most).collect()} == want
    assert {tuple(r) for r in fuzzy.pairs_blocked(a, b, most).collect()} == {p for p in want if p[0][0] == p[1][0]}


@pytest.mark.parametrize("most, fixed", [(2, True), (3, False), (4, False), (4, True)])
def test_long_pairs_match_brute_force(spark, most, fixed):
    rng = random.Random(most)
    words = {"", "a", "ab"}
    for n in [*range(9, 24), 41, 45]:
        word = "".join(rng.choice("abcdef") for _ in range(n))
        words.add(word)
        for _ in range(6):  # names some edits apart
            chars = list(word)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(chars))
                rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, rng.choice("abc")), lambda: chars.__setitem__(at, "z")])()  # noqa: B023
            words.add("".join(chars))
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    allowed = lambda n: most if fixed and n else _allowed(n, most)
    want = {(x, y, d) for x in words for y in words if (d := _lev(x, y)) <= allowed(len(x))}
    a, b = df.select(F.col("w").alias("a")), df.select(F.col("w").alias("b"))
    assert {tuple(r) for r in fuzzy.pairs_unblocked(a, b, most, fixed).collect()} == want
    assert {tuple(r) for r in fuzzy.pairs_blocked(a, b, most, fixed).collect()} == {p for p in want if p[0][:1] and p[0][:1] == p[1][:1]}


def test_year_windows(spark):
    assert rules.span("between_b_m", True) == (-37, 6) and rules.span("within_b_m", False) == (13, 81)
    assert rules.span("within_b_m", False, {}) is None and rules.span("x", False, {("x", "timegapdiff"): "diff > 3"}) is None
    people = [("e", "anna", "smit", y) for y in range(1800, 1900)]
    df = spark.createDataFrame([(f"{e}{y}", g, f, y) for e, g, f, y in people], "event string, given string, family string, year int")
    search = fuzzy.Search(df, df)
    got = {(r.a_event, r.b_event) for r in search.hits((-3, 20)).collect()}
    assert got == {(f"e{y}", f"e{z}") for y in range(1800, 1900) for z in range(1800, 1900) if -3 <= z - y <= 20}
    assert search.hits().count() == 100 * 100 and search.found([]).count() == 100


def test_names(spark):
    rows = spark.createDataFrame([("jan-karel",), ("jan karel ",), ("jan  karel",), ("__",), ("",), (None,)], "g string")
    got = rows.select(names.first_names(F.col("g")), names.probe_count(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(["jan", "karel"], 1), (["jan", "karel"], 3), (["jan", "", "karel"], 3), ([], 1), (None, -1), (None, -1)]


def test_combinations_and_durations(spark):
    rows = spark.createDataFrame([("a b-c", "x y"), ("a", "x"), ("", "x"), (None, "x")], "g string, f string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in rows.select(names.combinations(F.col("g"), F.col("f"))).collect()]
    assert got[0] == [("a x_y", 1, 3), ("a_b x_y", 2, 3), ("a_b_c x_y", 3, 3), ("b x_y", 1, 3), ("b_a x_y", 2, 3), ("b_a_c x_y", 3, 3), ("c x_y", 1, 3), ("c_a x_y", 2, 3), ("c_a_b x_y", 3, 3)]
    assert got[1:] == [[("a x", 1, 1)], None, None]
    times = spark.createDataFrame([(0,), (3725,), (360000,)], "s long").select(names.duration(F.col("s"))).collect()
    assert [r[0] for r in times] == ["00:00:00", "01:02:05", "100:00:00"]


def test_common_events(spark):
    one, other = (spark.createDataFrame(r, "a_event string, b_event string, distance int, n int") for r in ([("a", "b", 1, 2), ("a", "c", 0, 1)], [("a", "b", 3, 1)]))
    assert [tuple(r) for r in fuzzy.common_events(one, other).collect()] == [("a", "b", "1-3", "2-1")]


def test_year_gap(spark):
    d = datetime.date
    rows = spark.createDataFrame([(d(1856, 2, 29), d(1857, 2, 28)), (d(1857, 1, 1), d(1856, 1, 1)), (d(1857, 1, 1), d(1856, 1, 2))], "a date, b date")
    assert [r[0] for r in rows.select(names.year_gap(F.col("a"), F.col("b"))).collect()] == [0, -1, 0]


def test_rules(spark):
    rows = spark.range(-3, 6).select(F.col("id"), rules.condition("diff >= 0 && (diff < 2 || !(diff != 4));", F.col("id")).alias("ok"))
    assert [r.id for r in rows.filter("ok").collect()] == [0, 1, 4]
    with pytest.raises(ValueError):
        rules.condition("import os", F.lit(1))


def test_greedy_assignment(spark):
    hits = spark.createDataFrame([("a", 2, "x", "b", "p", 2, 0, 1), ("a", 2, "x", "b", "q", 2, 1, 1), ("a", 2, "y", "b", "p", 2, 0, 1)], "a_event string, n_a int, src string, b_event string, fn string, n_b int, fn_distance int, last_distance int")
    r = fuzzy.assigned(hits, []).first()
    assert (r.matched, r.lev_total, r.lev_max) == (2, 2, 1)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(up)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_triples(spark):
    lines = ['<urn:a> <urn:p> "x \\"y\\""@en .', "<urn:a> <urn:q> _:b1 .", "# note", '<urn:a> <urn:r> "3"^^<urn:int> <urn:g> .', "<urn:a> <urn:q> _:b1 ."]
    got = {tuple(r) for r in triples.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("urn:a", "urn:p", 'x "y"', "literal", None, "en", None), ("urn:a", "urn:q", "_:b1", "bnode", None, None, None), ("urn:a", "urn:r", "3", "literal", "urn:int", None, "urn:g")}
