"""Every way of a search gives the same hits: pair by pair, by keys, and by two relatives at once."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import fuzzy


def _folk(spark, seed):
    rng = random.Random(seed)
    name = lambda low, high: "".join(rng.choices("abc", k=rng.randint(low, high)))
    rows = [(f"e{i % 70}", role, 1850 + rng.randint(0, 30), name(2, 4) + rng.choice(("", " " + name(2, 3))), name(3, 12)) for i in range(80) for role in "mf"]
    return spark.createDataFrame(rows, "event string, role string, year int, given string, family string")


@pytest.mark.parametrize("block", (True, False))
def test_ways_agree(spark, monkeypatch, block):
    a, b = _folk(spark, 1), _folk(spark, 2)
    rows = lambda d: {tuple(r) for r in d.select(*sorted(d.columns)).collect()}
    search = fuzzy.Search(a, b, block=block, same=("role",))
    near = lambda x, y: F.levenshtein(x, y) <= fuzzy.names.allowed(F.length(x), 4)
    all_of = search.probe.join(search.index.withColumnRenamed("year", "b_year"), "role").filter(near("a_last", "last") & near("src", "fn") & (F.col("b_year") - F.col("year")).between(-5, 20))
    if block:
        all_of = all_of.filter(F.substring("a_last", 1, 1) == F.substring("last", 1, 1))
    want = rows(all_of.select("a_event", "role", "year", "n_a", "src", "b_event", "fn", "n_b", F.levenshtein("src", "fn").alias("fn_distance"), F.levenshtein("a_last", "last").alias("last_distance")))
    assert want and rows(search.hits((-5, 20))) == want
    pair = lambda hits: {(r[0], r[1]) for r in hits}  # noqa: E731  a_event, b_event: the first columns by name
    both = pair(x for x in want if "m" in x) & pair(x for x in want if "f" in x)
    joint = rows(search.joint_hits([("m", "f")], (-5, 20)))
    assert joint <= want and {x for x in want if (x[0], x[1]) in both} <= joint
    found = rows(search.found(["role"]))
    monkeypatch.setattr(fuzzy, "MOST_PAIRS", -1)
    assert rows(search.hits((-5, 20))) == want and rows(search.found(["role"])) == found
    assert found == {(r.a_event, r.role) for r in search.hits().collect()}


def test_joint_search_skips_the_others(spark):
    """A mother that many have is no hit where the father doesn't fit."""
    rows = [(f"e{i}", role, "anna" if role == "m" else "jan", "smit" if role == "m" else f"{'abcdefgh'[i % 8]}akkerman") for i in range(40) for role in "mf"]
    folk = spark.createDataFrame(rows, "event string, role string, given string, family string")
    search = fuzzy.Search(folk, folk, same=("role",))
    assert search.hits().filter("role = 'm'").count() == 1600 and search.joint_hits([("m", "f")]).count() == 2 * 200
