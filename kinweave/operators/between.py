"""Links between certificates: A's parents are B's couple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names, rules
from kinweave.operators import fuzzy

#: Processes that count years from B to A.
_BACKWARDS = {"between_b_m", "between_d_m", "between_m_m"}
_NUMBERS = ("lev_total", "lev_max", "matched", "n_a", "n_b")


def _people(df: DataFrame, roles: dict[str, str], *rest: str) -> DataFrame:
    """(event, year, given, family, sex) and rest of the people in roles, a column by sex."""
    person = lambda sex, r: F.struct(F.lit(sex).alias("sex"), F.col(f"{r}.given").alias("given"), F.col(f"{r}.family").alias("family"))
    return df.select("event", F.year("event_date").alias("year"), *rest, F.explode(F.array(*(person(*x) for x in roles.items()))).alias("x")).select("event", "year", *rest, "x.*")


def couples_b(b: DataFrame) -> DataFrame:
    """(event, event_date, female, male) of B's couples: both valid, and one of them FEMALE, the subject tested first."""
    ok = lambda r: names.is_valid(F.col(f"{r}.given"), F.col(f"{r}.family"), F.col("event"))
    s, p = F.col("subject"), F.col("partner")
    first, second = names.gender(F.col("subject.gender")) == "FEMALE", names.gender(F.col("partner.gender")) == "FEMALE"
    return b.filter(ok("subject") & ok("partner") & (first | second)).select("event", "event_date", names.gender(F.col("subject.gender")).alias("subject_gender"), F.when(first, s).otherwise(p).alias("female"), F.when(first, p).otherwise(s).alias("male"))


def parents_a(a: DataFrame, both_sides: bool) -> DataFrame:
    """(event, event_date, code, mother, father): the subject's parents (21), and the partner's (22) if both_sides."""
    side = lambda r, code: F.struct(F.lit(code).alias("code"), F.col(f"{r}_mother").alias("mother"), F.col(f"{r}_father").alias("father"))
    sides = [side("subject", "21")] + [side("partner", "22")] * both_sides
    out = a.withColumn("_c", F.explode(F.array(*sides))).select("event", "event_date", "_c.code", "_c.mother", "_c.father")
    ok = lambda r: names.is_valid(F.col(f"{r}.given"), F.col(f"{r}.family"), F.col("event"))
    return out.filter(ok("mother") & ok("father"))


def between(a: DataFrame, b: DataFrame, process: str, most: int = 4, fixed: bool = False, block: bool = True, ignore_date: bool = False, rule_set: dict | None = None) -> DataFrame:
    """Links of a process: both parents of A match the couple of B, by name and date.

    Missing numbers are null; the sink writes them as N.A.
    """
    two = process == "between_m_m"
    pa, cb = parents_a(a, two), couples_b(b)
    search = fuzzy.Search(_people(pa, {"male": "father", "female": "mother"}, "code"), _people(cb, {"male": "male", "female": "female"}), most, fixed, block, same=("sex",))
    backwards = process in _BACKWARDS
    hits = fuzzy.assigned(search.joint_hits([("male", "female")], None if ignore_date else rules.span(process, backwards, rule_set)), ["code", "sex"]).filter(fuzzy.enough_names())
    one = lambda sex: F.max(F.when(F.col("sex") == sex, F.struct(*_NUMBERS))).alias(sex)
    links = hits.groupBy("code", "a_event", "b_event").agg(one("male"), one("female")).filter("male is not null and female is not null")
    links = links.select("code", "a_event", "b_event", *(F.col(f"{sex}.{c}").alias(f"{sex}_{c}") for sex in ("male", "female") for c in _NUMBERS))
    links = links.join(pa.select(F.col("event").alias("a_event"), F.col("event_date").alias("a_date")).distinct(), "a_event").join(cb.select(F.col("event").alias("b_event"), F.col("event_date").alias("b_date"), "subject_gender").distinct(), "b_event")
    gap = names.year_gap(F.col("b_date"), F.col("a_date")) if backwards else names.year_gap(F.col("a_date"), F.col("b_date"))
    links = links.withColumn("year_diff", F.lit(0) if ignore_date else gap).filter("subject_gender <> 'UNKNOWN'")
    if not ignore_date:
        links = links.filter(rules.time_ok(process, F.col("year_diff"), rule_set))
    return links.select("a_event", "b_event", F.when(F.lit(two), F.col("code")).alias("family_line"), *(c for c in links.columns if c.startswith(("male_", "female_"))), "year_diff")
