"""Links within a life: A's subject, with or without parents, is B's subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names, rules
from kinweave.operators import fuzzy
from kinweave.shared import kept


def turned(b: DataFrame, gender: str) -> DataFrame:
    """Marriages with the groom as subject for the male pass; other certificates as they are."""
    if gender != "MALE" or "partner_father" not in b.columns:
        return b
    swap = {"subject": "partner", "partner": "subject", "subject_father": "partner_father", "partner_father": "subject_father", "subject_mother": "partner_mother", "partner_mother": "subject_mother"}
    return b.select("event", "event_date", *(F.col(old).alias(new) for new, old in swap.items()))


def _valid(role: str):
    return names.is_valid(F.col(f"{role}.given"), F.col(f"{role}.family"), F.col("event"))


def _people(d: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(event, year, role, given, family) of the people in roles."""
    person = lambda s, r: F.struct(F.lit(s).alias("role"), F.col(f"{r}.given").alias("given"), F.col(f"{r}.family").alias("family"))
    return d.select("event", F.year("event_date").alias("year"), F.explode(F.array(*(person(*x) for x in roles.items()))).alias("x")).select("event", "year", "x.*")


def within(a: DataFrame, b: DataFrame, process: str, gender: str, most: int = 4, fixed: bool = False, block: bool = True, ignore_date: bool = False, relatives: bool = True, rule_set: dict | None = None) -> DataFrame:
    """Links of the FEMALE or MALE pass of within_b_m or within_b_d.

    kind: mother, father, both, or subject (without relatives). A mother or father
    with any candidate must agree for the others to count, so father links need a mother
    who is not valid or not found.
    """
    b = turned(b, gender)
    a = a.filter(_valid("subject") & names.gender_fits(F.col("subject.gender"), gender))
    b = b.filter(_valid("subject"))
    if process == "within_b_d":
        b = b.filter(names.gender_fits(F.col("subject.gender"), gender))
    if relatives:
        a = a.filter(_valid("subject_mother") | _valid("subject_father"))
        b = b.filter(_valid("subject_mother") | _valid("subject_father"))
    roles = {"s": "subject"} | ({"m": "subject_mother", "f": "subject_father"} if relatives else {})
    search = fuzzy.Search(_people(a, roles), _people(b, roles), most, fixed, block, same=("role",))
    span = None if ignore_date else rules.span(process, False, rule_set)
    hits = fuzzy.assigned(search.joint_hits([("s", "m"), ("s", "f")], span) if relatives else search.hits(span), ["role"])
    numbers = ("lev_total", "lev_max", "matched", "n_a", "n_b")
    one = lambda r: F.max(F.when(F.col("role") == r, F.struct(*numbers))).alias(r)
    rows = hits.groupBy("a_event", "b_event").agg(*map(one, roles)).filter("s is not null")
    rows = rows.select("a_event", "b_event", *(F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in roles for c in numbers))
    about_a = a.select(F.col("event").alias("a_event"), F.col("event_date").alias("a_date"), _valid("subject_mother").alias("vm"), _valid("subject_father").alias("vf"), F.col("subject.age").alias("a_age"), F.col("subject_mother.age").alias("a_mother_age"))
    about_b = b.select(F.col("event").alias("b_event"), F.col("event_date").alias("b_date"), _valid("subject_mother").alias("has_m"), _valid("subject_father").alias("has_f"), F.col("subject.age").alias("b_age"), F.col("subject_mother.age").alias("b_mother_age"))
    rows = rows.join(about_a, "a_event").join(about_b, "b_event")
    if relatives:
        in_m, in_f = F.col("m_matched").isNotNull(), F.col("f_matched").isNotNull()
        rows = kept(rows, "within")
        unsure = rows.filter(in_f & ~in_m & F.col("vm") & ~F.col("has_m")).select("a_event", F.lit("m").alias("role"))  # what is matched was found
        rows = rows.join(search.found(["role"], unsure).select("a_event", F.lit(True).alias("any_m")), "a_event", "left")  # in any year
        no_m = ~(F.col("vm") & F.coalesce("any_m", F.lit(False)))
        kinds = F.array(
            F.when(in_m & ~(F.col("vf") & F.col("has_f")), F.lit("mother")),
            F.when(in_f & (in_m | no_m) & ~(F.col("vm") & F.col("has_m")), F.lit("father")),
            F.when(in_m & in_f, F.lit("both")),
        )
        rows = rows.withColumn("kind", F.explode(F.array_compact(kinds)))
    else:
        rows = rows.withColumn("kind", F.lit("subject")).withColumns({f"{r}_{c}": F.lit(None).cast("int") for r in "mf" for c in numbers})
    rows = rows.withColumn("year_diff", F.lit(0) if ignore_date else names.year_gap(F.col("a_date"), F.col("b_date")))
    if not ignore_date:
        rows = rows.filter(rules.time_ok(process, F.col("year_diff"), rule_set))
    if process == "within_b_d":
        rows = rows.filter(rules.age_ok(process, F.col("year_diff"), F.coalesce("b_age", F.lit(-1)), rule_set))
        mother = rules.age_ok(process, F.col("year_diff"), names.age_gap(F.col("a_mother_age"), F.col("b_mother_age")), rule_set)
        rows = rows.filter(~F.col("kind").isin("mother", "both") | mother)
    enough = lambda r: ~((F.col(f"{r}_n_a") > 1) & (F.col(f"{r}_n_b") > 1) & (F.col(f"{r}_matched") < 2))
    rows = rows.filter(enough("s") & (~F.col("kind").isin("mother", "both") | enough("m")) & (~F.col("kind").isin("father", "both") | enough("f")))
    for r, kinds in (("m", ("mother", "both")), ("f", ("father", "both"))):
        rows = rows.withColumns({f"{r}_{c}": F.when(F.col("kind").isin(*kinds), F.col(f"{r}_{c}")) for c in numbers})
    return rows.select("a_event", "b_event", F.lit("21" if gender == "FEMALE" else "22").alias("family_line"), "kind", *(f"{r}_{c}" for r in "smf" for c in numbers), "year_diff")
