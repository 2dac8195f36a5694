"""Links between two marriages within a life: the same couple again, or one spouse's remarriage.

The six roles are searched together, so a pair of names is compared once for all of them,
and one grouping by (a_event, b_event) brings a pair's roles together. A role's hits bind
only if A's person has any, in whatever year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names, rules
from kinweave.operators import fuzzy
from kinweave.shared import kept

PROCESS = "within_m_m"
#: Short name and role of the bride's and the groom's side.
ROLES = {"s": "subject", "sm": "subject_mother", "sf": "subject_father", "p": "partner", "pm": "partner_mother", "pf": "partner_father"}
NUMBERS = ("lev_total", "lev_max", "matched", "n_a", "n_b")


def valid(role: str) -> Column:
    return names.is_valid(F.col(f"{role}.given"), F.col(f"{role}.family"), F.col("event"))


def _searched(m: DataFrame) -> DataFrame:
    """Marriages that may search: the groom or a parent of the bride is valid."""
    return m.filter(valid("partner") | valid("subject_mother") | valid("subject_father"))


def _people(m: DataFrame, indexed: bool) -> DataFrame:
    """(event, role, given, family) of all six roles.

    Indexed are brides that are valid with a valid groom or parent, and the
    others of their marriages, the groom's parents only if the groom is valid.
    """
    if indexed:
        m = m.filter(valid("subject") & (valid("partner") | valid("subject_mother") | valid("subject_father")))
    person = lambda s, r: F.struct(F.lit(s).alias("role"), F.col(f"{r}.given").alias("given"), F.col(f"{r}.family").alias("family"))
    roles = [F.when(valid("partner"), person(s, r)) if indexed and s in ("pm", "pf") else person(s, r) for s, r in ROLES.items()]
    return m.select("event", F.year("event_date").alias("year"), F.explode(F.array_compact(F.array(*roles))).alias("x")).select("event", "year", "x.*")


def _found(short: str) -> Column:
    return F.col(f"{short}_matched").isNotNull()


def _any(short: str) -> Column:
    return F.col(f"any_{short}")


def _binds(short: str) -> Column:
    return ~_any(short) | _found(short)


def couples(a: DataFrame, b: DataFrame, most: int = 4, fixed: bool = False, block: bool = True, ignore_date: bool = False, rule_set: dict | None = None, bride_remarriage: bool = False, check_father_age: bool = False, in_order: bool = False) -> DataFrame:
    """Rows (a_event, b_event, link, family_line, kind, numbers of s, m and f, year_diff), each once.

    link: same_couple, remarriage_groom or remarriage_bride; kind: mother, father or both,
    the parents of that spouse that agree. A bride's remarriage counts only where A's
    groom has no hit at all; bride_remarriage takes every other marriage of the bride as well.
    Fathers' ages are compared only with check_father_age. Marriages without a date link
    only with ignore_date, which still checks ages against a gap of 0. Years are whole ones, cut
    towards zero, so B may lie up to a year before A; not with in_order.
    """
    a = _searched(a)
    search = fuzzy.Search(_people(a, False), _people(b, True), most, fixed, block, same=("role",))
    span = None if ignore_date else rules.span(PROCESS, False, rule_set)
    hits = fuzzy.assigned(search.joint_hits([("s", "sm"), ("s", "sf"), ("p", "pm"), ("p", "pf")], span).filter("a_event <> b_event"), ["role"])  # each link needs a spouse and a parent
    numbers = lambda s: F.max(F.when(F.col("role") == s, F.struct(*NUMBERS))).alias(s)
    rows = hits.groupBy("a_event", "b_event").agg(*(numbers(s) for s in ROLES)).filter("s is not null or p is not null")
    rows = rows.select("a_event", "b_event", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ROLES for c in NUMBERS))
    rows = kept(rows, "couples")
    unsure = rows.select("a_event", F.explode(F.array_compact(F.array(*(F.when(~_found(s), F.lit(s)) for s in ROLES if s != "s")))).alias("role"))  # what is matched was found
    known = search.found(["role"], unsure).groupBy("a_event").agg(*(F.max(F.col("role") == s).alias(f"any_{s}") for s in ROLES))
    rows = rows.join(known, "a_event", "left").withColumns({f"any_{s}": F.coalesce(f"any_{s}", F.lit(False)) | _found(s) for s in ROLES})
    same = _found("s") & _found("p") & _binds("sm") & _binds("sf") & _binds("pm") & _binds("pf")
    groom = _found("p") & _binds("pm") & _binds("pf") & ~same
    bride = _found("s") & _binds("sm") & _binds("sf") & ~same & (F.lit(True) if bride_remarriage else ~_any("p"))
    ways = F.array(F.when(same, F.lit("same_couple")), F.when(groom, F.lit("remarriage_groom")), F.when(bride, F.lit("remarriage_bride")))
    rows = rows.withColumn("link", F.explode(F.array_compact(ways)))

    about = lambda d, x: d.select(F.col("event").alias(f"{x}_event"), F.col("event_date").alias(f"{x}_date"), *(F.col(f"{r}.{c}").alias(f"{x}_{s}_{c}") for s, r in ROLES.items() for c in ("age", "gender")))
    rows = rows.join(about(a, "a"), "a_event").join(about(b, "b"), "b_event")
    rows = rows.withColumn("year_diff", F.lit(0) if ignore_date else names.year_gap(F.col("a_date"), F.col("b_date")))
    if not ignore_date:
        rows = rows.filter(rules.time_ok(PROCESS, F.col("year_diff"), rule_set))
    if in_order:
        rows = rows.filter("b_date >= a_date")

    def aged(s: str) -> Column:
        if s in ("sf", "pf") and not check_father_age:
            return F.lit(True)
        return rules.age_ok(PROCESS, F.col("year_diff"), names.age_gap(F.col(f"a_{s}_age"), F.col(f"b_{s}_age")), rule_set)

    ok = {s: _any(s) & _found(s) & aged(s) for s in ("sm", "sf", "pm", "pf")}
    row = lambda side, kind: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<side:string,kind:string>>")
    grooms = F.array_compact(F.array(F.when(ok["pm"], row("p", "mother")), F.when(ok["pf"], row("p", "father"))))
    of_bride = F.when(ok["sm"], row("s", "mother")).otherwise(row("s", "father"))
    four = ok["sm"] & ok["sf"] & ok["pm"] & ok["pf"]
    pair = F.when(four, F.array(row("s", "both"), row("p", "both"))).when((ok["sm"] | ok["sf"]) & (ok["pm"] | ok["pf"]), F.concat(F.array(of_bride), grooms)).otherwise(none)

    def alone(side: str) -> Column:
        mother, father = ok[f"{side}m"], ok[f"{side}f"]
        return F.when(mother & father, F.array(row(side, "both"))).when(mother, F.array(row(side, "mother"))).when(father, F.array(row(side, "father"))).otherwise(none)

    out = F.when((F.col("link") == "same_couple") & aged("s") & aged("p"), pair).when((F.col("link") == "remarriage_groom") & aged("p"), alone("p")).when((F.col("link") == "remarriage_bride") & aged("s"), alone("s")).otherwise(none)
    rows = rows.withColumn("_o", F.explode(out)).withColumns({"side": F.col("_o.side"), "kind": F.col("_o.kind")})

    mine = lambda s, p: F.when(F.col("side") == "s", F.col(s)).otherwise(F.col(p))
    part = {"m": ("mother", "both"), "f": ("father", "both")}
    picked = {f"{r}_{c}": mine(f"s{r}_{c}", f"p{r}_{c}") for r in part for c in NUMBERS}
    rows = rows.select("a_event", "b_event", "link", F.when(mine("a_s_gender", "a_p_gender").isNotNull() & (names.gender(mine("a_s_gender", "a_p_gender")) == "MALE"), "22").otherwise("21").alias("family_line"), "kind",
        *(mine(f"s_{c}", f"p_{c}").alias(f"s_{c}") for c in NUMBERS), *(F.when(F.col("kind").isin(*part[n[0]]), x).alias(n) for n, x in picked.items()), "year_diff")
    enough = lambda r: F.coalesce(~((F.col(f"{r}_n_a") > 1) & (F.col(f"{r}_n_b") > 1) & (F.col(f"{r}_matched") < 2)), F.lit(True))
    return rows.filter(enough("s") & enough("m") & enough("f")).distinct()
