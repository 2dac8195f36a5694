"""Queries for the branches the main ones don't reach: passes, missing relatives, ages, options, the SELECT language, sources and counters.

Certificates are made from customers. Names have 3 to 12 letters, so every class of lengths
is searched; relatives are missing in turn; the other certificate has edited names, and ages that fit or
don't. Each query's SQL compares names directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.operators import between, closure, couples, fuzzy, summaries, within
from kinweave.plans.registry import _BETWEEN_SQL, _CLASSES_SQL, _COUPLES_SQL, _NEAR, _PACKED, _PEOPLE_SQL, _UUID_SQL, _WEDDINGS, ORACLES, QUERIES, _classes, _graph, _links, _made, _name, _query, _table, births, weddings
from kinweave.sources import certificates, csvw, link_files, person_csv, sparql, triples

_LENGTH = lambda low, of, n: f"{low} + {of} % {n}"
_CUT = "case when k % 3 = 0 and length({0}) > 3 then substr({0}, 1, 2) || 'z' || substr({0}, 4, 20) when k % 7 = 2 then substr({0}, 1, length({0}) - 1) else {0} end"

#: Children (s), mothers (m) and fathers (f): given (g) and last names (l); those of the later certificate end in 2.
_FOLK = f"""
select k, sex, days, gap, sg, sl, case when k % 5 <> 1 then mg end as mg, case when k % 5 <> 1 then ml end as ml, case when k % 5 <> 2 then fg end as fg, case when k % 5 <> 2 then sl end as fl, mage,
  {_CUT.format('sg')} as sg2, {_CUT.format('sl')} as sl2, case when k % 11 <> 3 then {_CUT.format('mg')} end as mg2, case when k % 11 <> 3 then ml end as ml2, case when k % 11 <> 4 then fg end as fg2,
  case when k % 11 <> 4 then {_CUT.format('sl')} end as fl2, case when k % 6 = 5 then null else gap + k % 6 - 1 end as age2, mage + gap + k % 4 as mage2, mg as wg, ml as wl, fg as hg, sl as hl
from (
  select cast(c_custkey as int) as k, case when c_custkey % 13 = 0 then 'x' when c_custkey % 2 = 0 then 'f' else 'm' end as sex, cast(c_custkey % 9000 as int) as days, cast(c_custkey % 9 * 10 as int) as gap,
    {_name('g', _LENGTH(3, 'c_custkey % 97', 8), 'c_custkey % 97')} as sg, {_name('x', _LENGTH(4, 'c_custkey', 9), 'c_custkey')} as sl, {_name('m', _LENGTH(4, 'c_custkey % 79', 6), 'c_custkey % 79')} as mg,
    {_name('y', _LENGTH(3, 'c_custkey', 6), 'c_custkey')} as ml, {_name('f', _LENGTH(4, 'c_custkey % 83', 5), 'c_custkey % 83')} as fg, cast(20 + c_custkey % 20 as int) as mage
  from customer) as c
"""
_FOLK_SQL = _FOLK.replace("as string", "as varchar")
_VALID = lambda r: f"(length({r}g) > 0 and {r}g <> 'n' and length({r}l) > 0)"


def _folk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _FOLK)


def _day(days: str, start: str = "1840-01-01"):
    return F.expr(f"date_add(date '{start}', cast({days} as int))").alias("event_date")


def _who(iri: str, given: str, family: str, gender: str, age: str = "cast(null as int)"):
    return F.when(F.expr(f"{given} is not null"), F.struct(F.expr(f"'{iri}' || k").alias("iri"), F.expr(given).alias("given"), F.expr(family).alias("family"), F.expr(gender).alias("gender"), F.expr(age).cast("int").alias("age")))


def folk_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folk(spark, sf_dir).select(F.expr("'b' || k").alias("event"), _day("days"), _who("bs", "sg", "sl", "sex").alias("subject"), _who("bf", "fg", "fl", "'m'").alias("subject_father"), _who("bm", "mg", "ml", "'f'", "mage").alias("subject_mother"))


def folk_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children's deaths, up to 80 years on; their partners are not named."""
    p = _folk(spark, sf_dir)
    return p.select(F.expr("'d' || k").alias("event"), _day("days + 366 * gap"), _who("ds", "sg2", "sl2", "sex", "age2").alias("subject"), _who("df", "fg2", "fl2", "'m'").alias("subject_father"), _who("dm", "mg2", "ml2", "'f'", "mage2").alias("subject_mother"), F.lit(None).cast(certificates.PERSON).alias("partner"))


def folk_weddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sons' marriages, 20 to 100 years on, with unnamed brides."""
    p = _folk(spark, sf_dir)
    none = F.lit(None).cast(certificates.PERSON)
    return p.select(F.expr("'w' || k").alias("event"), _day("days + 366 * gap", "1860-01-01"), none.alias("subject"), _who("ws", "sg2", "sl2", "'m'").alias("partner"), none.alias("subject_father"), none.alias("subject_mother"), _who("wf", "fg2", "fl2", "'m'").alias("partner_father"), _who("wm", "mg2", "ml2", "'f'").alias("partner_mother"))


def _pairs_sql(x: str) -> str:
    """Pairs of a and b whose person x matches."""
    return f"select a.k as ak, b.k as bk from a join b on left(a.{x}l, 1) = left(b.{x}l2, 1) where {_VALID('a.' + x)} and b.{x}g2 is not null and {_NEAR(f'a.{x}l', f'b.{x}l2')} and {_NEAR(f'a.{x}g', f'b.{x}g2')}"


def _within_sql(sexes: str, b_sexes: str, line: str, start: str, low: int, high: int, aged: bool) -> str:
    gap = "(y - age2)"
    mother_gap = "(case when b_mage >= a_mage then b_mage - a_mage else -1 end)"
    age_ok = f"and (age2 is null or age2 < 0 or abs({gap}) <= 2)" if aged else ""
    mother_ok = f"and (kind = 'father' or {mother_gap} < 0 or abs(y - {mother_gap}) <= 2)" if aged else ""
    return f"""
with p as ({_FOLK_SQL}), a as (select *, DATE '1840-01-01' + days as d from p where sex in ({sexes}) and (mg is not null or fg is not null)),
b as (select *, DATE '{start}' + (days + 366 * gap) as d2 from p where {b_sexes} (mg2 is not null or fg2 is not null)),
s as ({_pairs_sql('s')}), m as ({_pairs_sql('m')}), f as ({_pairs_sql('f')}),
x as (
  select s.ak, s.bk, m.ak is not null as in_m, f.ak is not null as in_f, s.ak in (select ak from m) as any_m, s.ak in (select ak from f) as any_f
  from s left join m on m.ak = s.ak and m.bk = s.bk left join f on f.ak = s.ak and f.bk = s.bk),
y as (
  select x.*, a.mg is not null as vm, a.fg is not null as vf, b.mg2 is not null as has_m, b.fg2 is not null as has_f, {_PACKED('a.d', 'b.d2')} as y, b.age2, a.mage as a_mage, b.mage2 as b_mage
  from x join a on a.k = ak join b on b.k = bk),
z as (
  select *, 'mother' as kind from y where any_m and in_m and not (vf and has_f)
  union all select *, 'father' from y where any_f and in_f and (not any_m or in_m) and not (vm and has_m)
  union all select *, 'both' from y where any_m and any_f and in_m and in_f)
select 'b' || ak as a_event, {{prefix}} || bk as b_event, '{line}' as family_line, kind, cast(y as integer) as year_diff from z where y between {low} and {high} {age_ok} {mother_ok}
"""


def _shown_within(df: DataFrame) -> DataFrame:
    return df.select("a_event", "b_event", "family_line", "kind", "year_diff")


@_query(_within_sql("'f', 'x'", "sex in ('f', 'x') and", "21", "1840-01-01", 0, 110, True).replace("{prefix}", "'d'"))
def within_deaths_female(spark, sf_dir):
    return _shown_within(within.within(folk_births(spark, sf_dir), folk_deaths(spark, sf_dir), "within_b_d", "FEMALE"))


@_query(_within_sql("'m', 'x'", "sex in ('m', 'x') and", "22", "1840-01-01", 0, 110, True).replace("{prefix}", "'d'"))
def within_deaths_male(spark, sf_dir):
    return _shown_within(within.within(folk_births(spark, sf_dir), folk_deaths(spark, sf_dir), "within_b_d", "MALE"))


@_query(_within_sql("'m', 'x'", "", "22", "1860-01-01", 14, 80, False).replace("{prefix}", "'w'"))
def within_marriages_male(spark, sf_dir):
    return _shown_within(within.within(folk_births(spark, sf_dir), folk_weddings(spark, sf_dir), "within_b_m", "MALE"))


@_query(
    f"with p as ({_FOLK_SQL}), a as (select *, DATE '1840-01-01' + days as d from p where sex in ('f', 'x')), b as (select *, DATE '1840-01-01' + (days + 366 * gap) as d2 from p where sex in ('f', 'x')), s as ({_pairs_sql('s')}), "
    f"y as (select ak, bk, {_PACKED('a.d', 'b.d2')} as y, b.age2 from s join a on a.k = ak join b on b.k = bk) select 'b' || ak as a_event, 'd' || bk as b_event, '21' as family_line, 'subject' as kind, cast(y as integer) as year_diff from y where y between 0 and 110 and (age2 is null or age2 < 0 or abs(y - age2) <= 2)"
)
def within_single(spark, sf_dir):
    return _shown_within(within.within(folk_births(spark, sf_dir), folk_deaths(spark, sf_dir), "within_b_d", "FEMALE", relatives=False))


@_query(
    f"with p as ({_FOLK_SQL}), a as (select * from p where sex in ('f', 'x')), b as (select * from p where sex in ('f', 'x')) select 'b' || a.k as a_event, 'd' || b.k as b_event, '21' as family_line, 'subject' as kind, cast(0 as integer) as year_diff "
    "from a join b on levenshtein(a.sl, b.sl2) <= 1 and levenshtein(a.sg, b.sg2) <= 1 where b.age2 is null or b.age2 <= 2"
)
def within_options(spark, sf_dir):
    """One edit whatever the length, any first letter, no dates: ages are held against a gap of 0."""
    return _shown_within(within.within(folk_births(spark, sf_dir), folk_deaths(spark, sf_dir), "within_b_d", "FEMALE", most=1, fixed=True, block=False, ignore_date=True, relatives=False))


def folk_couples(spark: SparkSession, sf_dir: str, days: str, prefix: str, start: str = "1840-01-01") -> DataFrame:
    """Certificates of the children's parents as couples; the mother is the subject in even rows."""
    p = _folk(spark, sf_dir)
    wife, husband = _who(prefix + "m", "wg", "wl", "'f'"), _who(prefix + "f", "hg", _CUT.format("hl"), "'m'")
    even = F.expr("k % 2 = 0")
    none = F.lit(None).cast(certificates.PERSON)
    relatives = [none.alias(r) for r in ("subject_father", "subject_mother", "partner_father", "partner_mother")]
    return p.select(F.expr(f"'{prefix}' || k").alias("event"), _day(days, start), F.when(even, wife).otherwise(husband).alias("subject"), F.when(even, husband).otherwise(wife).alias("partner"), *relatives)


def _between_sql(a_days: str, a_start: str, b_days: str, mother: str, father: str, a_prefix: str, b_prefix: str, backwards: bool, low: int, high: int, line: str = "cast(null as varchar)", given: str = "") -> str:
    mg, ml, fg, fl = (x.format(mother, father) for x in ("{0}g" + given, "{0}l" + given, "{1}g" + given, "{1}l" + given))
    y = _PACKED("b.d", "a.d") if backwards else _PACKED("a.d", "b.d")
    return f"""
select '{a_prefix}' || a.k as a_event, '{b_prefix}' || b.k as b_event, {line} as family_line, cast(levenshtein(a.fl, b.hl2) + levenshtein(a.fg, b.hg) as integer) as male_lev_total, cast(levenshtein(a.fg, b.hg) as integer) as male_lev_max, cast({y} as integer) as year_diff
from (select k, {mg} as mg, {ml} as ml, {fg} as fg, {fl} as fl, DATE '{a_start}' + cast({a_days} as integer) as d from p where {mg} is not null and {fg} is not null) as a
join (select k, wg, wl, hg, {_CUT.format('hl')} as hl2, DATE '1840-01-01' + cast({b_days} as integer) as d from p) as b on left(a.fl, 1) = left(b.hl2, 1) and left(a.ml, 1) = left(b.wl, 1)
where {_NEAR('a.fl', 'b.hl2')} and {_NEAR('a.fg', 'b.hg')} and {_NEAR('a.ml', 'b.wl')} and {_NEAR('a.mg', 'b.wg')} and {y} between {low} and {high}
"""


def _shown_between(df: DataFrame) -> DataFrame:
    return df.select("a_event", "b_event", "family_line", "male_lev_total", "male_lev_max", "year_diff")


_LATER, _EARLIER = "days + 366 * (gap * 2 - 5)", "days - 366 * (gap - 10)"


@_query(f"with p as ({_FOLK_SQL}) " + _between_sql("days", "1840-01-01", _LATER, "m", "f", "b", "e", False, -1, 96))
def between_deaths(spark, sf_dir):
    return _shown_between(between.between(folk_births(spark, sf_dir), folk_couples(spark, sf_dir, _LATER, "e"), "between_b_d"))


@_query(f"with p as ({_FOLK_SQL}) " + _between_sql("days + 366 * gap", "1840-01-01", _EARLIER, "m", "f", "d", "e", True, -5, 146, given="2"))
def between_deaths_marriages(spark, sf_dir):
    return _shown_between(between.between(folk_deaths(spark, sf_dir), folk_couples(spark, sf_dir, _EARLIER, "e"), "between_d_m"))


@_query(f"with p as ({_FOLK_SQL}) " + _between_sql("days + 366 * gap", "1860-01-01", _EARLIER, "m", "f", "w", "e", True, 14, 100, "'22'", "2"))
def between_marriages(spark, sf_dir):
    """Grooms' parents (line 22); the brides' aren't named."""
    return _shown_between(between.between(folk_weddings(spark, sf_dir), folk_couples(spark, sf_dir, _EARLIER, "e"), "between_m_m"))


_WITHIN_DEATHS = ORACLES["within_deaths_female"]


@_query(
    f"with l as ({_WITHIN_DEATHS}), e as (select substr(a_event, 2) as i, substr(b_event, 2) as j, a_event, b_event, family_line, kind, year_diff, 1 + cast(kind <> 'mother' as integer) + cast(kind <> 'father' as integer) as n_matched from l), "
    "x as (select 'bs' || i as id1, 'ds' || j as id2, * from e union all select 'bf' || i, 'df' || j, * from e where kind <> 'mother' union all select 'bm' || i, 'dm' || j, * from e where kind <> 'father') "
    "select id1, id2, 'W_B-D' as process, family_line, cast(n_matched as integer) as n_matched, a_event, b_event, year_diff from x"
)
def within_person_links(spark, sf_dir):
    a, b = folk_births(spark, sf_dir), folk_deaths(spark, sf_dir)
    links = within.within(a, b, "within_b_d", "FEMALE")
    return closure.within_person_links(links, a, b, "W_B-D").select("id1", "id2", "process", "family_line", "n_matched", "a_event", "b_event", "year_diff")


@_query(
    f"with l as ({ORACLES['between_marriages']}), e as (select substr(a_event, 2) as i, substr(b_event, 2) as j, * from l) "
    "select 'em' || j as id1, 'wm' || i as id2, 'B_M-M' as process, family_line, a_event, b_event from e union all select 'ef' || j, 'wf' || i, 'B_M-M', family_line, a_event, b_event from e"
)
def between_marriages_person_links(spark, sf_dir):
    a, b = folk_weddings(spark, sf_dir), folk_couples(spark, sf_dir, _EARLIER, "e")
    return closure.between_person_links(between.between(a, b, "between_m_m"), a, b, "B_M-M").select("id1", "id2", "process", "family_line", "a_event", "b_event")


@_query(
    f"with l as ({ORACLES['between_deaths']}), e as (select substr(a_event, 2) as i, substr(b_event, 2) as j, * from l) "
    "select 'bm' || i as id1, 'em' || j as id2, 'B_B-D' as process, a_event, b_event from e union all select 'bf' || i, 'ef' || j, 'B_B-D', a_event, b_event from e"
)
def between_deaths_person_links(spark, sf_dir):
    """The deceased are women in even rows and men in odd ones."""
    a, b = folk_births(spark, sf_dir), folk_couples(spark, sf_dir, _LATER, "e")
    return closure.between_person_links(between.between(a, b, "between_b_d"), a, b, "B_B-D").select("id1", "id2", "process", "a_event", "b_event")


def brides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marriages with unnamed grooms in the earlier one, so that brides are found again."""
    w = weddings(spark, sf_dir)
    early = F.col("event").startswith("c")
    none = F.lit(None).cast(w.schema["partner"].dataType)
    return w.withColumns({"partner": F.when(~early, F.col("partner")).otherwise(none), "partner_father": F.when(~early, F.col("partner_father")).otherwise(none)})


@_query(
    f"with w as (select *, DATE '1840-01-01' + cast(days as integer) as d from ({_WEDDINGS.replace('as string', 'as varchar')}) as weddings where bg is not null and mg is not null), "
    "a as (select * from w where event like 'c%') "
    f"select a.event as a_event, b.event as b_event, 'remarriage_bride' as link, '21' as family_line, 'mother' as kind, cast({_PACKED('a.d', 'b.d')} as integer) as year_diff from a join w as b on left(a.bl, 1) = left(b.bl, 1) and left(a.ml, 1) = left(b.ml, 1) "
    f"where a.event <> b.event and {_NEAR('a.bl', 'b.bl')} and {_NEAR('a.bg', 'b.bg')} and {_NEAR('a.ml', 'b.ml')} and {_NEAR('a.mg', 'b.mg')} and b.d >= a.d"
)
def bride_remarriages(spark, sf_dir):
    w = brides(spark, sf_dir)
    return couples.couples(w.filter(F.col("event").startswith("c")), w, in_order=True).select("a_event", "b_event", "link", "family_line", "kind", "year_diff")


@_query(f"with c as ({_COUPLES_SQL}) select link, case when kind = 'both' then 'strong' else 'weak' end as strength, count(*) as n_links from c group by all")
def match_strength(spark, sf_dir):
    w = weddings(spark, sf_dir)
    return summaries.match_strength(couples.couples(w, w, in_order=True))


_UNDATED = ORACLES["within_deaths_female"].replace("where y between 0 and 110 and (age2 is null or age2 < 0 or abs((y - age2)) <= 2) and (kind = 'father' or (case when b_mage >= a_mage then b_mage - a_mage else -1 end) < 0 or abs(y - (case when b_mage >= a_mage then b_mage - a_mage else -1 end)) <= 2)", "where (age2 is null or age2 <= 2) and (kind = 'father' or b_mage < a_mage or b_mage - a_mage <= 2)")


@_query(
    f"with d as ({_UNDATED}), q as ({_WITHIN_DEATHS}), u as (select a_event, b_event, kind, 1 as x, 0 as y from d union all select a_event, b_event, kind, 0, 1 from q), g as (select sum(x) as x, sum(y) as y from u group by a_event, b_event, kind) "
    "select count(*) filter (where x > 0) as discovered, count(*) filter (where y > 0) as passed, count(*) filter (where x > 0 and y = 0) as failed, cast(0 as hugeint)::bigint as duplicates from g"
)
def candidate_counts(spark, sf_dir):
    a, b = folk_births(spark, sf_dir), folk_deaths(spark, sf_dir)
    found, passed = (within.within(a, b, "within_b_d", "FEMALE", ignore_date=x) for x in (True, False))
    return summaries.candidate_summary(found, passed)


@_query(f"with p as ({_PEOPLE_SQL}) select count(*) as total, count(*) as indexed from p")
def index_counts_single(spark, sf_dir):
    return summaries.index_summary_single(births(spark, sf_dir))


@_query(f"with p as ({_FOLK_SQL}) select count(*) as total, count(*) filter (where sex = 'f') as indexed from p")
def index_counts_couples(spark, sf_dir):
    p = _folk(spark, sf_dir).select(F.expr("'c' || k").alias("event"), _who("s", "sg", "sl", "sex").alias("subject"), _who("f", "hg", "hl", "'m'").alias("partner"))
    return summaries.index_summary_couples(p)


@_query(
    f"with p as ({_FOLK_SQL}) select count(*) as total, count(*) filter (where mg is not null or fg is not null) as indexed, count(*) filter (where mg is not null and fg is null) as mother_only, count(*) filter (where mg is null and fg is not null) as father_only, "
    "count(*) filter (where mg is not null and fg is not null) as both_parents, count(*) filter (where fg2 is not null and (mg is not null or fg is not null)) as partner, cast(0 as bigint) as partner_mother_only, "
    "count(*) filter (where fg2 is not null and mg2 is null and (mg is not null or fg is not null)) as partner_father_only, count(*) filter (where fg2 is not null and mg2 is not null and (mg is not null or fg is not null)) as partner_both_parents from p where fg2 is not null or k % 11 = 4"
)
def index_counts_marriages(spark, sf_dir):
    p = _folk(spark, sf_dir)
    m = p.select(F.expr("'c' || k").alias("event"), _who("s", "sg", "sl", "'f'").alias("subject"), _who("p", "fg2", "fl2", "'m'").alias("partner"), _who("a", "mg", "ml", "'f'").alias("subject_mother"), _who("b", "fg", "fl", "'m'").alias("subject_father"), _who("c", "mg2", "ml2", "'f'").alias("partner_mother"), _who("d", "fg2", "fl2", "'m'").alias("partner_father"))
    return summaries.index_summary_marriages(m)


@_query("with c as (select count(*) * 1000 as total, count(*) as indexed from lineitem) select 'total' as name, format('{:,}', total) as value from c union all select 'indexed', format('{:,}', indexed) from c")
def shown_counts(spark, sf_dir):
    n = F.count("*")
    return summaries.shown(_table(spark, sf_dir, "lineitem").agg((n * 1000).alias("total"), n.alias("indexed")))


_MOST = {m: f"case when n = 0 then 0 when n = 1 then {a[0]} when n < 6 then {a[1]} when n < 9 then {a[2]} when n < 12 then {a[3]} else {a[4]} end" for m, a in names.ALLOWED.items()}


@_query("with l as (select o_orderkey, cast(o_orderkey % 16 as integer) as n from orders) select o_orderkey, " + ", ".join(f"cast({x} as integer) as most_{m}" for m, x in _MOST.items()) + ", cast(case when n = 0 then 0 else 3 end as integer) as fixed from l")
def lev_thresholds(spark, sf_dir):
    n = (F.col("o_orderkey") % 16).cast("int")
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(names.allowed(n, m).alias(f"most_{m}") for m in names.ALLOWED), names.allowed(n, 3, True).alias("fixed"))


@_query(f"with p as ({_FOLK_SQL}), a as (select distinct sl as w, length(sl) as n from p), b as (select distinct sl2 as w from p) select a.w as a, b.w as b, cast(levenshtein(a.w, b.w) as integer) as distance from a, b where levenshtein(a.w, b.w) <= {_MOST[2]}")
def fuzzy_two_edits(spark, sf_dir):
    p = _folk(spark, sf_dir)
    return fuzzy.pairs_unblocked(p.select(F.col("sl").alias("a")), p.select(F.col("sl2").alias("b")), 2)


@_query(f"with p as ({_FOLK_SQL}), a as (select distinct sl as w from p), b as (select distinct sl2 as w from p) select a.w as a, b.w as b, cast(levenshtein(a.w, b.w) as integer) as distance from a join b on left(a.w, 1) = left(b.w, 1) where levenshtein(a.w, b.w) <= 3")
def fuzzy_fixed(spark, sf_dir):
    p = _folk(spark, sf_dir)
    return fuzzy.pairs_blocked(p.select(F.col("sl").alias("a")), p.select(F.col("sl2").alias("b")), 3, True)


#: Two first names on either side, alike enough to compete.
_NAMES = "select cast(c_custkey as int) as k, 'ab' || chr(cast(97 + c_custkey % 3 as integer)) || 'de' as s1, 'ab' || chr(cast(97 + c_custkey % 4 as integer)) || 'df' as s2, 'ab' || chr(cast(97 + c_custkey % 5 as integer)) || 'de' as t1, 'abcd' || chr(cast(101 + c_custkey % 2 as integer)) as t2 from customer"


@_query(
    f"""with n as ({_NAMES}), v as (select * from n where s1 <> s2 and t1 <> t2),
h as (select k, s, t, levenshtein(s, t) as d from (select k, unnest([s1, s2]) as s, t1, t2 from v), lateral (select unnest([t1, t2]) as t) where levenshtein(s, t) <= 1),
o as (select k, s, count(*) as n, row_number() over (partition by k order by count(*), s) as r from h group by k, s),
f as (select h.k, h.t, h.d from h join o on o.k = h.k and o.s = h.s where o.r = 1 qualify row_number() over (partition by h.k order by h.d, h.t) = 1),
g as (select h.k, h.d from h join o on o.k = h.k and o.s = h.s join f on f.k = h.k where o.r = 2 and h.t <> f.t qualify row_number() over (partition by h.k order by h.d, h.t) = 1)
select f.k, cast(1 + cast(g.k is not null as integer) as integer) as matched, cast(f.d + coalesce(g.d, 0) as integer) as lev_total, cast(greatest(f.d, coalesce(g.d, 0)) as integer) as lev_max from f left join g on g.k = f.k"""
)
def name_assignment(spark, sf_dir):
    """Two first names that compete for the same names of the other side."""
    n = _made(spark, sf_dir, _NAMES.replace("as integer", "as int")).filter("s1 <> s2 and t1 <> t2")
    side = lambda x, y: n.select(F.col("k").cast("string").alias("event"), F.concat_ws(" ", x, y).alias("given"), F.concat(F.lit("q"), F.md5(F.col("k").cast("string"))).alias("family"), F.col("k").alias("pair"))
    hits = fuzzy.Search(side("s1", "s2"), side("t1", "t2"), same=("pair",)).hits()
    return fuzzy.assigned(hits, []).select(F.col("a_event").cast("int").alias("k"), "matched", "lev_total", "lev_max")


@_query(
    f"with p as ({_FOLK_SQL}), x as (select 'b' || k as event, unnest(string_split(sg || '-' || mg, '-')) as fn, sl as last from p where mg is not null) select event, fn, last, cast(2 as integer) as n_b from x"
)
def name_postings(spark, sf_dir):
    p = _folk(spark, sf_dir).filter("mg is not null")
    return fuzzy.name_index(p.select(F.expr("'b' || k").alias("event"), F.concat_ws("-", "sg", "mg").alias("given"), F.col("sl").alias("family"))).select("event", "fn", "last", "n_b")


@_query(f"with p as ({_FOLK_SQL}) select distinct sg as name from p")
def name_dictionary(spark, sf_dir):
    p = _folk(spark, sf_dir)
    return fuzzy.name_index(p.select(F.expr("'b' || k").alias("event"), F.col("sg").alias("given"), F.col("sl").alias("family"))).select(F.col("fn").alias("name")).distinct()


@_query(
    "with p as (select p_partkey, string_split(p_name, ' ') as w from part) select distinct p_partkey, w[i] || case when j = 1 then '' else '_' || w[3 - i] end || ' x' as name, cast(j as integer) as used, cast(2 as integer) as of from p, (values (1), (2)) a(i), (values (1), (2)) b(j) where len(w) = 2 and w[1] <> w[2]"
)
def full_name_combinations(spark, sf_dir):
    w = F.split("p_name", " ")
    p = _table(spark, sf_dir, "part").filter((F.size(w) == 2) & (w[0] != w[1]))
    return p.select("p_partkey", F.explode(names.combinations(F.col("p_name"), F.lit("x"))).alias("c")).select("p_partkey", "c.*")


@_query("select o_orderkey, lpad(cast(o_orderkey // 3600 as varchar), cast(greatest(2, length(cast(o_orderkey // 3600 as varchar))) as integer), '0') || ':' || lpad(cast(o_orderkey // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') as shown from orders")
def durations(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", names.duration(F.col("o_orderkey")).alias("shown"))


_VALUES = "case o_orderkey % 6 when 0 then cast(cast(o_orderdate as date) as {0}) when 1 then substr(cast(o_orderdate as {0}), 1, 4) when 2 then '1850-02-30' when 3 then ' ' || cast(o_orderkey as {0}) || ' ' when 4 then 'n/a' end"


@_query(f"with v as (select o_orderkey, {_VALUES.format('varchar')} as v from orders) select o_orderkey, case when regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(v as date) end as day, coalesce(case when regexp_full_match(trim(v), '-?\\d+') then try_cast(trim(v) as integer) end, -1) as number from v")
def value_parsing(spark, sf_dir):
    v = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_VALUES.format("string")).alias("v"))
    return v.select("o_orderkey", names.iso_date(F.col("v")).alias("day"), names.whole_number(F.col("v")).alias("number"))


@_query("with x as (select c_custkey as a, c_nationkey as n from customer) select 'a' || a as a_event, 'n' || n as b_event, cast(a % 3 as varchar) || '-' || cast(a % 2 as varchar) as distances, cast(a % 4 as varchar) || '-1' as n_names from x where a % 2 = 0")
def common_events(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.expr("'a' || c_custkey").alias("a_event"), F.expr("'n' || c_nationkey").alias("b_event"), F.col("c_custkey").alias("k"))
    one = c.select("a_event", "b_event", (F.col("k") % 3).alias("distance"), (F.col("k") % 4).alias("n"))
    other = c.filter("k % 2 = 0").select("a_event", "b_event", (F.col("k") % 2).alias("distance"), F.lit(1).alias("n"))
    return fuzzy.common_events(one, other)


@_query(
    f"with l as ({_BETWEEN_SQL}) select a_event as \"certificate_A\", b_event as \"certificate_B\", 'N.A.' as family_line, 'N.A.' as \"levenshtein_total_AB\", cast(female_lev_total as varchar) as \"levenshtein_total_AB_female_relative\", "
    "cast(male_lev_total as varchar) as \"levenshtein_total_AB_male_relative\", '1' as \"number_names_subject_A_male_relative\", cast(year_diff as varchar) as year_diff from l"
)
def link_file(spark, sf_dir):
    return link_files.as_certificate_file(_links(spark, sf_dir)).select("certificate_A", "certificate_B", "family_line", "levenshtein_total_AB", "levenshtein_total_AB_female_relative", "levenshtein_total_AB_male_relative", "number_names_subject_A_male_relative", "year_diff")


_LINKS_NS = "https://www.example.org/links/"


@_query(f"with l as ({_BETWEEN_SQL}) select '<{_LINKS_NS}certificate_A> <' || a_event || '>' as said from l union all select '<{_LINKS_NS}year_diff> \"' || year_diff || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' from l")
def links_as_triples(spark, sf_dir):
    lines = link_files.as_triples(link_files.as_certificate_file(_links(spark, sf_dir)))
    return lines.filter(F.col("value").contains("certificate_A>") | F.col("value").contains("year_diff>")).select(F.regexp_extract("value", r"^\S+ (.*) \.$", 1).alias("said"))


@_query(f"{_CLASSES_SQL} select person, '_:' || {_UUID_SQL} as reconstruction from c")
def class_names(spark, sf_dir):
    return closure.class_names(_classes(spark, sf_dir), "_:")


@_query(f"{_CLASSES_SQL} select distinct '<https://www.example.org/' || {_UUID_SQL} || '> <http://www.w3.org/ns/prov#wasGeneratedBy> <urn:run> .' as value from c")
def reconstruction_activity(spark, sf_dir):
    return closure.reconstruction(_classes(spark, sf_dir), activity="<urn:run>").filter(F.col("value").contains("wasGeneratedBy"))


# sources


@_query("select 'urn:' || n_nationkey as s, n_name || 'é' || chr(128512) || chr(92) || 'u00e9' || chr(9) || '\"' as o from nation")
def triple_escapes(spark, sf_dir):
    lines = _table(spark, sf_dir, "nation").select(F.concat(F.lit("<urn:"), "n_nationkey", F.lit('> <urn:p> "'), "n_name", F.lit('\\u00E9\\U0001F600\\\\u00e9\\t\\"" .')).alias("value"))
    return triples.parse(lines).select("s", "o")


@_query("select 4 * count(*) - count(*) filter (where n_nationkey % 3 <> 0) as n from nation")
def statement_count(spark, sf_dir):
    return triples.statement_count(_graph(spark, sf_dir))


_ROWS_SQL = f"""
with p as ({_FOLK_SQL}),
r as (
  select k, 'newborn' as role, sg as given, cast(null as varchar) as prefix, sl as family, sex from p union all select k, 'mother', mg, 'de', ml, 'f' from p where mg is not null union all select k, 'father', fg, null, fl, 'm' from p where fg is not null),
n as (select *, coalesce(prefix || ' ', '') || family as full_family, 'http://example.org/person/p-' || role || k as person, 'http://example.org/event/e-' || k as event from r)
"""
_SOURCE = {"subjectID": "id", "eventID": "event", "subjectFirstName": "given", "subjectFamilyNamePrefix": "prefix", "subjectFamilyName": "family", "subjectGender": "sex", "subjectRole": "code"}


def person_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The births as rows of a CSV of people, read by a column map."""
    p = _folk(spark, sf_dir)
    one = lambda code, role, g, prefix, last, sex: F.when(F.expr(f"{g} is not null"), F.struct(F.lit(code).alias("code"), F.lit(role).alias("role"), F.expr(g).alias("given"), F.lit(prefix).cast("string").alias("prefix"), F.expr(last).alias("family"), F.expr(sex).alias("sex")))
    rows = p.withColumn("x", F.explode(F.array_compact(F.array(one("1", "newborn", "sg", None, "sl", "sex"), one("2", "mother", "mg", "de", "ml", "'f'"), one("3", "father", "fg", None, "fl", "'m'")))))
    day = F.when(F.col("x.role") == "newborn", F.expr("date_add(date '1840-01-01', days)"))
    table = rows.select(F.concat("x.role", "k").alias("id"), F.col("k").alias("event"), "x.*", F.year(day).alias("birth_year"), F.month(day).alias("birth_month"), F.dayofmonth(day).alias("birth_day"))
    columns = person_csv.standard_map()
    for name, title in _SOURCE.items():
        columns[name]["titles"] = title
    return csvw.values(table, columns, person_csv.NAMES)


@_query(f"{_ROWS_SQL} select cast(k as varchar) as event, role || k as person, role, prefix, case sex when 'f' then 'female' when 'm' then 'male' else 'x' end as gender, case when role = 'newborn' then cast(DATE '1840-01-01' + cast(k % 9000 as integer) as varchar) end as date from n")
def column_map(spark, sf_dir):
    return person_rows(spark, sf_dir).select("event", "person", "role", "prefix", "gender", "date")


_SDO, _TYPE = "https://schema.org/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@_query(
    f"{_ROWS_SQL} select person as s, '{_SDO}givenName' as p, given as o from n union all select person, '{_SDO}familyName', full_family from n union all select person, '{_SDO}name', given || ' ' || full_family from n union all select person, '{certificates.CIV}prefixFamilyName', prefix from n where prefix is not null "
    f"union all select person, '{_TYPE}', '{_SDO}Person' from n union all select person, '{_SDO}gender', '{_SDO}' || case sex when 'f' then 'Female' else 'Male' end from n where sex <> 'x' union all select event, '{certificates.CIV}' || role, person from n "
    f"union all select event, '{_TYPE}', '{certificates.CIV}Birth' from n where role = 'newborn' union all select event, '{certificates.CIV}eventDate', cast(DATE '1840-01-01' + cast(k % 9000 as integer) as varchar) from n where role = 'newborn'"
)
def civ_triples(spark, sf_dir):
    return person_csv.triples(person_rows(spark, sf_dir)).select("s", "p", "o")


@_query(
    f"{_ROWS_SQL}, m as (select * from n where role = 'mother'), f as (select * from n where role = 'father'), c as (select * from n where role = 'newborn'), q as (select * from m union all select * from f) "
    f"select c.person as s, '{_SDO}parent' as p, q.person as o from c join q on q.k = c.k union all select q.person, '{_SDO}children', c.person from c join q on q.k = c.k union all select m.person, '{_SDO}spouse', f.person from m join f on f.k = m.k union all select f.person, '{_SDO}spouse', m.person from m join f on f.k = m.k "
    f"union all select person, '{certificates.PROV}hadPrimarySource', event from n union all select person, '{certificates.PICOM}hasRole', '{certificates.PICOT}roles/575' from c union all select event, '{_SDO}additionalType', '{certificates.PICOT}sourcetypes/551' from c"
)
def pico_relations(spark, sf_dir):
    wanted = [f"{_SDO}{x}" for x in ("parent", "children", "spouse", "additionalType")] + [f"{certificates.PROV}hadPrimarySource", f"{certificates.PICOM}hasRole"]
    return person_csv.pico_triples(person_rows(spark, sf_dir)).filter(F.col("p").isin(wanted)).select("s", "p", "o")


_BIRTHS_SQL = f"{_ROWS_SQL} select c.event, DATE '1840-01-01' + cast(c.k % 9000 as integer) as event_date, c.given, {{0}} as mother_family, f.given as father_given from n c left join n m on m.k = c.k and m.role = 'mother' left join n f on f.k = c.k and f.role = 'father' where c.role = 'newborn'"
_seen = lambda c: c.select("event", "event_date", F.col("subject.given").alias("given"), F.col("subject_mother.family").alias("mother_family"), F.col("subject_father.given").alias("father_given"))


@_query(_BIRTHS_SQL.format("m.full_family"))
def civ_certificates(spark, sf_dir):
    return _seen(certificates.certificates(person_csv.triples(person_rows(spark, sf_dir)), "births"))


@_query(_BIRTHS_SQL.format("m.full_family"))
def pico_certificates(spark, sf_dir):
    return _seen(certificates.certificates(person_csv.pico_triples(person_rows(spark, sf_dir)), "births", certificates.MODELS["PiCo-SDO"]))


@_query(_BIRTHS_SQL.format("m.family"))
def pnv_certificates(spark, sf_dir):
    return _seen(certificates.certificates(person_csv.pico_triples(person_rows(spark, sf_dir)), "births", certificates.MODELS["PiCo-PNV"]))


# the SELECT language


def _select(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.query(_graph(spark, sf_dir), "PREFIX u: <urn:> " + text)

    QUERIES[name], ORACLES[name] = run, sql


_select("select_order_limit", "SELECT ?n WHERE { ?x u:name ?n ; u:in u:r1 } ORDER BY DESC(?n) LIMIT 3 OFFSET 1", "select n_name as n from nation where n_regionkey = 1 order by n_name desc limit 3 offset 1")
_select("select_union", "SELECT DISTINCT ?v WHERE { { ?x u:name ?v ; u:in u:r0 } UNION { ?x u:in ?v FILTER(?v != u:r3) } }", "select n_name as v from nation where n_regionkey = 0 union select 'urn:r' || n_regionkey from nation where n_regionkey <> 3")
_select("select_minus", "SELECT ?n WHERE { ?x u:name ?n MINUS { ?x u:third ?t } MINUS { ?x u:in u:r2 } }", "select n_name as n from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2")
_select("select_exists", "SELECT ?n WHERE { ?x u:name ?n FILTER EXISTS { ?x u:third ?t } FILTER NOT EXISTS { ?x u:in u:r2 } }", "select n_name as n from nation where n_nationkey % 3 = 0 and n_regionkey <> 2")
_select("select_bind", 'SELECT ?k ?len WHERE { ?x u:name ?n ; u:in ?r BIND(CONCAT(LCASE(?n), "/", SUBSTR(STR(?r), 5)) AS ?k) BIND(STRLEN(?k) AS ?len) }', "select lower(n_name) || '/r' || n_regionkey as k, cast(length(n_name) + 3 as varchar) as len from nation")
_select("select_values", 'SELECT ?x ?r WHERE { VALUES (?r ?m) { (u:r1 "a") (u:r4 UNDEF) } ?x u:in ?r }', "select 'urn:n' || n_nationkey as x, 'urn:r' || n_regionkey as r from nation where n_regionkey in (1, 4)")
_select("select_functions", 'SELECT ?n WHERE { ?x u:name ?n FILTER(REGEX(?n, "^n.*[135]$", "i") || (CONTAINS(?n, "2") && !STRSTARTS(?n, "X")) || ?n IN ("N", "M")) }', "select n_name as n from nation where regexp_matches(n_name, '^n.*[135]$', 'i') or (contains(n_name, '2') and not starts_with(n_name, 'X')) or n_name in ('N', 'M')")
_select("select_terms", "SELECT ?x ?d WHERE { ?x ?p ?v FILTER(isLiteral(?v) && LANG(?v) = \"\") BIND(DATATYPE(?v) AS ?d) }", "select 'urn:n' || n_nationkey as x, 'http://www.w3.org/2001/XMLSchema#string' as d from nation union all select 'urn:n' || n_nationkey, 'urn:int' from nation where n_nationkey % 3 = 0")
_select("select_having", "SELECT ?r (COUNT(?x) AS ?c) (MAX(?n) AS ?last) (SUM(?t) AS ?s) WHERE { ?x u:in ?r ; u:name ?n OPTIONAL { ?x u:third ?t } } GROUP BY ?r HAVING (COUNT(?x) > 4)", "select 'urn:r' || n_regionkey as r, count(*) as c, max(n_name) as last, cast(sum(case when n_nationkey % 3 = 0 then 1 end) as double) as s from nation group by n_regionkey having count(*) > 4")
_select("select_subselect", "SELECT ?n ?c WHERE { { SELECT ?r (COUNT(?y) AS ?c) WHERE { ?y u:in ?r } GROUP BY ?r } ?x u:in ?r ; u:name ?n }", "select n_name as n, c from nation join (select n_regionkey, count(*) as c from nation group by all) using (n_regionkey)")
_select("select_paths", "SELECT ?n WHERE { u:n1 u:in/^u:in/u:name ?n }", "select b.n_name as n from nation a join nation b on b.n_regionkey = a.n_regionkey where a.n_nationkey = 1")


@_query("with recursive e as (select c_custkey as x, c_custkey // 2 as y from customer where c_custkey < 200 and c_custkey > 1), r as (select x, y from e union select r.x, e.y from r join e on e.x = r.y) select 'urn:' || x as a, 'urn:' || y as b from r")
def select_closure(spark, sf_dir):
    """A path of any length: each customer below 200 and all that halving leads to."""
    c = _table(spark, sf_dir, "customer").filter("c_custkey between 2 and 199")
    graph = triples.parse(c.select(F.expr("'<urn:' || c_custkey || '> <urn:half> <urn:' || cast(floor(c_custkey / 2) as bigint) || '> .'").alias("value")))
    return sparql.query(graph, "SELECT ?a ?b WHERE { ?a <urn:half>+ ?b }")
