"""Queries on the driver's tables and the SQL that gives the same rows.

The tables hold no registry, so certificates are made from customers: names from MD5
digits, and the couples' names with an edit in every third row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import names, rules
from kinweave.operators import between, closure, couples, fuzzy, summaries, within
from kinweave.shared import kept, partitions
from kinweave.sources import sparql, triples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "between_links"


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(salt: str, size: int, key: str = "k") -> str:
    return f"translate(substr(md5('{salt}' || cast({key} as string)), 1, {size}), '0123456789', 'ghijklmnop')"


_PEOPLE = f"""
select cast(c_custkey as int) as k, {_name('g', 6, 'c_custkey % 97')} || case when c_custkey % 4 = 0 then ' ' || {_name('h', 6, 'c_custkey % 89')} else '' end as child,
  {_name('f', 6, 'c_custkey % 83')} as father, {_name('m', 6, 'c_custkey % 79')} as mother, {_name('x', 9, 'c_custkey')} as last, {_name('y', 8, 'c_custkey')} as maiden,
  case when c_custkey % 2 = 0 then 'f' else 'm' end as sex, cast(c_custkey % 5 as int) as gap
from customer
"""
_EDIT = "case when k % 3 = 0 then substr({0}, 1, 3) || 'z' || substr({0}, 5, 20) when k % 7 = 0 then substr({0}, 1, 5) else {0} end"
_PEOPLE_SQL = _PEOPLE.replace("as string", "as varchar")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt evenly, as what is made of them is work, not bytes: a file may be read by one task."""
    return _table(spark, sf_dir, "customer").repartition(partitions(spark), "c_custkey")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """What sql makes of customers, made once: the names are long expressions, which each filter and scan would work out again."""
    return kept(spark.sql(sql.replace("from customer", "from {customer}"), customer=_customers(spark, sf_dir)), "people")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _PEOPLE)


def _person(iri: str, given: str, family: str, gender: str):
    return F.struct(F.expr(iri).alias("iri"), F.expr(given).alias("given"), F.expr(family).alias("family"), F.expr(gender).alias("gender"), F.lit(None).cast("int").alias("age"))


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _people(spark, sf_dir)
    return p.select(F.expr("'b' || k").alias("event"), F.expr("date_add(date '1840-01-01', k % 9000)").alias("event_date"), _person("'bs' || k", "child", "last", "sex").alias("subject"), _person("'bf' || k", "father", "last", "'m'").alias("subject_father"), _person("'bm' || k", "mother", "maiden", "'f'").alias("subject_mother"))


def marriages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents' marriages, up to 40 years earlier; the bride is the subject."""
    p = _people(spark, sf_dir)
    none = _person("cast(null as string)", "cast(null as string)", "cast(null as string)", "cast(null as string)")
    roles = ("subject_father", "subject_mother", "partner_father", "partner_mother")
    return p.select(F.expr("'m' || k").alias("event"), F.expr("date_add(date '1840-01-01', k % 9000 - 3650 * gap)").alias("event_date"), _person("'ms' || k", _EDIT.format("mother"), "maiden", "'f'").alias("subject"), _person("'mp' || k", "father", _EDIT.format("last"), "'m'").alias("partner"), *(none.alias(r) for r in roles))


def later_marriages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children's own marriages, 20 to 60 years on, with their parents named."""
    p = _people(spark, sf_dir)
    none = _person("cast(null as string)", "cast(null as string)", "cast(null as string)", "cast(null as string)")
    bride, groom = F.expr("sex = 'f'"), F.expr("sex = 'm'")
    child, father, mother = _person("'cs' || k", "child", _EDIT.format("last"), "sex"), _person("'cf' || k", "father", "last", "'m'"), _person("'cm' || k", _EDIT.format("mother"), "maiden", "'f'")
    pick = lambda who, x: F.when(who, x).otherwise(none)
    return p.select(F.expr("'c' || k").alias("event"), F.expr("date_add(date '1860-01-01', k % 9000 + 3650 * gap)").alias("event_date"), pick(bride, child).alias("subject"), pick(groom, child).alias("partner"), pick(bride, father).alias("subject_father"), pick(bride, mother).alias("subject_mother"), pick(groom, father).alias("partner_father"), pick(groom, mother).alias("partner_mother"))


_T = lambda a: f"case when length({a}) = 0 then 0 when length({a}) < 2 then 0 when length({a}) < 6 then 1 when length({a}) < 9 then 2 when length({a}) < 12 then 3 else 4 end"
_NEAR = lambda a, b: f"levenshtein({a}, {b}) <= {_T(a)}"
_PACKED = lambda a, b: f"((year({b}) * 12 + month({b})) * 32 + day({b}) - ((year({a}) * 12 + month({a})) * 32 + day({a}))) // 32 // 12"


@_query("select p_partkey, translate(p_name, ' -', '__') as canonical from part")
def canonical_name(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", names.canonical(F.col("p_name")).alias("canonical"))


@_query("select p_partkey, unnest(string_split(translate(p_name, ' -', '__'), '_')) as fn from part")
def decompose_first_name(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode(names.first_names(F.col("p_name"))).alias("fn"))


@_query("select p_partkey, cast(length(p_name) - length(replace(p_name, ' ', '')) + 1 as integer) as n_a, cast(len(string_split(translate(p_name, ' -', '__'), '_')) as integer) as n_b from part")
def number_of_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", names.probe_count(F.col("p_name")).alias("n_a"), names.index_count(F.col("p_name")).alias("n_b"))


@_query(f"select p_partkey, cast({_T('p_name')} as integer) as allowed from part")
def lev_threshold(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", names.allowed(F.length("p_name"), 4).alias("allowed"))


@_query(f"with p as ({_PEOPLE_SQL}) select k, case when sex in ('m') then 'MALE' when sex = 'f' then 'FEMALE' else 'UNKNOWN' end as gender, sex = 'f' as fits_female, length(child) > 0 and child <> 'n' and length(last) > 0 as valid from p")
def gender_and_validity(spark, sf_dir):
    p = _people(spark, sf_dir)
    return p.select("k", names.gender(F.col("sex")).alias("gender"), names.gender_fits(F.col("sex"), "FEMALE").alias("fits_female"), names.is_valid(F.col("child"), F.col("last"), F.col("k")).alias("valid"))


_TOKENS_SQL = "select distinct translate(p_name, ' -', '__') as w from part"


def _tokens(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(names.canonical(F.col("p_name")).alias("w")).distinct()


@_query(f"with t as ({_TOKENS_SQL}) select x.w as a, y.w as b, cast(levenshtein(x.w, y.w) as integer) as distance from t x, t y where left(x.w, 1) = left(y.w, 1) and {_NEAR('x.w', 'y.w')}")
def fuzzy_lastname_blocked(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return fuzzy.pairs_blocked(t.select(F.col("w").alias("a")), t.select(F.col("w").alias("b")))


_LASTS_SQL = f"with p as ({_PEOPLE_SQL}), l as (select distinct last as w from p), r as (select distinct {_EDIT.format('last')} as w from p)"


@_query(f"{_LASTS_SQL} select l.w as a, r.w as b, cast(levenshtein(l.w, r.w) as integer) as distance from l, r where {_NEAR('l.w', 'r.w')}")
def fuzzy_firstname_unblocked(spark, sf_dir):
    p = _people(spark, sf_dir)
    return fuzzy.pairs_unblocked(p.select(F.col("last").alias("a")), p.select(F.expr(_EDIT.format("last")).alias("b")))


@_query(f"select o_orderkey, cast({_PACKED('o_orderdate', 'l_shipdate')} as integer) as years, {_PACKED('o_orderdate', 'l_shipdate')} between 0 and 110 as time_ok from orders join lineitem on o_orderkey = l_orderkey")
def year_gap(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    years = names.year_gap(F.col("o_orderdate"), F.col("l_shipdate"))
    return rows.select("o_orderkey", years.alias("years"), rules.time_ok("within_b_d", years).alias("time_ok"))


@_query("select c_custkey, cast(case when c_custkey % 50 <= c_custkey % 70 then c_custkey % 70 - c_custkey % 50 else -1 end as integer) as gap, c_custkey % 50 > c_custkey % 70 or abs(5 - (c_custkey % 70 - c_custkey % 50)) <= 2 as age_ok from customer")
def age_consistency(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    gap = names.age_gap((F.col("c_custkey") % 50).cast("int"), (F.col("c_custkey") % 70).cast("int"))
    return c.select("c_custkey", gap.alias("gap"), rules.age_ok("within_b_d", F.lit(5), gap).alias("age_ok"))


_BETWEEN_SQL = f"""
with p as ({_PEOPLE_SQL}), a as (select *, DATE '1840-01-01' + k % 9000 as d from p),
b as (select *, {_EDIT.format('mother')} as bride, {_EDIT.format('last')} as groom_last, DATE '1840-01-01' + (k % 9000 - 3650 * gap) as d from p)
select 'b' || a.k as a_event, 'm' || b.k as b_event, cast(levenshtein(a.last, b.groom_last) + levenshtein(a.father, b.father) as integer) as male_lev_total,
  cast(levenshtein(a.maiden, b.maiden) + levenshtein(a.mother, b.bride) as integer) as female_lev_total, cast({_PACKED('b.d', 'a.d')} as integer) as year_diff
from a join b on left(a.last, 1) = left(b.groom_last, 1) and left(a.maiden, 1) = left(b.maiden, 1)
where {_NEAR('a.last', 'b.groom_last')} and {_NEAR('a.maiden', 'b.maiden')} and {_NEAR('a.father', 'b.father')} and {_NEAR('a.mother', 'b.bride')} and {_PACKED('b.d', 'a.d')} between -5 and 36
"""


def _links(spark, sf_dir):
    return between.between(births(spark, sf_dir), marriages(spark, sf_dir), "between_b_m")


@_query(_BETWEEN_SQL)
def between_links(spark, sf_dir):
    return _links(spark, sf_dir).select("a_event", "b_event", "male_lev_total", "female_lev_total", "year_diff")


_WITHIN_SQL = f"""
with p as ({_PEOPLE_SQL}), a as (select *, DATE '1840-01-01' + k % 9000 as d from p where sex = 'f'),
b as (select *, {_EDIT.format('mother')} as mother2, {_EDIT.format('last')} as last2, DATE '1860-01-01' + (k % 9000 + 3650 * gap) as d from p where sex = 'f'),
x as (
  select a.k as ak, b.k as bk, {_PACKED('a.d', 'b.d')} as y from a join b on left(a.last, 1) = left(b.last2, 1)
  where {_NEAR('a.last', 'b.last2')} and levenshtein(substr(a.child, 1, 6), substr(b.child, 1, 6)) <= 2 and levenshtein(substr(a.child, 8, 6), substr(b.child, 8, 6)) <= 2 and length(a.child) = length(b.child)
    and left(a.last, 1) = left(b.last, 1) and {_NEAR('a.last', 'b.last')} and {_NEAR('a.father', 'b.father')} and left(a.maiden, 1) = left(b.maiden, 1) and {_NEAR('a.maiden', 'b.maiden')} and {_NEAR('a.mother', 'b.mother2')})
select 'b' || ak as a_event, 'c' || bk as b_event, '21' as family_line, 'both' as kind, cast(y as integer) as year_diff from x where y between 14 and 80
"""


@_query(_WITHIN_SQL)
def within_links(spark, sf_dir):
    out = within.within(births(spark, sf_dir), later_marriages(spark, sf_dir), "within_b_m", "FEMALE")
    return out.select("a_event", "b_event", "family_line", "kind", "year_diff")


_WEDDINGS = f"""
with p as (select k, gap, {_name('g', 6, 'k % 97')} as child, {_name('q', 6, 'k % 61')} as other, father, mother, last, maiden from ({_PEOPLE}) as people)
select 'c' || k as event, k % 9000 as days, child as bg, maiden as bl, {_EDIT.format('mother')} as mg, maiden as ml, father as gg, last as gl, father as fg, last as fl from p
union all select 'r' || k, k % 9000 + 3650 * gap, case when k % 2 = 0 then child else other end, case when k % 2 = 0 then maiden else {_name('z', 9, 'k')} end,
  case when k % 2 = 0 then mother end, case when k % 2 = 0 then maiden end, father, {_EDIT.format('last')}, father, last from p
"""


def weddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each groom's marriage, and a later one with the same bride (even keys) or another."""
    w = _made(spark, sf_dir, _WEDDINGS)
    person = lambda x, sex: _person(f"'{x}' || event", f"{x}g", f"{x}l", f"'{sex}'")
    none = _person(*["cast(null as string)"] * 4)
    return w.select("event", F.expr("date_add(date '1840-01-01', days)").alias("event_date"), person("b", "f").alias("subject"), person("g", "m").alias("partner"), none.alias("subject_father"), person("m", "f").alias("subject_mother"), person("f", "m").alias("partner_father"), none.alias("partner_mother"))


_COUPLES_SQL = f"""
with w as (select *, DATE '1840-01-01' + cast(days as integer) as d from ({_WEDDINGS.replace('as string', 'as varchar')}) as weddings),
x as (
  select a.event as a_event, b.event as b_event, cast({_PACKED('a.d', 'b.d')} as integer) as year_diff, a.mg is null as no_mother,
    left(a.bl, 1) = left(b.bl, 1) and {_NEAR('a.bl', 'b.bl')} and {_NEAR('a.bg', 'b.bg')} as s, coalesce(left(a.ml, 1) = left(b.ml, 1) and {_NEAR('a.ml', 'b.ml')} and {_NEAR('a.mg', 'b.mg')}, false) as sm
  from w a join w b on left(a.gl, 1) = left(b.gl, 1) and left(a.fl, 1) = left(b.fl, 1)
  where a.event <> b.event and {_NEAR('a.gl', 'b.gl')} and {_NEAR('a.fl', 'b.fl')} and {_NEAR('a.gg', 'b.gg')} and {_NEAR('a.fg', 'b.fg')} and b.d >= a.d)
select a_event, b_event, 'same_couple' as link, '21' as family_line, 'mother' as kind, year_diff from x where s and sm
union all select a_event, b_event, 'same_couple', '22', 'father', year_diff from x where s and sm
union all select a_event, b_event, 'remarriage_groom', '22', 'father', year_diff from x where not (s and (no_mother or sm))
"""


@_query(_COUPLES_SQL)
def couple_links(spark, sf_dir):
    w = weddings(spark, sf_dir)
    return couples.couples(w, w, in_order=True).select("a_event", "b_event", "link", "family_line", "kind", "year_diff")


_PERSON_SQL = f"""
with l as ({_BETWEEN_SQL}), e as (select substr(a_event, 2) as i, substr(b_event, 2) as j, a_event, b_event from l)
select 'bm' || i as id1, 'ms' || j as id2, 'B_B-M' as process, a_event, b_event from e union all select 'bf' || i, 'mp' || j, 'B_B-M', a_event, b_event from e
"""


def _person_links(spark, sf_dir):
    return closure.between_person_links(_links(spark, sf_dir), births(spark, sf_dir), marriages(spark, sf_dir), "B_B-M").select("id1", "id2", "process", "a_event", "b_event")


@_query(_PERSON_SQL)
def person_links(spark, sf_dir):
    return _person_links(spark, sf_dir)


_MD5 = "md5(class_id)"
_UUID_SQL = f"substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-3' || substr({_MD5}, 14, 3) || '-' || substr('89ab', (position(substr({_MD5}, 17, 1) in '0123456789abcdef') - 1) % 4 + 1, 1) || substr({_MD5}, 18, 3) || '-' || substr({_MD5}, 21, 12)"
_CLASSES_SQL = f"""
with recursive pl as ({_PERSON_SQL}), n as (select id1 as x, id2 as y from pl union select id2, id1 from pl),
r as (select x, x as y from n union select r.x, n.y from r join n on r.y = n.x),
c as (select x as person, min(y) as class_id from r group by x)
"""


def _classes(spark, sf_dir):
    return closure.classes(_person_links(spark, sf_dir))


@_query(f"{_CLASSES_SQL} select person, class_id, {_UUID_SQL} as class_uuid from c")
def closure_components(spark, sf_dir):
    return _classes(spark, sf_dir)


@_query(f"{_CLASSES_SQL}, s as (select class_id, count(*) as size from c group by class_id) select size, count(*) as n_classes from s group by size")
def closure_size_dist(spark, sf_dir):
    return closure.size_distribution(_classes(spark, sf_dir))


@_query(f"{_CLASSES_SQL}, s as (select class_id, count(*) as size from c group by class_id) select cast(sum(size) as bigint) as n_members, count(*) as n_classes, max(size) as largest from s")
def closure_verify(spark, sf_dir):
    return closure.verify(_classes(spark, sf_dir))


@_query(
    f"{_CLASSES_SQL}, u as (select *, '<https://www.example.org/' || {_UUID_SQL} || '>' as who from c) "
    "select distinct who || ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://personsincontext.org/model#PersonReconstruction> .' as value from u "
    "union all select who || ' <http://www.w3.org/ns/prov#wasDerivedFrom> <' || person || '> .' from u"
)
def reconstruction_triples(spark, sf_dir):
    return closure.reconstruction(_classes(spark, sf_dir))


def _graph(spark, sf_dir):
    """Nations as N-Triples."""
    n = _table(spark, sf_dir, "nation")
    lines = F.array(
        F.expr("'<urn:n' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:Nation> .'"), F.expr("'<urn:n' || n_nationkey || '> <urn:name> \"' || n_name || '\" .'"),
        F.expr("'<urn:n' || n_nationkey || '> <urn:in> <urn:r' || n_regionkey || '> .'"), F.when(F.col("n_nationkey") % 3 == 0, F.expr("'<urn:n' || n_nationkey || '> <urn:third> \"1\"^^<urn:int> .'")),
    )
    return triples.parse(n.select(F.explode(F.array_compact(lines)).alias("value")))


@_query("select 'urn:n' || n_nationkey as nation, n_name as name, 'urn:r' || n_regionkey as region, case when n_nationkey % 3 = 0 then '1' end as third from nation")
def graph_patterns(spark, sf_dir):
    g = _graph(spark, sf_dir)
    core = triples.pattern(g, "urn:name", "nation", "name").join(triples.pattern(g, "urn:in", "nation", "region"), "nation")
    return core.join(triples.pattern(g, "urn:third", "nation", "third"), "nation", "left")


@_query("select 'urn:Nation' as class, count(*) as n from nation")
def class_summary(spark, sf_dir):
    return triples.class_counts(_graph(spark, sf_dir))


@_query("select 'urn:r' || n_regionkey as region, count(*) as nations, min(n_name) as first_name from nation where n_nationkey % 3 <> 0 group by n_regionkey")
def graph_query(spark, sf_dir):
    text = """
        PREFIX u: <urn:>
        SELECT ?region (COUNT(?x) AS ?nations) (MIN(?name) AS ?first_name)
        WHERE { ?x u:in ?region ; u:name ?name ; a u:Nation . OPTIONAL { ?x u:third ?third } FILTER(!BOUND(?third)) }
        GROUP BY ?region
    """
    return sparql.query(_graph(spark, sf_dir), text)


@_query(f"with p as ({_PEOPLE_SQL}) select count(*) as total, count(*) filter (where sex = 'f' or sex = 'm') as indexed, count(*) filter (where sex = 'f') as both_parents, count(*) filter (where false) as mother_only, count(*) filter (where sex = 'm') as father_only from p")
def index_counts(spark, sf_dir):
    b = births(spark, sf_dir)
    return summaries.index_summary(b.withColumn("subject_mother", F.when(F.col("subject.gender") == "f", F.col("subject_mother"))))


@_query(f"with c as ({_COUPLES_SQL}) select link, family_line, kind, count(*) as n_links from c group by all")
def link_counts(spark, sf_dir):
    return summaries.link_summary(couple_links(spark, sf_dir))
