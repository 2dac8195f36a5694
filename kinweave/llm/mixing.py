"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents with the same set of sources form a pattern. A flow carries words
from patterns to source quotas; the first copy of a pattern's words is free and
every further copy costs more, so nothing is repeated while unused words can
fill the quota. The network has one node a pattern and one a source,
never one a document. Within a pattern whole documents are taken in the order of
a seeded hash until its flow is reached; the limit in that order is found with
a histogram of hash cells, so a large source is not sorted in one task, and
taking a document is a comparison with its pattern's limit.

A null text has size 0. A null source is a source of its own, the last. Rows equal
in id and text are taken together. The limit is sought in steps: each finds, by a histogram, the
cell of the order that it lies in, until few rows are left. Long texts are one document like any
other, so a source's words may miss its quota by half the size of one. An empty table gives an
empty mix. Further columns are carried along, whatever their names.

Where every document has one source, the flow has no choice but the smaller of quota and supply;
it decides where sources overlap (sources= of Mix, overlapping()).
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import kept, prepare, whole

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = "mix-1"
#: Patterns and sources that are brought to the driver at most; more raise an error.
MOST_PATTERNS = 100_000
#: Hexadecimal digits of the order key by which a step of the search for a limit parts the rows, digits it looks at, at most, and rows that are then put in order.
CELL_DIGITS, MOST_DIGITS, MOST_IN_CELL = 3, 30, 100_000


def by_weight(sizes: list[int], weights: list[int], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess is shared again."""
    caps = [most * s for s in sizes]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= caps[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in sorted(full):
            target[i] = float(caps[i])
            left -= caps[i]
            open_.discard(i)
    return target


def min_cost_flow(supply: dict[str, tuple[int, list[str]]], quota: dict[str, int], copies: int) -> dict[str, int]:
    """Words taken from each pattern: largest flow to the quotas, cheapest by convex copy costs.

    Copy k of a pattern's words costs k. Successive cheapest augmenting paths with
    potentials; the costs are small integers, so few distinct path lengths occur.
    """
    graph: dict[object, list[list]] = defaultdict(list)  # [to, capacity, cost, index of the reverse arc]

    def arc(a: object, b: object, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (words, sources) in sorted(supply.items()):
        for k in range(copies):
            arc("from", ("pattern", p), words, k)
        for s in sources:
            arc(("pattern", p), ("source", s), words * copies, 0)
    for s, words in sorted(quota.items()):
        arc(("source", s), "to", words, 0)
    potential: dict[object, int] = defaultdict(int)
    while True:
        distance, seen, heap, count = {"from": 0}, set(), [(0, 0, "from")], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            for v, capacity, cost, _ in graph[u]:
                if capacity > 0 and v not in seen and (e := d + cost + potential[u] - potential[v]) < distance.get(v, 1 << 60):
                    count += 1
                    distance[v] = e
                    heapq.heappush(heap, (e, count, v))
        if "to" not in distance:
            break
        top = max(distance.values())
        for v in list(graph):
            potential[v] += distance.get(v, top)
        # blocking flow over the arcs of reduced cost 0, depth first without recursion
        at, dead = defaultdict(int), set()
        while True:
            path, u = [], "from"
            on = {"from"}
            while u != "to":
                arcs = graph[u]
                while at[u] < len(arcs):
                    a = arcs[at[u]]
                    if a[1] > 0 and a[0] not in on and a[0] not in dead and a[2] + potential[u] - potential[a[0]] == 0:
                        break
                    at[u] += 1
                if at[u] == len(arcs):
                    if not path:
                        break
                    dead.add(u)
                    on.discard(u)
                    u = path.pop()
                    at[u] += 1
                    continue
                path.append(u)
                u = arcs[at[u]][0]
                on.add(u)
            if u != "to":
                break
            amount = min(graph[x][at[x]][1] for x in path)
            for x in path:
                a = graph[x][at[x]]
                a[1] -= amount
                graph[a[0]][a[3]][1] += amount
    return {p: sum(graph[("pattern", p)][i][1] for i, a in enumerate(graph[("pattern", p)]) if a[0] == "from") for p in supply}


def _pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def _order_key(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(whole())))


class Mix:
    """A mix of docs: targets by source, and the limit in the seeded order by pattern.

    sources: a column with the array of a document's sources (default: its source).
    """

    def __init__(self, docs: DataFrame, sources: Column | None = None, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, copies: int = MOST_COPIES, seed: str = SEED):
        self.spark = prepare(docs.sparkSession)
        self.sources, self.seed = F.array("source") if sources is None else sources, seed
        self.sizes = kept(docs.select(*self._measures()), "sizes")
        rows = self.sizes.groupBy("_pattern").agg(F.sum("_size")).limit(MOST_PATTERNS + 1).collect()
        if len(rows) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
        self.words = {r[0]: r[1] for r in rows}
        member = {p: [json.dumps(s) for s in json.loads(p)] for p in self.words}
        self.source_size: dict[str, int] = defaultdict(int)
        for p, names in member.items():
            for s in names:
                self.source_size[s] += self.words[p]
        names = sorted(self.source_size, key=lambda s: (s == "null", json.loads(s) or ""))
        sizes = [self.source_size[s] for s in names]
        targets = by_weight(sizes, [weights[i % len(weights)] for i in range(len(names))], percent * sum(self.words.values()) / 100, copies) if sum(sizes) else [0.0] * len(names)
        self.targets = dict(zip(names, targets))
        flow = min_cost_flow({p: (w, member[p]) for p, w in self.words.items()}, {s: int(t) for s, t in self.targets.items()}, copies)
        plan = [(p, flow[p] // w if w else 0, flow[p] % w if w else 0) for p, w in self.words.items()]
        self.limits = self._limits(plan)

    def _measures(self) -> list[Column]:
        return [_pattern(self.sources).alias("_pattern"), _order_key(self.seed).alias("_order"), F.regexp_count(whole(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_size")]

    def _limits(self, plan: list[tuple[str, int, int]]) -> dict[str, tuple[int, str]]:
        """Copies that all documents of a pattern have, and the order key up to which they have one more."""
        whole_copies = {p: k for p, k, _ in plan}
        inside = {p: ("", r) for p, _, r in plan if r}  # the part of the order in which the limit lies, and the words still to take in it
        digits = 0
        while inside and digits < MOST_DIGITS:  # each step leaves one cell in 16 ** CELL_DIGITS
            digits += CELL_DIGITS
            cells = self._within(inside).groupBy("_pattern", "rest", F.substring("_order", 1, digits).alias("cell")).agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
            up = Window.partitionBy("_pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
            cells = cells.withColumn("upto", F.sum("words").over(up)).filter("upto - words < rest and upto >= rest")
            rows = cells.select("_pattern", "cell", F.col("rest") - F.col("upto") + F.col("words"), "n").collect()  # one row a pattern
            inside = {r[0]: (r[1], r[2]) for r in rows}
            if all(r[3] <= MOST_IN_CELL for r in rows):
                break
        # equal rows are one, so that many of them are no large cell
        inside_rows = self._within(inside).groupBy("_pattern", "rest", "_order").agg(F.sum("_size").alias("_size"), F.max("_size").alias("one"))
        so_far = Window.partitionBy("_pattern").orderBy("_order")
        last = F.max(F.when(F.col("upto") - F.col("one") / 2 <= F.col("rest"), F.col("_order"))).alias("limit")
        found = inside_rows.withColumn("upto", F.sum("_size").over(so_far)).groupBy("_pattern").agg(last).collect()  # one row a pattern
        limit = {r[0]: inside[r[0]][0] if r[1] is None else r[1] for r in found}
        return {p: (k, limit.get(p, "")) for p, k in whole_copies.items()}

    def _within(self, inside: dict[str, tuple[str, int]]) -> DataFrame:
        """The rows of sizes in their pattern's part of the order, with the words to take there (rest)."""
        part = self.spark.createDataFrame([(p, c, r) for p, (c, r) in inside.items()] or [("", "", 0)], "_pattern string, prefix string, rest long")
        return self.sizes.join(F.broadcast(part), "_pattern").filter(F.col("_order").startswith(F.col("prefix")))  # MOST_PATTERNS rows at most

    def copies(self, docs: DataFrame) -> DataFrame:
        """(row, size, copies): docs' columns as a struct, their words, and how often the mix takes a document."""
        table = self.spark.createDataFrame([(p, k, b) for p, (k, b) in self.limits.items()] or [("", 0, "")], "_pattern string, _whole int, _limit string")
        rows = docs.select(F.struct("*").alias("row"), *self._measures()).join(F.broadcast(table), "_pattern", "left")  # MOST_PATTERNS rows at most
        taken = F.coalesce(F.col("_whole") + F.when(F.col("_order") <= F.col("_limit"), 1).otherwise(0), F.lit(0))
        return rows.select("row", F.col("_size").alias("size"), taken.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns."""
    out = Mix(docs).copies(docs).filter("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def overlapping(docs: DataFrame, sources: Column) -> DataFrame:
    """doc_id, size and taken, where a document belongs to all sources of an array and its words may fill any of their quotas."""
    return Mix(docs, sources).copies(docs).select("row.doc_id", "size", (F.col("size") * F.col("copies")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "source")
    mix = Mix(docs)
    names = mix.spark.createDataFrame([(json.loads(s), mix.source_size[s], round(t, 6)) for s, t in mix.targets.items()] or [(None, 0, 0.0)], "name string, source_size long, target double")
    sized = mix.copies(docs).select("row.doc_id", "row.source", "size", (F.col("size") * F.col("copies")).alias("taken"))
    return sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left").select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
with d as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size,
    md5('{SEED}' || ':' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as ord from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from d group by source),
r as (select *, row_number() over (order by 2.0 * source_size / w, source nulls last) as k from s),
c as (
  select *, {SHARE_PERCENT} / 100.0 * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as remaining,
    sum(w) over (order by k rows between current row and unbounded following) as open_w from r),
u as (select min(k) as k from c where w * (remaining / open_w) < 2 * source_size),
t as (
  select c.source, c.source_size, cast(case when u.k is null or c.k < u.k then 2 * c.source_size else c.w * (x.remaining / x.open_w) end as double) as target
  from c cross join u left join c x on x.k = u.k),
p as (select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as whole_copies, case when source_size > 0 then cast(floor(target) as bigint) % source_size else 0 end as rest from t),
o as (
  select d.doc_id, d.size, p.source_size, p.target, p.whole_copies, d.ord, d.source, p.rest,
    sum(d.size) over (partition by d.source order by d.ord range between unbounded preceding and current row) - d.size / 2.0 as upto
  from d join p on d.source is not distinct from p.source),
l as (select source, max(ord) as limit_ord from o where rest > 0 and upto <= rest group by source)
select o.doc_id, cast(o.size as bigint) as size, o.source_size, round(o.target, 6) as target,
  cast(o.size * (o.whole_copies + case when l.limit_ord is not null and o.ord <= l.limit_ord then 1 else 0 end) as bigint) as taken
from o left join l on l.source is not distinct from o.source
"""
