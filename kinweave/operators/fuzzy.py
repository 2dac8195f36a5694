"""Fuzzy joins on names: distinct names are paired first, people afterwards.

Names are compared once for each pair of distinct names, and only if they share a
key. A name's keys are its variants with up to t characters left out: two names within t
edits have one in common. Long names, which have too many variants, are keyed by segments:
the indexed name is cut into more segments than there may be edits, so one of them stands
unchanged in the other name, at a place that the edits before it allow. Last names are compared
only among people whose first names fit, and where two relatives must both fit, only among
certificates in which both may.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.shared import kept, partitions

#: Sought names of so many characters at most are keyed by variants, by the most edits asked for (1,100 variants at most).
WHOLE = {0: 1 << 30, 1: 1 << 30, 2: 40, 3: 18, 4: 13}
#: The same among people whose first names fit: groups are small there, so short segments tell enough apart.
WHOLE_GROUPED = {0: 1 << 30, 1: 1 << 30, 2: 40, 3: 8, 4: 8}
#: The years of an event fall into this many buckets for each width of the window that is sought.
YEAR_BUCKETS = 4
#: Groups are compared pair by pair if that is so many pairs a row at most.
MOST_PAIRS = 600
#: Keys are made in pieces of so many.
_PIECE = 1 << 20
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hashed(codes: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each last axis of codes, of its length and of seed."""
    h = np.full(codes.shape[:-1], codes.shape[-1] * 1_000_003 + seed, np.uint64)
    for j in range(codes.shape[-1]):
        h += codes[..., j] * _MIX[j % len(_MIX)] if j < len(_MIX) else _mixed(codes[..., j] + np.uint64(j))
    return _mixed(h)


@cache
def _kept_places(n: int, out: int) -> np.ndarray:
    found = list(combinations(range(n), n - out))
    return np.array(found, np.intp).reshape(len(found), n - out)


@cache
def _reach(n: int, most: int, fixed: bool, whole: int) -> tuple[tuple[int, ...], int]:
    """For an indexed name of n characters: how many to leave out for sought names with variants, and the edits of those with segments (-1: none)."""
    outs, edits = set(), -1
    for m in range(max(0, n - most), n + most + 1):
        t = names.allowed_edits(m, most, fixed)
        if abs(m - n) <= t:
            if m <= whole:
                outs |= set(range(max(0, n - m), t - max(0, m - n) + 1))
            else:
                edits = max(edits, t)
    return tuple(sorted(outs)), edits


@cache
def _segments(n: int, edits: int) -> tuple[tuple[int, int], ...]:
    """(start, size) of edits + 1 segments of n characters."""
    size, longer = divmod(n, edits + 1)
    sizes = [size] * (edits + 1 - longer) + [size + 1] * longer
    return tuple((sum(sizes[:i]), s) for i, s in enumerate(sizes))


@cache
def _windows(n: int, most: int, fixed: bool, whole: int, block: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(indexed length, segment, start, size) of the parts of a sought name of n characters that an indexed one's segments may equal.

    With t edits, some segment i is unchanged with i edits at most before it, and t - i after it.
    """
    t, found = names.allowed_edits(n, most, fixed), []
    for m in range(max(0, n - t), n + t + 1):
        if block and m == 0:
            continue
        for i, (p, size) in enumerate(_segments(m - block, _reach(m, most, fixed, whole)[1])[: t + 1]):
            for s in range(max(-i, n - m - (t - i)), min(i, n - m + (t - i)) + 1):
                if 0 <= p + s and p + s + size <= n - block:
                    found.append((m, i, p + s, size))
    return tuple(dict.fromkeys(found))


def _keys(codes: np.ndarray, sought: bool, most: int, fixed: bool, whole: int, block: bool) -> np.ndarray:
    """Keys (a row a name) of names of one length; with block the first character is in every key and not left out."""
    n = codes.shape[1]
    if block and n == 0:
        return np.zeros((len(codes), 0), np.uint64)
    rest, out = codes[:, int(block) :], []
    if sought:
        outs = range(names.allowed_edits(n, most, fixed) + 1) if n <= whole else ()
        parts = () if n <= whole else _windows(n, most, fixed, whole, block)
    else:
        outs, edits = _reach(n, most, fixed, whole)
        parts = tuple((n, i, p, size) for i, (p, size) in enumerate(_segments(n - block, edits))) if edits >= 0 else ()
    for k in outs:
        if k <= rest.shape[1]:
            out.append(_hashed(rest[:, _kept_places(rest.shape[1], k)], 1))
    for m, i, start, size in parts:
        out.append(_hashed(rest[:, start : start + size], 2 + m * 64 + i)[:, None])
    keys = np.concatenate(out, 1) if out else np.zeros((len(codes), 0), np.uint64)
    return _mixed(keys + codes[:, :1] * _MIX[0]) if block else keys


def _n_keys(n: int, sought: bool, most: int, fixed: bool, whole: int, block: bool) -> int:
    return _keys(np.zeros((1, n), np.uint64), sought, most, fixed, whole, block).shape[1]


def _keyed(sought: bool, most: int, fixed: bool, whole: int, block: bool):
    """Rows (key, name, ...) of rows (name, ...): each key of a name once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(0)).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                step = max(1, _PIECE // max(1, _n_keys(int(n), sought, most, fixed, whole, block)))
                for i in range(0, len(at), step):
                    rows = batch.take(pa.array(at[i : i + step]))
                    codes = np.frombuffer("".join(rows.column(0).to_pylist()).encode("utf-32-le"), "<u4").reshape(len(rows), n).astype(np.uint64) + np.uint64(1)
                    keys = np.sort(_keys(codes, sought, most, fixed, whole, block), 1)
                    once = np.ones(keys.shape, bool)
                    once[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    of, which = np.nonzero(once)
                    rows = rows.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[of, which].view(np.int64)), *rows.columns], names=["key", *rows.schema.names])

    return run


def _near(a: DataFrame, b: DataFrame, most: int, fixed: bool, block: bool) -> tuple[Column, Column]:
    """Whether names a and b lie within a's allowed edits, and their distance (-1 if beyond most)."""
    distance = F.when(F.col(a) == F.col(b), 0).otherwise(F.levenshtein(a, b, most))
    near = F.abs(F.length(a) - F.length(b)) <= names.allowed(F.length(a), most, fixed)
    if block:
        near = near & (F.col(a) != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return near & distance.between(0, names.allowed(F.length(a), most, fixed)), distance


def _pairs(a: DataFrame, b: DataFrame, most: int, fixed: bool, block: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, distance) of distinct rows a(by, a) and b(by, b): each side's names are keyed and dealt by key (never a broadcast: the planner can't see how many keys there are)."""
    near, distance = _near("a", "b", most, fixed, block)
    n, whole = partitions(a.sparkSession), (WHOLE_GROUPED if by else WHOLE)[most]

    def keyed(side: DataFrame, name: str, sought: bool) -> DataFrame:
        rows = side.select(name, *by).filter(F.col(name).isNotNull()).repartition(n, name, *by)  # dealt evenly: what follows is work, not bytes
        schema = ", ".join(["key bigint", f"{name} string", *(f"`{c}` {dict(side.dtypes)[c]}" for c in by)])
        rows = rows.distinct().mapInArrow(_keyed(sought, most, fixed, whole, block), schema)
        return rows.withColumn("key", F.xxhash64("key", *by)) if by else rows

    left, right = keyed(a, "a", True), keyed(b, "b", False)
    equal = a.select("a", *by).distinct().join(b.select(F.col("b").alias("a"), *by).distinct().hint("merge"), ["a", *by]).select(*by, "a", F.col("a").alias("b"))  # these share all keys
    unlike = near & (F.col("a") != F.col("b"))
    for c in by:
        right, unlike = right.withColumnRenamed(c, f"_{c}"), unlike & (F.col(c) == F.col(f"_{c}"))
    found = left.join(right.hint("merge"), "key").filter(unlike).select(*by, "a", "b").distinct()
    return found.unionByName(equal.filter(near)).withColumn("distance", distance)


def pairs_blocked(a: DataFrame, b: DataFrame, most: int = 4, fixed: bool = False) -> DataFrame:
    """(a, b, distance) of names a(a), b(b) that share their first character and lie within a's allowed edits."""
    return _pairs(a, b, most, fixed, True)


def pairs_unblocked(a: DataFrame, b: DataFrame, most: int = 4, fixed: bool = False) -> DataFrame:
    """As pairs_blocked, for any first characters."""
    return _pairs(a, b, most, fixed, False)


def name_index(people: DataFrame) -> DataFrame:
    """people(event, given, family, ...) of valid names: a row for each first name (fn, last, n_b)."""
    valid = people.filter(names.is_valid(F.col("given"), F.col("family"), F.col("event")))
    return valid.withColumns({"n_b": names.index_count(F.col("given")), "last": names.canonical(F.col("family"))}).withColumn("fn", F.explode(names.first_names(F.col("given")))).drop("given", "family")


def _few(a: DataFrame, b: DataFrame, by: list[str]) -> bool:
    """Whether a and b have few pairs of rows that are equal in by."""
    count = lambda d, n: d.groupBy(*by).agg(F.count("*").alias(n))
    both = count(a, "x").join(count(b, "y"), by, "full_outer").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("pairs"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    return (both["pairs"] or 0) <= MOST_PAIRS * (both["x"] + both["y"])


class Search:
    """People a sought in the index of people b, both (event, given, family).

    a may hold more columns, which are kept; those in same, which b has too, must be equal.
    The pairs of first names are found once, in the shared folder, for all that is asked.
    """

    def __init__(self, a: DataFrame, b: DataFrame, most: int = 4, fixed: bool = False, block: bool = True, same: tuple[str, ...] = ()):
        self.same, self.rest = same, [c for c in a.columns if c not in ("event", "given", "family")]
        self.most, self.fixed, self.block = most, fixed, block
        probe = a.filter(names.is_valid(F.col("given"), F.col("family"), F.col("event")))
        probe = probe.select(F.col("event").alias("a_event"), *self.rest, names.probe_count(F.col("given")).alias("n_a"), names.canonical(F.col("family")).alias("a_last"), F.explode(F.array_distinct(names.first_names(F.col("given")))).alias("src"))
        self.probe = kept(probe.filter("src <> ''"), "sought")
        self.index = kept(name_index(b).withColumnRenamed("event", "b_event"), "index")
        firsts = pairs_unblocked(self.probe.select(F.col("src").alias("a")), self.index.select(F.col("fn").alias("b")), most, fixed)
        self.firsts = kept(firsts.select(F.col("a").alias("src"), F.col("b").alias("fn"), F.col("distance").alias("fn_distance")), "first-names")

    def _lasts(self, named: DataFrame, index: DataFrame) -> DataFrame:
        """(same, fn, a_last, last, last_distance): last names of named(same, fn, a_last) and index(same, fn, last) that are near, among those with one first name."""
        by = [*self.same, "fn"]
        a = kept(named.filter(" and ".join(f"{c} is not null" for c in by)).select(*by, F.col("a_last").alias("a")).distinct(), "sought-names")
        b = kept(index.select(*by, F.col("last").alias("b")).distinct(), "indexed-names")
        letter = ["_letter"] * self.block
        lettered = lambda d, c: d.withColumn("_letter", F.substring(c, 1, 1)) if self.block else d
        if _few(lettered(a, "a"), lettered(b, "b"), by + letter):
            near, distance = _near("a", "b", self.most, self.fixed, self.block)
            found = lettered(a, "a").join(lettered(b, "b").hint("merge"), by + letter).filter(near).select(*by, "a", "b", distance.alias("distance"))
        else:
            found = _pairs(a, b, self.most, self.fixed, self.block, tuple(by))
        return kept(found.select(*by, F.col("a").alias("a_last"), F.col("b").alias("last"), F.col("distance").alias("last_distance")), "last-names")

    def hits(self, span: tuple[int, int] | None = None) -> DataFrame:
        """a_event, n_a, src (a's first name), b_event, fn (b's first name), n_b, fn_distance, last_distance; first and last name come from one indexed person.

        span: b's year less a's, at least and at most; both sides then have a column year, and a common name's
        people fall into buckets of years, of which only those in reach meet. Rows without a year have no hit.
        """
        probe, index, on = self.probe, self.index, ["last", "fn", *self.same]
        if span is not None:
            low, high = span
            width = max(1, (high - low + 1) // YEAR_BUCKETS)
            bucket = lambda year: F.floor(year / width).cast("int")
            index = index.withColumnsRenamed({"year": "b_year"}).filter("b_year is not null").withColumn("bucket", bucket(F.col("b_year")))
            probe = probe.filter("year is not null")
            on = [*on, "bucket"]
        elif "year" in index.columns:
            index = index.drop("year")
        named = probe.join(self.firsts, "src")
        found = named.join(self._lasts(named, index).hint("merge"), [*self.same, "fn", "a_last"])
        if span is not None:
            found = found.withColumn("bucket", F.explode(F.sequence(bucket(F.col("year") + low), bucket(F.col("year") + high))))
        found = found.join(index.hint("merge"), on)
        if span is not None:
            found = found.filter((F.col("b_year") - F.col("year")).between(*span))
        return found.select("a_event", *self.rest, "n_a", "src", "b_event", "fn", "n_b", "fn_distance", "last_distance")

    def joint_hits(self, pairs: list[tuple[str, str]], span: tuple[int, int] | None = None) -> DataFrame:
        """The rows of hits() for those a_event and b_event where both people of one of pairs have a hit; maybe for others, too.

        pairs are values of the first column in same. Certificates meet by what first names and first characters of last
        names allow for both people at once.
        """
        role, unit = self.same[0], [c for c in self.rest if c not in self.same and c != "year"]
        place = lambda k: F.filter(F.array(*(F.when(F.col(role) == p[k], i) for i, p in enumerate(pairs))), lambda x: x.isNotNull())
        letter = F.substring("last", 1, 1) if self.block else F.lit("")

        def both(people: DataFrame, event: str, by: list[str]) -> DataFrame:
            one = lambda k: people.withColumn("way", F.explode(place(k))).select(event, *by, "way", F.col("fn").alias(f"fn{k}"), F.col("last").alias(f"last{k}"), letter.alias(f"letter{k}"), *[F.col("year").alias("year")] * (k == 0)).distinct()
            return kept(one(0).join(one(1).hint("merge"), [event, *by, "way"]), "couples")

        dated = lambda d: (d.filter("year is not null") if span is not None else d if "year" in d.columns else d.withColumn("year", F.lit(None).cast("int")))
        probe, index = dated(self.probe), dated(self.index)
        a = both(probe.join(self.firsts, "src").withColumnRenamed("a_last", "last"), "a_event", unit)
        b = both(index, "b_event", []).withColumnsRenamed({"last0": "b0", "last1": "b1", "year": "b_year"})
        on = ["way", "fn0", "fn1", *["letter0", "letter1"] * self.block]
        if not _few(a, b, on):
            return self.hits(span)
        found = a.join(b.hint("merge"), on)
        for k in (0, 1):
            found = found.filter(_near(f"last{k}", f"b{k}", self.most, self.fixed, self.block)[0])
        if span is not None:
            found = found.filter((F.col("b_year") - F.col("year")).between(*span))
        found = kept(found.select("a_event", *unit, "b_event").distinct(), "certificates")
        index = index.withColumnsRenamed({"year": "b_year"})
        found = found.join(probe, ["a_event", *unit]).join(index, ["b_event", *self.same])
        near_last, last_distance = _near("a_last", "last", self.most, self.fixed, self.block)
        near_first, fn_distance = _near("src", "fn", self.most, self.fixed, False)
        found = found.filter(near_last & near_first)
        if span is not None:
            found = found.filter((F.col("b_year") - F.col("year")).between(*span))
        return found.select("a_event", *self.rest, "n_a", "src", "b_event", "fn", "n_b", fn_distance.alias("fn_distance"), last_distance.alias("last_distance"))

    def found(self, by: list[str], wanted: DataFrame | None = None) -> DataFrame:
        """The distinct a_event and by of people with a hit in any year, among those of wanted(a_event, by) if given.

        Equal names are sought first, and near ones for who is left; names only are compared, and no one's namesakes.
        """
        by = ["a_event", *by]
        asked = self.probe.select(*dict.fromkeys([*by, *self.same]), "a_last", "src").distinct()
        if wanted is not None:
            asked = asked.join(wanted.distinct(), by, "left_semi")
        known = self.index.select(*self.same, "fn", "last").distinct()
        equal = kept(asked.join(known.withColumnsRenamed({"fn": "src", "last": "a_last"}), [*self.same, "src", "a_last"], "left_semi").select(*by).distinct(), "found")
        named = kept(asked.join(equal, by, "left_anti").join(self.firsts, "src"), "not-found")
        known = known.join(named.select(*self.same, "fn").distinct(), [*self.same, "fn"], "left_semi")
        return equal.unionByName(named.join(self._lasts(named, known), [*self.same, "fn", "a_last"], "left_semi").select(*by)).distinct()


def candidates(a: DataFrame, b: DataFrame, most: int = 4, fixed: bool = False, block: bool = True, same: tuple[str, ...] = ()) -> DataFrame:
    """All hits of people a in the index of people b."""
    return Search(a, b, most, fixed, block, same).hits()


def assigned(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row for keys + a_event, b_event: matched, lev_total, lev_max, n_a, n_b.

    First names with the fewest candidates choose first (ties by name), each the nearest
    free name of the other side (ties by name); lev_max leaves the last name out.
    """
    by = [*keys, "a_event", "b_event"]
    hits = hits.repartition(*by)  # both groupings below keep to it
    one = hits.groupBy(*by, "src").agg(F.array_sort(F.collect_set(F.struct("fn_distance", "fn"))).alias("cands"), F.min("last_distance").alias("last"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    per = one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.size("cands").alias("n"), "src", "cands"))).alias("all"), F.min("last").alias("last"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.lit(0).alias("matched"), F.lit(0).alias("total"), F.lit(0).alias("most"))

    def take(acc: Column, x: Column) -> Column:
        free = F.filter(x["cands"], lambda c: ~F.array_contains(acc["used"], c["fn"]))
        best = F.get(free, 0)
        none = F.size(free) == 0
        return F.when(none, acc).otherwise(F.struct(F.array_append(acc["used"], best["fn"]).alias("used"), (acc["matched"] + 1).alias("matched"), (acc["total"] + best["fn_distance"]).alias("total"), F.greatest(acc["most"], best["fn_distance"]).alias("most")))

    done = per.withColumn("r", F.aggregate("all", start, take))
    return done.select(*by, F.col("r.matched").alias("matched"), (F.col("last") + F.col("r.total")).alias("lev_total"), F.col("r.most").alias("lev_max"), "n_a", "n_b")


def common_events(one: DataFrame, other: DataFrame) -> DataFrame:
    """Events that two roles of one A have in common, with both distances: (a_event, b_event, distances, n_names) of rows (a_event, b_event, distance, n)."""
    both = one.select("a_event", "b_event", F.col("distance").alias("d1"), F.col("n").alias("n1")).join(other.select("a_event", "b_event", F.col("distance").alias("d2"), F.col("n").alias("n2")), ["a_event", "b_event"])
    return both.select("a_event", "b_event", F.concat_ws("-", "d1", "d2").alias("distances"), F.concat_ws("-", "n1", "n2").alias("n_names"))


def enough_names() -> Column:
    """Two names at least must match if both sides have more than one."""
    return ~((F.col("n_a") > 1) & (F.col("n_b") > 1) & (F.col("matched") < 2))
