"""MinHash near-dedup with ProbMinHash signatures, banding and verification.

A text's shingles (five words) weigh 1 + ln(times). Each shingle is a Poisson
process with its weight as rate; an arrival goes to a random signature
component, and a component keeps the shingle that came first. A text is done when the
next arrival of each shingle is later than all its components. Two components agree
with the probability Jaccard similarity of the texts.

Texts that agree in all rows of a band are candidates. Equal texts enter once. In a
bucket every text is compared with two leaders, its smallest id and its best
connected member, so pairs grow with the members, not with their square. Where a bucket still holds
several components afterwards, its members of different components are compared by
their signatures in blocks, the largest component's in shares that go to different tasks, and only those whose estimate comes near the
threshold are verified, so no link between different texts is lost to the leaders.
A pair is linked if the set or the probability Jaccard similarity of its
shingles, computed from the texts, reaches the threshold.

Texts without a word count as copies of one another; texts of one to four words have
one shingle of all their words. A null doc_id can't be a class: its row has
class null and stays. Rows that repeat an id are one document, with the text whose MD5 is the
smallest. Long texts are signed whole, in one slice of their own. An empty table gives no row;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import kept, partitions, prepare, whole
from kinweave.llm.textbatch import Texts, mix, shingles, slices, string_buffers
from kinweave.operators.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
#: Components of a signature; the bands use the first BANDS * ROWS, estimates use all.
COMPONENTS = 384
#: Standard errors below the threshold at which a signature estimate still asks for verification.
MARGIN = 5.0
BLOCK = 512
#: Members of a bucket for each share that it is dealt to, where it holds several components.
SHARE_ROWS = 400

_G = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: Texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, times) of the distinct shingles, ordered by text and hash."""
    words = texts.words()
    if not len(words.starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, owners = shingles(texts.range_hash(words.starts, words.ends), words, size, least=True)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])]))
    return values[first], owners[first], np.diff(np.append(first, len(values)))


def signatures(hashes: np.ndarray, owners: np.ndarray, weights: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, (texts, m); a text without shingles has zeros."""
    first_at = np.full(n_texts * m, np.inf)
    out = np.zeros(n_texts * m, np.uint64)
    t = np.zeros(len(hashes))
    seed = hashes.copy()
    rows = np.arange(len(hashes))
    while len(rows):
        points = 1 if len(rows) > 4096 else 16
        steps = np.arange(1, points + 1, dtype=np.uint64) * _G
        draw = mix(seed[:, None] + steps)
        seed = seed + steps[-1]
        gap = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52)
        times = t[:, None] + np.cumsum(gap, 1) / weights[rows][:, None]
        slot = (mix(draw ^ _G) % np.uint64(m)).astype(np.int64) + owners[rows][:, None] * m
        sooner = times < first_at[slot]
        at, when, who = slot[sooner], times[sooner], np.broadcast_to(hashes[rows][:, None], slot.shape)[sooner]
        np.minimum.at(first_at, at, when)
        won = when == first_at[at]
        out[at[won]] = who[won]
        last = first_at.reshape(n_texts, m).max(1)
        on = times[:, -1] < last[owners[rows]]
        rows, t, seed = rows[on], times[on, -1], seed[on]
    return out.reshape(n_texts, m)


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            hashes, owners, times = weighted_shingles(texts, size)
            n = len(texts)
            sig = signatures(hashes, owners, 1 + np.log(np.maximum(times, 1)), n, m)
            has = np.bincount(owners, minlength=n) > 0
            code = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                code = mix(code * _G + sig[:, r : bands * rows : rows])
            code = code + np.arange(bands, dtype=np.uint64) * _G
            part = batch.slice(row, end - row)
            short = mix(sig).astype(np.uint8)
            keys = pa.array([c.tolist() if h else [] for c, h in zip(mix(code).astype(np.int64), has)], pa.list_(pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), keys, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "copy_key", "bands", "signature"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of set Jaccard and probability Jaccard of two (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(both)
    if not len(both):
        return 1.0 if union == 0 else 0.0
    plain = len(both) / union
    xa, xb = wa[ia], wb[ib]
    ratio = xa / xb
    order = np.argsort(ratio, kind="stable")
    ratio, xa, xb = ratio[order], xa[order], xb[order]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    from_here = np.searchsorted(ratio, ratio, "left")  # shingles with a ratio at least this one's
    sum_a = np.concatenate([[0], np.cumsum(xa)])
    sum_b = np.concatenate([[0], np.cumsum(xb)])
    total = (sum_a[-1] - sum_a[from_here] + only_a) / xa + (sum_b[from_here] + only_b) / xb
    return max(plain, float((1 / total).sum()))


def _sets(column: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    data, at = string_buffers(column)
    texts = Texts(data[at[0] : at[-1]], at - at[0])
    hashes, owners, times = weighted_shingles(texts, size)
    cut = np.searchsorted(owners, np.arange(len(texts) + 1))
    weights = 1 + np.log(np.maximum(times, 1))
    return [(hashes[a:b], weights[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _verify(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    last: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            a = part.column(0).to_pylist()
            right = _sets(part.column(3), size)
            ok = []
            for i, x in enumerate(a):
                if last is None or last[0] != x:  # rows come ordered by a
                    last = (x, _sets(part.column(2).slice(i, 1), size)[0])
                ok.append(similarity(last[1], right[i]) >= threshold)
            yield pa.record_batch([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _copies(one: DataFrame) -> DataFrame:
    """(doc_id, copy_key, first_id): the smallest id with each document's text.

    A text with more than a tenth of a partition's share of all documents is looked up by broadcast: there
    are ten for each partition at most. So no task holds all copies of a text.
    """
    least = F.min("doc_id").alias("first_id")
    groups = kept(one.groupBy("copy_key").agg(least, F.count("*").alias("n")), "copy-groups")
    share = one.count() / (10 * partitions(one.sparkSession))
    often = F.col("n") > share
    by_lookup = one.join(F.broadcast(groups.filter(often).select("copy_key", F.col("first_id").alias("_hot"))), "copy_key", "left")
    rest = by_lookup.filter("_hot is null").join(groups.filter(~often).select("copy_key", "first_id"), "copy_key")
    return by_lookup.filter("_hot is not null").select("doc_id", "copy_key", F.col("_hot").alias("first_id")).unionByName(rest.select("doc_id", "copy_key", "first_id"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(partial(_verify, size=size, threshold=threshold), "a long, b long")


def _across(batches: Iterator[pa.RecordBatch], m: int, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a bucket whose signatures agree in a share ``least``; each from its first common bucket.

    A share of a bucket other than its first (salt > 0) leaves pairs outside the bucket's largest component to the first.
    """
    for key, salt, ids, parts, minor, sig, bands in _buckets(batches):
        order = np.lexsort((parts, minor))
        ids, parts, minor, sig, bands = ids[order], parts[order], minor[order], sig[order], bands[order]
        for i in range(0, len(ids), BLOCK):
            if salt and minor[i]:
                break
            for j in range(i, len(ids), BLOCK):
                if parts[i] == parts[min(j + BLOCK, len(ids)) - 1] and minor[i] == minor[min(j + BLOCK, len(ids)) - 1]:
                    continue
                agree = np.zeros((len(ids[i : i + BLOCK]), len(ids[j : j + BLOCK])), np.int16)
                for k in range(m):
                    agree += sig[i : i + BLOCK, k][:, None] == sig[j : j + BLOCK, k][None, :]
                apart = parts[i : i + BLOCK][:, None] != parts[j : j + BLOCK][None, :]
                if i == j:
                    apart = np.triu(apart)  # each pair once
                if salt:
                    apart &= ~(minor[i : i + BLOCK][:, None] & minor[j : j + BLOCK][None, :])
                x, y = np.nonzero((agree >= least * m) & apart)
                if len(x):
                    same = bands[i + x] == bands[j + y]
                    here = bands[i + x, same.argmax(1)] == key
                    p, q = ids[i + x][here], ids[j + y][here]
                    yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (key, salt, doc_id, part, minor, signature, bands) ordered by key and salt, a share of a bucket at a time."""
    at, held = None, []
    for batch in batches:
        keys, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (keys[a], salts[a]) != at:
                yield *at, *_joined(held)
                held = []
            at = keys[a], salts[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield *at, *_joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(held)
    sig = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(t.num_rows, -1)
    bands = t.column(6).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    return t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(4).to_numpy(zero_copy_only=False), sig, bands


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, m: int = COMPONENTS) -> DataFrame:
    """(doc_id, class_id): one row a row of docs; class_id is the smallest doc_id of the class."""
    spark = prepare(docs.sparkSession)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    copy_key = F.md5(F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.lit("")))
    signed = texts.select("doc_id", copy_key.alias("copy_key"), "text").mapInArrow(partial(_sign, size=size, bands=bands, rows=rows, m=max(m, bands * rows)), "doc_id long, copy_key string, bands array<long>, signature binary")
    signed = kept(signed, "signatures")
    one = kept(signed.groupBy("doc_id").agg(F.min("copy_key").alias("copy_key")), "ids")  # an id's text
    # equal texts go on as the smallest id
    copies = kept(_copies(one), "copies")
    firsts = copies.filter("doc_id = first_id").select("doc_id", "copy_key")
    single = signed.join(firsts, ["doc_id", "copy_key"], "left_semi").dropDuplicates(["doc_id", "copy_key"])
    again = signed.count() > one.count()
    if again:  # rows repeat an id
        texts = kept(texts.withColumn("copy_key", copy_key).join(one, ["doc_id", "copy_key"], "left_semi").dropDuplicates(["doc_id"]).drop("copy_key"), "texts")
    keys = single.select("doc_id", F.explode("bands").alias("key"))
    crowd = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = kept(keys.join(crowd, "key"), "bands")
    connected = shared.groupBy("doc_id").agg(F.sum("n").alias("reach"))
    leaders = shared.join(connected, "doc_id").groupBy("key").agg(F.min("doc_id").alias("l1"), F.max_by("doc_id", F.struct("reach", F.negative("doc_id"))).alias("l2"))
    led = shared.join(leaders, "key").select("doc_id", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("other")).filter("doc_id <> other")
    pairs = led.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    first_links = kept(_verified(pairs, texts, size, threshold), "links")
    # members of one bucket in different components
    found = kept(components(first_links), "components")
    placed = shared.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    by_part = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = by_part.groupBy("key").agg(F.max_by("part", F.struct("n", F.negative("part"))).alias("major"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    # members of a bucket's largest component are dealt to shares of it, the others go to all shares
    shares = F.ceil(F.col("n") / SHARE_ROWS).cast("int")
    minor = F.col("part") != F.col("major")
    salts = F.when(minor, F.sequence(F.lit(0), shares - 1)).otherwise(F.array(F.pmod(F.hash("doc_id"), shares)))
    dealt = placed.join(split, "key").select("key", F.explode(salts).alias("salt"), "doc_id", "part", minor.alias("minor"))
    rest = dealt.join(single.select("doc_id", "signature", "bands"), "doc_id").select("key", "salt", "doc_id", "part", "minor", "signature", "bands")
    m = max(m, bands * rows)
    least = threshold - MARGIN * (threshold * (1 - threshold) / m) ** 0.5
    across = rest.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(partial(_across, m=m, least=least), "a long, b long").distinct()
    new_pairs = kept(across.join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = first_links.unionByName(_verified(new_pairs, texts, size, threshold))
    final = components(links).withColumnsRenamed({"node": "first_id", "component": "class_id"})
    known = copies.join(final, "first_id", "left").select("doc_id", F.coalesce("class_id", "first_id").alias("class_id"))
    if again:
        known = signed.select("doc_id").join(known, "doc_id")  # a row for each row of docs
    return known.unionByName(docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id")))


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; columns as they were."""
    gone = classes(docs.select("doc_id", "text")).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
