"""Suffix-array dedup: bytes covered by a string of an earlier document go.

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller doc_id. The search is exact, in four steps:

1. Anchors. Every string of ``length`` bytes has an anchor: the smallest hash of
   its inner strings of ``inner`` bytes, leftmost on ties. Equal strings have
   equal anchors, so matches can be sought for each anchor on its own. Successive
   strings with one anchor form a stretch; about one byte in 15 has one.
   A task first merges its own equal stretches, so a group of copies sends one.
2. By anchor, equal stretches of different documents are settled at once: all but
   those of the smallest doc_id go. Stretches that share an anchor but differ are
   passed on, one for each different text.
3. Their bytes are read, strings without a partner in another document are left
   out, and those left are sorted by suffix_array.suffix_array; neighbours
   with ``length`` common bytes are the matches.
4. The spans of a document are united and cut from its bytes.

Null and empty texts have no bytes and lose none. A null doc_id is neither
smaller nor larger than another: such rows stay whole and remove nothing. Rows
that repeat a doc_id don't remove each other's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import kept, partitions, prepare, whole
from kinweave.llm.suffix_array import repeats_of
from kinweave.llm.textbatch import Texts, slices, string_buffers

LENGTH = 50
INNER = 20
#: Bytes of text whose stretches a task merges before it sends them on.
MERGE_BYTES = 8 << 20
#: Bytes of text handled at once: the arrays for them take some hundred times as much.
PART_BYTES = 1 << 18
#: Rows whose texts are cut together.
CUT_ROWS = 500
#: Differing stretches compared at once, if no group has more.
SORT_ROWS = 4000
#: Bytes of differing stretches sorted together.
SORT_BYTES = 1 << 18
_LOW = np.uint64((1 << 28) - 1)

_SENT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("spans", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("spans", pa.binary())])


def stretches(texts: Texts, length: int, inner: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, stretch hash) of every stretch."""
    n = len(texts.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n - inner + 1)
    hashes = texts.range_hash(at, at + inner)
    low = (hashes & ~_LOW) | at.astype(np.uint64)
    width, span = length - inner + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & _LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))[: len(anchor)]
    starts = np.flatnonzero(at[: len(anchor)] + length <= texts.offsets[owner + 1])
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor, owner = anchor[starts], owner[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    return owner[new], first, last, hashes[anchor[new]], texts.range_hash(first, last + length)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys change."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class _Spans:
    """Collects (doc, key, start, stop) arrays and writes a row for each document."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)

    def rows(self, bucket: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        doc, key, start, stop = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.lexsort((start, key, doc))
        doc, key, start, stop = doc[order], key[order], start[order], stop[order]
        # overlapping spans of a row become one
        new = _groups(doc, key)
        if len(doc):
            reach = _running_max(stop, new)
            new[1:] |= start[1:] > reach[:-1]
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
            doc, key, start, stop = doc[first], key[first], start[first], reach[last]
        first = np.flatnonzero(_groups(doc, key))
        packed = np.stack([start, stop], 1).astype("<i8").tobytes()
        offsets = pa.array(np.append(first, len(doc)) * 16, pa.int32() if len(packed) < 2**31 else pa.int64())
        blobs = pa.Array.from_buffers(pa.binary() if len(packed) < 2**31 else pa.large_binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(packed)])
        for at in range(0, len(first), 5000):
            part = slice(at, at + 5000)
            n = len(first[part])
            yield pa.record_batch([pa.array(np.full(n, bucket), schema.field(0).type), pa.array(doc[first[part]]), pa.array(key[first[part]]), blobs[part].cast(pa.binary())], schema=schema)


def _running_max(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running maximum that starts again where new is true (values are not negative)."""
    group = np.cumsum(new) - 1
    base = int(values.max()) + 1
    return np.maximum.accumulate(values + group * base) - group * base


def _send(batches: Iterator[pa.RecordBatch], length: int, inner: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for row, end, texts in slices(batch, "text", PART_BYTES):
            for part, base in _within(texts, length):
                owner, first, last, anchor, whole_hash = stretches(part, length, inner)
                row_of = row + owner  # 0 in a part of a long text
                shift = base - part.offsets[owner]
                held.append((ids[row_of], keys[row_of], first + shift, (last - first).astype(np.uint8), anchor, whole_hash))
            size += len(texts.data)
            if size >= MERGE_BYTES:
                yield from _merged(held, length, buckets)
                held, size = [], 0
    yield from _merged(held, length, buckets)


def _within(texts: Texts, length: int, most: int = PART_BYTES):
    """(texts, start in the document): one long text is cut into parts that overlap."""
    if len(texts.data) <= most or len(texts) > 1:
        yield texts, 0
        return
    for at in range(0, len(texts.data) - length + 1, most):
        part = texts.data[at : at + most + length - 1]
        yield Texts(part, np.array([0, len(part)], np.int64)), at


def _merged(held: list[tuple[np.ndarray, ...]], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    doc, key, start, more, anchor, text = (np.concatenate(x) for x in zip(*held))
    if not len(doc):
        return
    order = np.lexsort((doc, text, anchor))
    doc, key, start, more, anchor, text = (x[order] for x in (doc, key, start, more, anchor, text))
    first = np.flatnonzero(_groups(anchor, text))
    least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    gone = doc > least
    spans = _Spans()
    spans.add(doc[gone], key[gone], start[gone], start[gone] + more[gone] + length)
    for n, batch in enumerate(spans.rows(0, _SENT)):  # on their way they pass through any bucket
        yield batch.set_column(0, "bucket", pa.array(np.full(batch.num_rows, -1 - n), pa.int32()))
    left = ~gone
    doc, key, start, more, anchor, text = (x[left] for x in (doc, key, start, more, anchor, text))
    bucket = (anchor % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((start, key, doc, bucket))
    doc, key, start, more, anchor, text, bucket = (x[order] for x in (doc, key, start, more, anchor, text, bucket))
    short = (anchor // np.uint64(buckets)).astype(np.uint32)
    cuts = np.append(np.flatnonzero(_groups(bucket)), len(bucket))
    names, blobs = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first = np.flatnonzero(_groups(doc[a:b], key[a:b]))
        wide = start[a:b].max() >= 2**31
        head = np.array([b - a, len(first), wide], "<i8")
        blobs.append(b"".join(x.tobytes() for x in (head, doc[a:b][first].astype("<i8"), key[a:b][first].astype("<i8"), np.diff(np.append(first, b - a)).astype("<u4"), start[a:b].astype("<i8" if wide else "<u4"), more[a:b], short[a:b].astype("<u4"), text[a:b].astype("<u8"))))
        names.append(int(bucket[a]))
    none = pa.nulls(len(names), pa.int64())
    yield pa.record_batch([pa.array(names, pa.int32()), none, none, pa.array(blobs, pa.binary())], schema=_SENT)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n, docs, wide = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    at = 24
    out = []
    for kind, count in (("<i8", docs), ("<i8", docs), ("<u4", docs), ("<i8" if wide else "<u4", n), ("u1", n), ("<u4", n), ("<u8", n)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    doc, key, times, start, more, short, text = out
    return np.repeat(doc, times), np.repeat(key, times), start.astype(np.int64), more.astype(np.int64), short, text


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, ...]] | pa.RecordBatch]]:
    """Rows ordered by bucket: those below 0 as they come, the others a whole bucket at a time."""
    now, held = -1, []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        below = int(np.searchsorted(bucket, 0))
        if below:
            yield -1, batch.slice(0, below)
        for i in range(below, len(bucket)):
            if held and bucket[i] != now:
                yield now, held
                held = []
            now = int(bucket[i])
            held.append(_unpacked(batch.column(3)[i].as_py()))
    if held:
        yield now, held


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of equal stretches (bucket null), and one of each differing stretch of an anchor (bucket: its group)."""
    for bucket, held in _by_bucket(batches):
        if bucket < 0:
            yield pa.record_batch([pa.nulls(held.num_rows, pa.int64()), *held.columns[1:]], schema=_FOUND)
            continue
        doc, key, start, more, anchor, text = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, text, anchor))
        doc, key, start, more, anchor, text = (x[order] for x in (doc, key, start, more, anchor, text))
        by_anchor, by_text = _groups(anchor), _groups(anchor, text)
        first = np.flatnonzero(by_text)
        least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        gone = doc > least
        spans = _Spans()
        spans.add(doc[gone], key[gone], start[gone], start[gone] + more[gone] + length)
        for batch in spans.rows(0, _FOUND):
            yield batch.set_column(0, "bucket", pa.nulls(batch.num_rows, pa.int64()))
        group = np.cumsum(by_anchor) - 1
        kinds = np.bincount(group[first])
        lowest = np.full(len(kinds), np.iinfo(np.int64).max)
        highest = np.full(len(kinds), np.iinfo(np.int64).min)
        np.minimum.at(lowest, group[first], doc[first])
        np.maximum.at(highest, group[first], doc[first])
        open_ = ~gone & ((kinds > 1) & (lowest < highest))[group]
        g = np.uint64(bucket) << np.uint64(32) | anchor[open_].astype(np.uint64)
        yield from _asked(g.astype(np.int64), doc[open_], key[open_], start[open_], more[open_], length)


def _asked(group, doc, key, start, more, length) -> Iterator[pa.RecordBatch]:
    """A row for each document: packed (group, start, stop) of the stretches to read."""
    order = np.lexsort((start, key, doc))
    group, doc, key, start, more = (x[order] for x in (group, doc, key, start, more))
    first = np.flatnonzero(_groups(doc, key))
    ends = np.append(first[1:], len(doc))
    packed = np.stack([group, start, start + more + length], 1).astype("<i8")
    for at in range(0, len(first), 5000):
        a, b = first[at : at + 5000], ends[at : at + 5000]
        yield pa.record_batch([pa.array(np.ones(len(a), np.int64)), pa.array(doc[a]), pa.array(key[a]), pa.array([packed[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary())], schema=_FOUND)


_READ = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked for."""
    for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
        data, at = string_buffers(batch.column(2))
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for i, blobs in enumerate(batch.column(3).to_pylist()):
            text = data[at[i] : at[i + 1]].tobytes()
            for group, start, stop in np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 3).tolist():
                for column, value in zip(out, (group, ids[i], keys[i], start, text[start:stop])):
                    column.append(value)
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _READ)], schema=_READ)


def _sorted_matches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 3: spans of the differing stretches that an earlier document shares. Rows come ordered by group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SORT_ROWS:
            continue
        table = pa.Table.from_batches(held, _READ)
        group = table.column(0).to_numpy()
        last = np.flatnonzero(group[1:] != group[:-1])
        end = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
        if end:
            yield from _matched(table.slice(0, end), length)
        held, rows = table.slice(end).to_batches(), table.num_rows - end
    if rows:
        yield from _matched(pa.Table.from_batches(held, _READ), length)


def _matched(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    group, doc, key, base = (table.column(k).to_numpy() for k in range(4))
    data, at = string_buffers(table.column(4))
    texts = Texts(data[at[0] : at[-1]], at - at[0])
    size = np.diff(texts.offsets)
    windows = size - length + 1
    piece = np.repeat(np.arange(len(size)), windows)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = texts.offsets[piece] + inner
    code = _window_codes(texts, start, length) ^ group[piece].astype(np.uint64)
    order = np.lexsort((doc[piece], code))
    new = _groups(code[order])
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    shared = np.zeros(len(piece), bool)
    shared[order] = (doc[piece[order[first]]] < doc[piece[order[last]]])[number]
    # maximal runs of shared strings in a piece; equal runs of a group enter the array once
    at_run = np.flatnonzero(shared & np.concatenate([[True], ~(shared[:-1] & (piece[1:] == piece[:-1]))]))
    end_run = np.flatnonzero(shared & np.concatenate([~(shared[1:] & (piece[1:] == piece[:-1])), [True]]))
    spans = _Spans()
    runs: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    raw = texts.data.tobytes()
    for a, b in zip(at_run.tolist(), end_run.tolist()):
        p = int(piece[a])
        string = raw[start[a] : start[b] + length]
        runs.setdefault(int(group[p]), {}).setdefault(string, []).append((int(doc[p]), int(key[p]), int(base[p]) + int(inner[a])))
    out: list[tuple[int, int, int, int]] = []
    pieces: list[bytes] = []
    owners: list[list[tuple[int, int, int]]] = []
    held = 0
    for texts_of in runs.values():
        for string, places in texts_of.items():
            least = min(places)[0]
            out += [(d, k, s, s + len(string)) for d, k, s in places if d > least]
            if len(texts_of) > 1:
                pieces.append(string)
                owners.append([x for x in places if x[0] == least])
                held += len(string)
        if held >= SORT_BYTES:
            out += _matches(pieces, owners, length)
            pieces, owners, held = [], [], 0
    out += _matches(pieces, owners, length)
    if out:
        spans.add(*(np.array(x, np.int64) for x in zip(*out)))
    for batch in spans.rows(0, _FOUND):
        yield batch.set_column(0, "bucket", pa.nulls(batch.num_rows, pa.int64()))


def _window_codes(texts: Texts, start: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 1 << 20):
        out[a : a + (1 << 20)] = texts.range_hash(start[a : a + (1 << 20)], start[a : a + (1 << 20)] + length)
    return out


def _matches(pieces: list[bytes], owners: list[list[tuple[int, int, int]]], length: int) -> list[tuple[int, int, int, int]]:
    if len(pieces) < 2:
        return []
    out = []
    for places in repeats_of(pieces, length):
        least = min(owners[p][0][0] for p, _ in places)
        out += [(d, k, s + i, s + i + length) for p, i in places for d, k, s in owners[p] if d > least]
    return out


_CUT = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_text", "binary")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
        names = batch.schema.names
        data, at = string_buffers(batch.column(names.index("text")))
        rows = []
        for i, blobs in enumerate(batch.column(names.index("spans")).to_pylist()):
            text = data[at[i] : at[i + 1]]
            if not blobs:
                rows.append((len(text), 0, 0, text.tobytes()))
                continue
            pairs = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
            rows.append((len(text), int(gone.sum()), n_spans, text[~gone].tobytes()))
        columns = list(zip(*rows)) or [[]] * 4
        added = [pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        rest = [k for k, n in enumerate(names) if n not in ("text", "spans")]
        yield pa.record_batch([*(batch.column(k) for k in rest), *added], names=[*(names[k] for k in rest), *(n for n, _ in _CUT)])


def spans_of(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """(doc_id, row_key, spans): packed spans to remove, by document; written to the shared folder."""
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    texts = _keyed(docs).filter("doc_id is not null and length(text) > 0")
    sent = texts.mapInArrow(partial(_send, length=length, inner=inner, buckets=8 * n), "bucket int, doc_id long, row_key long, spans binary")
    mixed = F.when(F.col("bucket") < 0, F.hash("doc_id")).otherwise(F.col("bucket"))
    found = kept(sent.repartition(n, mixed).sortWithinPartitions("bucket").mapInArrow(partial(_settle, length=length), "bucket long, doc_id long, row_key long, spans binary"), "stretches")
    asked = found.filter("bucket is not null").groupBy("doc_id", "row_key").agg(F.collect_list("spans").alias("spans"))
    pieces = texts.join(asked, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "spans").mapInArrow(_read, "bucket long, doc_id long, row_key long, start long, piece binary")
    more = pieces.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_sorted_matches, length=length), "bucket long, doc_id long, row_key long, spans binary")
    return kept(found.filter("bucket is null").unionByName(more).select("doc_id", "row_key", "spans"), "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(whole(), "doc_id").alias("row_key"), whole().alias("text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_text (binary) in place of text.

    docs needs doc_id (long) and text; other columns stay. See the module for the rule.
    """
    if length <= inner or inner < 1 or length - inner > 250:
        raise ValueError("inner must be below length, by 250 at most")
    spark = prepare(docs.sparkSession)
    spans = spans_of(docs, length, inner).groupBy("doc_id", "row_key").agg(F.collect_list("spans").alias("_spans"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    hidden = {c: f"_c{i}" for i, c in enumerate(rest)}  # their names may clash with ours
    rows = docs.select("doc_id", F.xxhash64(whole(), "doc_id").alias("_key"), whole().alias("text"), *(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    joined = rows.join(spans.withColumnsRenamed({"row_key": "_key"}), ["doc_id", "_key"], "left")
    joined = joined.select("doc_id", "text", F.col("_spans").alias("spans"), *hidden.values())
    kinds = dict(joined.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{h} {kinds[h]}" for h in hidden.values()), *(f"{n} {t}" for n, t in _CUT)])
    out = joined.mapInArrow(_cut, schema)
    own = [n for n, _ in _CUT]
    return out.select("doc_id", *(F.col(h).alias(c) for c, h in hidden.items() if c not in own), *own)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
