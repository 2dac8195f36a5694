"""Quality classifier: histogram gradient-boosted trees on statistics of a document.

Statistics are cut into at most BINS bins by quantiles of the sample; every tree is
grown level by level from histograms of gradients and has a complete layout of
DEPTH levels, so the forest is three flat arrays, and scoring is DEPTH vectorised
steps for all texts and trees at once. Fitted on at most labelled.MOST_ROWS rows;
every text is scored whole.

Null and empty texts have statistics 0 and are scored like any other. With no
labelled row every score is 0.5. Long texts are measured whole, in one slice of their own; equal
texts have equal scores; a label given twice counts with its smaller value. Null ids are scored and
never learnt from. An empty table gives no row. Columns other than doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import prepare, whole
from kinweave.llm.labelled import MOST_ROWS, held_out, sample
from kinweave.llm.quality_rules import _repeated, _sums, duplicate_lines
from kinweave.llm.textbatch import Texts, slices

BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
LEAST_IN_LEAF, L2 = 10, 1.0
CUT = 0.3

_KINDS = np.zeros(256, np.int8)
_KINDS[0x41:0x5B] = 1
_KINDS[0x30:0x3A] = 2
_KINDS[[*b".,;:!?'\"()-"]] = 3
_KINDS[[*b"#*$%&|<>@^~=+_{}[]\\/`"]] = 4
_KINDS[0x80:] = 5
_KINDS[0x0A] = 6
N_STATISTICS = 22


def statistics(texts: Texts) -> np.ndarray:
    """(texts, N_STATISTICS)"""
    n, data = len(texts), texts.data
    words = texts.words()
    size = (words.ends - words.starts).astype(np.float64)
    n_words = words.per_text
    per = np.maximum(n_words, 1)
    n_bytes = np.maximum(np.diff(texts.offsets), 1)
    kinds = _KINDS[data]
    share = [texts.counts(kinds == k) / n_bytes for k in range(1, 6)]
    owner = words.owner()
    total = np.bincount(owner, size, n)
    mean = total / per
    spread = np.sqrt(np.maximum(np.bincount(owner, size * size, n) / per - mean * mean, 0))
    h = texts.range_hash(words.starts, words.ends) if len(size) else np.zeros(0, np.uint64)
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    new = np.concatenate([[True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])]) if len(ho) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(ho)))
    distinct = np.bincount(oo[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, oo[first], times)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    triple = np.zeros(len(h), bool)
    if len(h) > 2:
        at = np.flatnonzero(owner[:-2] == owner[2:])
        key = (h[at] * np.uint64(0x9FB21C651E98DF25) + h[at + 1]) * np.uint64(0xD6E8FEB86659FD93) + h[at + 2]
        triple[at[_repeated(key, owner[at])]] = True
    last, lead = (data[words.ends - 1], data[words.starts]) if len(size) else (data[:0], data[:0])
    lines = texts.counts(data == 0x0A) + 1
    full_stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    no_letter = _sums(_symbol_words(texts, words), words)
    columns = [
        np.log1p(n_words), mean, spread, *share, n_words / lines, np.log1p(lines), duplicate_lines(texts) / lines, distinct / per, top / per, _sums(again, words) / per, _sums(triple, words) / per,
        _sums(full_stop, words) / per, _sums(_KINDS[last] == 4, words) / per, _sums(_KINDS[lead] == 1, words) / per, no_letter / per, _sums(last == 0x21, words) / per, _sums(size > 20, words) / per, _sums(size < 3, words) / per,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1) if n else np.zeros((0, N_STATISTICS))


def _symbol_words(texts: Texts, words) -> np.ndarray:
    """Words without a letter or digit."""
    letter = (texts.data >= 0x80) | np.isin(_KINDS[texts.data], (1, 2)) | ((texts.data >= 0x61) & (texts.data <= 0x7A))
    at = np.concatenate([[0], np.cumsum(letter)])
    return at[words.ends] == at[words.starts]


class Forest:
    """feature, limit: (trees, 2**DEPTH - 1), go right if the value is above the limit; value: (trees, 2**DEPTH)."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[row, self.feature[trees, node]] > self.limit[trees, node])
            out[a : a + 4096] = self.base + self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # bin b: at most edges[b]
    n, k = x.shape
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    raw = np.full(n, base)
    inner = 2**DEPTH - 1
    features, limits, values = (np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            start, width = 2**level - 1, 2**level
            at = node - start
            gain, split, feature = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
            for f in range(k):
                key = at * BINS + bins[:, f]
                sums = [np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), 1) for v in (g, h, None)]
                gl, hl, nl = sums
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                better = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                better[(nl < LEAST_IN_LEAF) | (nt - nl < LEAST_IN_LEAF)] = 0
                better[:, len(edges[f]) :] = 0
                b = better.argmax(1)
                now = better[np.arange(width), b]
                win = now > gain + 1e-9
                gain[win], split[win], feature[win] = now[win], b[win], f
            has = split >= 0
            features[t, start : start + width] = feature
            limits[t, start : start + width][has] = [edges[f][b] for f, b in zip(feature[has], split[has])]
            right = has[at] & (bins[np.arange(n), feature[at]] > split[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        values[t] = value
        raw += value[leaf]
    return Forest(base, features, limits, values)


_STAT_FIELDS = ", ".join(f"s{i} double" for i in range(N_STATISTICS))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            part = batch.slice(row, end - row)
            yield pa.record_batch([part.column(0), part.column(2), *(pa.array(c) for c in statistics(texts).T)], names=["doc_id", "label", *(f"s{i}" for i in range(N_STATISTICS))])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Forest | None:
    prepare(docs.sparkSession)
    rows = sample(docs, labels, "quality", most).mapInArrow(_measured, f"doc_id long, label int, {_STAT_FIELDS}").collect()  # ``most`` rows
    if not rows:
        return None
    rows.sort()
    return fit(np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float))


def _score(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            part = batch.slice(row, end - row)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(forest.score(statistics(texts)))], names=["doc_id", "held_out", "score"])


def digest(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    rows = docs.select("doc_id", held_out().alias("held_out"), whole().alias("text"))
    forest = train(docs, labels, most)
    if forest is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        kind = dict(docs.dtypes)["doc_id"]
        scored = rows.mapInArrow(partial(_score, forest=forest), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
