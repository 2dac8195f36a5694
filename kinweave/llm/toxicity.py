"""Toxicity: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII.
A text's features are its distinct words, pairs of neighbours and pairs with one
word between, hashed to BITS bits. Every coordinate has its own learning rate, and
the L1 term keeps a weight at exactly 0 until its gradients add up, so the
few weights that are left travel with the tasks. Fitted on at most
labelled.MOST_ROWS rows with labelled.MOST_BYTES of features; every text is scored whole.

ALPHA and L1 were chosen by the F1 of three folds inside the training rows of a small corpus. The
same folds place the cut: the log-odds with the best F1 over the scores of rows that a fold's model
has not seen become a score of 0.5. Held-out rows have no part in either.

Null and empty texts have no feature: their score is that of the intercept. With no
labelled row every score is 0. Long texts are scored whole, in one slice of their own; a text's
score doesn't change with what it's scored beside, so equal texts have equal scores. Null ids are
scored and never learnt from. An empty table gives no row. Columns other than doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import kept, prepare, whole
from kinweave.llm.labelled import MOST_BYTES, MOST_ROWS, held_out, sample
from kinweave.llm.textbatch import Texts, mix, slices

BITS = 20
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.05
EPOCHS = 12
CUT = 0.5
#: Files that take the sample's features. Without Hadoop's native library an executor starts three processes
#: for each file it writes, and such a child has the whole memory of its JVM for a moment.
FILES = 8
#: Folds inside the training rows, and the farthest that the cut may move, in log-odds.
INNER_FOLDS, MOST_SHIFT = 3, 3.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all places of features; not distinct."""
    words = texts.runs(_IN_WORD[texts.data])
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Texts(_LOWER[texts.data], texts.offsets).range_hash(words.starts, words.ends)
    owner = words.owner()
    found, owners = [h], [owner]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        same = owner[gap:] == owner[:-gap]
        found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        owners.append(owner[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and values of the weights that aren't 0, and the intercept."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = [(np.append(x, 1 << bits), y) for x, y in rows]  # the last coordinate is the intercept

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, y = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    at = np.flatnonzero(w[:-1])
    return at, w[at].astype(np.float32), float(w[-1])


def calibrated(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """fit(), with the intercept moved so that the cut with the best F1 over inner folds scores 0.5."""
    at, values, intercept = fit(rows, bits)
    y = np.array([r[1] for r in rows])
    if min(y.sum(), len(y) - y.sum()) < INNER_FOLDS:
        return at, values, intercept
    odds = np.zeros(len(rows))
    fold = np.zeros(len(rows), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % INNER_FOLDS
    for k in range(INNER_FOLDS):
        i, w, c = fit([r for r, f in zip(rows, fold) if f != k], bits)
        table = np.zeros(1 << bits)
        table[i] = w
        odds[fold == k] = [c + table[rows[j][0]].sum() for j in np.flatnonzero(fold == k)]
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][odds[order][1:] == odds[order][:-1]] = 0  # a cut can't part equal scores
    best = int(f1.argmax())
    cut = odds[order][best : best + 2].mean()
    return at, values, intercept - float(np.clip(cut, -MOST_SHIFT, MOST_SHIFT))


def _sampled(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            x, owner = features(texts, bits)
            pairs = np.unique(owner << bits | x)
            cut = np.searchsorted(pairs, np.arange(end - row + 1) << bits)
            low = (pairs & ((1 << bits) - 1)).astype("<i4")
            part = batch.slice(row, end - row)
            yield pa.record_batch([part.column(0), part.column(2), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float] | None:
    prepare(docs.sparkSession)
    found = sample(docs, labels, "toxic", most).mapInArrow(partial(_sampled, bits=bits), "doc_id long, label int, x binary")
    rows, size = [], 0
    for r in kept(found.repartition(FILES), "features").orderBy(F.md5(F.col("doc_id").cast("string"))).toLocalIterator():  # ``most`` rows, MOST_BYTES
        size += len(r.x)
        if size > MOST_BYTES:
            break
        rows.append((np.frombuffer(r.x, "<i4").astype(np.int64), r.label))
    return calibrated(rows, bits) if rows else None


@lru_cache(maxsize=2)
def _table(at: bytes, values: bytes, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.float32)
    out[np.frombuffer(at, np.int64)] = np.frombuffer(values, np.float32)
    return out


def _score(batches: Iterator[pa.RecordBatch], at: bytes, values: bytes, intercept: float, bits: int) -> Iterator[pa.RecordBatch]:
    table = _table(at, values, bits)
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            x, owner = features(texts, bits)
            w = table[x]
            has = np.flatnonzero(w)
            pairs = np.unique(owner[has] << bits | x[has])
            total = intercept + np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], end - row)
            part = batch.slice(row, end - row)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "held_out", "score"])


def digest(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    rows = docs.select("doc_id", held_out().alias("held_out"), whole().alias("text"))
    model = train(docs, labels, most)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        kind = dict(docs.dtypes)["doc_id"]
        at, values, intercept = model
        scored = rows.mapInArrow(partial(_score, at=at.tobytes(), values=values.tobytes(), intercept=intercept, bits=BITS), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
