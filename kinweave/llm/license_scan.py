"""License scans: exact names, and short notices with bounded errors.

Text is lower-cased (A-Z) and reduced to its words, runs of [0-9a-z] and of
characters beyond ASCII, joined by single spaces. Four phrases are counted where they
stand word for word. Longer notices are sought with errors: a notice with at most
k inserted, deleted or changed characters holds one of its k + 1 parts unchanged, so
exact parts, found together by one automaton, give the only places where the regex
library then matches with bounded errors and reports span and edits. What is found counts
if it still matches when drawn out to whole words and has the notice's own words (those that
tell it from others) unchanged. Of notices that overlap, the one with the fewest
edits stays, on ties the longest, then the first in the list.

Null and empty texts have no word, no place and no label, and score 0. Long texts are
scanned whole, in time that grows with their length; an empty table gives no row. Rows that repeat an
id, or a text, each have their own row. Columns other than doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinweave.llm.common import prepare
from kinweave.llm.textbatch import string_buffers

#: Phrases that are counted, and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening words of public licence notices, their labels, and the words that must stand unchanged (fixed values).
NOTICES = {
    "licensed under the apache license version 2 0": ("apache", "apache"),
    "this work is licensed under the gnu general public license version": ("gpl", "gnu"),
    "this program is free software you can redistribute it and or modify it": ("gpl", "free"),
    "gnu lesser general public license": ("lgpl", "lesser"),
    "gnu affero general public license": ("agpl", "affero"),
    "released under the mit license": ("mit", "mit"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", "free"),
    "redistribution and use in source and binary forms with or without modification": ("bsd", "binary"),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "creative commons attribution": ("cc-by", "attribution"),
    "creative commons attribution sharealike": ("cc-by-sa", "sharealike"),
    "creative commons attribution noncommercial": ("cc-by-nc", "noncommercial"),
    "creative commons attribution noderivatives": ("cc-by-nd", "noderivatives"),
    "licensed under cc by": ("cc-by", "cc by"),
    "licensed under cc by sa 4 0": ("cc-by-sa", "by sa"),
    "licensed under cc by nc 4 0": ("cc-by-nc", "by nc"),
    "licensed under cc by nd 4 0": ("cc-by-nd", "by nd"),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", "purpose"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered"),
    "all rights reserved": ("proprietary", "rights"),
}
#: One error for so many characters of a notice.
CHARS_PER_ERROR = 12

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal(text: bytes) -> tuple[str, int]:
    """Words of a text with a space before, between and after, and their number."""
    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return " " + b" ".join(words).decode("utf-8", "replace") + " " if words else " ", len(words)


class Scanner:
    def __init__(self, notices: dict[str, tuple[str, str]] = NOTICES, chars_per_error: int = CHARS_PER_ERROR):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, (label, own)) in enumerate(notices.items()):
            errors = len(notice) // chars_per_error
            size, extra, at = *divmod(len(notice), errors + 1), 0
            for k in range(errors + 1):
                end = at + size + (k < extra)
                seeds.setdefault(notice[at:end], []).append((n, at))
                at = end
            pattern = regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}", regex.BESTMATCH)
            self.notices.append((notice, label, f" {own} ", errors, pattern))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) of the notices' places, in order; from and to a word's edge, in text's characters."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                notice, _, _, errors, _ = self.notices[n]
                start = last + 1 - size - at
                low, high = max(0, start - errors), start + len(notice) + errors
                spans = windows.setdefault(n, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], low), max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        found = []
        for n, spans in windows.items():
            notice, label, own, _, pattern = self.notices[n]
            for low, high in spans:
                for m in pattern.finditer(text, low, min(high, len(text))):
                    a, b = self._whole_words(text, m.start(), m.end())
                    again = pattern.fullmatch(text, a, b) if b > a else None
                    if again and own in f" {text[a:b]} ":
                        found.append((sum(again.fuzzy_counts), -len(notice), n, a, b, label))
        kept: list[tuple[int, int, int, str, int]] = []
        for edits, size, _, a, b, label in sorted(found):
            at = bisect_left(kept, (a,))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, edits, label, -size))
        return [(label, a, b, edits, size) for a, b, edits, label, size in kept]

    @staticmethod
    def _whole_words(text: str, a: int, b: int) -> tuple[int, int]:
        """The span without spaces at its ends, drawn out to whole words; text begins and ends with a space."""
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        return text.rfind(" ", 0, a) + 1, text.find(" ", b) if b < len(text) else len(text)

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, int]]]:
        text, n_words = normal(raw)
        starts, base = [], set()
        for phrase, label in PHRASES.items():
            at = text.find(f" {phrase} ")
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = text.find(f" {phrase} ", at + 1)
        found = self.fuzzy(text)
        labels = base | {f[0] for f in found}
        best = max([1.0] * bool(base) + [1 - edits / size for _, _, _, edits, size in found], default=0.0)
        if starts or found:
            spaces = [i for i, c in enumerate(text) if c == " "]  # word k starts after space k
        word = lambda at: bisect_left(spaces, at)
        spans = [(label, word(a) - 1, word(b), edits) for label, a, b, edits, _ in found]
        return n_words, len(starts), word(min(starts)) if starts else None, word(max(starts)) if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), best, spans


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, tuple[str, str]], ...], chars_per_error: int) -> Scanner:
    return Scanner(dict(notices), chars_per_error)


_COLUMNS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], notices: tuple[tuple[str, tuple[str, str]], ...], chars_per_error: int) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(notices, chars_per_error)
    for batch in batches:
        data, at = string_buffers(batch.column(1))
        at = at.tolist()
        view = memoryview(np.ascontiguousarray(data))
        rows = [scanner.scan(bytes(view[a:b])) for a, b in zip(at[:-1], at[1:])]
        columns = list(zip(*rows)) or [()] * 8
        spans = pa.array([[dict(zip(("label", "first_word", "end_word", "edits"), s)) for s in x] for x in columns[7]], _SPANS)
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS)), spans], names=["doc_id", *(n for n, _ in _COLUMNS), "spans"])


def scan(docs: DataFrame, notices: dict[str, tuple[str, str]] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """doc_id with counts, labels, score, and spans (words from 0, end exclusive, edits) of the notices found."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:long>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, notices=tuple(notices.items()), chars_per_error=chars_per_error), schema)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
