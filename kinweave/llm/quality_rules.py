"""Quality rules on repetition inside a document, found with suffix arrays of words.

The suffixes of each text's words are sorted by doubling: suffixes that differ
leave, the others are sorted by the rank of what follows, so most words take one
or two rounds. The longest common prefix of neighbours in this order gives
for each word the longest repeat that starts there (the larger of its two neighbours: the value of the
innermost LCP interval it lies in); these are the maximal repeated substrings. Their spans of at least
``least`` words are united. A text is rejected when they cover more than
``cover`` percent of its words, or when one repeat has more than ``longest`` words.

Null and empty texts have no words and fail the base rule (under 50 words). A long text is a slice of
its own, with some ten arrays of a number a word. Rows that repeat an id, or a text, are judged each by
itself; an empty table gives no row. Columns that are passed on keep their names and places, but those named
like a measure give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import prepare
from kinweave.llm.textbatch import Texts, Words, slices

LEAST_WORDS = 50
REPEATED_PERCENT = 50
LEAST = 10
COVER_PERCENT = 30
LONGEST = 200
SYMBOLS = b"#*$%&|<>"

_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered_words long, longest_repeat long, kept boolean"


def longest_repeats(hashes: np.ndarray, words: Words, least: int) -> np.ndarray:
    """For each word the length of the longest repeat that starts there, 0 if below ``least`` words."""
    n = len(hashes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    owner = words.owner()
    bits = np.uint64(max(1, int(owner[-1]).bit_length()))
    keys = owner.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    end = words.first[owner + 1]
    suffixes = order.copy()
    place = np.arange(n)  # places in the array of the suffixes still tied
    size = 1
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = order
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        tied, place = tied[~alone], place[~alone]
        if not len(tied):
            break
        after = np.where(tied + size < end[tied], rank[np.minimum(tied + size, n - 1)] + 1, 0)
        resort = np.lexsort((after, rank[tied]))
        tied, after = tied[resort], after[resort]
        group = rank[tied]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        suffixes[place] = tied
        rank[tied] = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
        size *= 2
    a, b = suffixes[:-1], suffixes[1:]
    # common prefixes of neighbours, by the hashes of word ranges: the sums take two arrays, however often the text repeats
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers_of(_STEP, n), dtype=np.uint64)])
    back = _powers_of(_STEP_BACK, n)

    def alike(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        whole = (x + size <= end[a]) & (y + size <= end[b])
        x, y = np.where(whole, x, 0), np.where(whole, y, 0)
        return whole & ((sums[np.minimum(x + size, n)] - sums[x]) * back[x] == (sums[np.minimum(y + size, n)] - sums[y]) * back[y])

    least = max(least, 1)
    near = alike(a, b, least)
    a, b = a[near], b[near]
    common = np.full(len(a), least, np.int64)
    for k in range(int(words.per_text.max()).bit_length() - 1, -1, -1):
        common[alike(a + common, b + common, 1 << k)] += 1 << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    out[out < least] = 0
    return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def covered(lengths: np.ndarray) -> np.ndarray:
    """True for words inside [i, i + lengths[i]) of some i."""
    at = np.arange(len(lengths))
    return np.maximum.accumulate(np.where(lengths > 0, at + lengths, 0)) > at if len(lengths) else np.zeros(0, bool)


def _sums(flags: np.ndarray, words: Words) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return at[words.first[1:]] - at[words.first[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for keys that an earlier or later item of the same owner has too."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def duplicate_lines(texts: Texts) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    n = len(texts.data)
    if not n:
        return np.zeros(len(texts), np.int64)
    lines = texts.runs(texts.data != 0x0A)
    has_word = np.concatenate([[0], np.cumsum(~np.isin(texts.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)))])
    own = lines.owner()
    full = has_word[lines.ends] > has_word[lines.starts]
    hashes = texts.range_hash(lines.starts, lines.ends)
    order = np.lexsort((lines.starts, hashes, own))
    again = np.zeros(len(own), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    return _sums(again & full, lines)


def measures(texts: Texts, least: int = LEAST) -> dict[str, np.ndarray]:
    words = texts.words()
    hashes = texts.range_hash(words.starts, words.ends) if len(words.starts) else np.zeros(0, np.uint64)
    n_words = words.per_text
    chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80, dtype=np.int64)])
    word_chars = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])
    owner = words.owner()
    wins = max(0, len(hashes) - 2)
    repeat = np.zeros(len(hashes), bool)
    if wins:
        whole = owner[:wins] == owner[2:]
        triple = (hashes[:wins] * np.uint64(0x9FB21C651E98DF25) + hashes[1 : wins + 1]) * np.uint64(0xD6E8FEB86659FD93) + hashes[2:]
        at = np.flatnonzero(whole)
        at = at[_repeated(triple[at], owner[at])]
        for j in range(3):
            repeat[at + j] = True
    lengths = longest_repeats(hashes, words, least)
    longest = np.zeros(len(n_words), np.int64)
    np.maximum.at(longest, owner, lengths)
    return {
        "n_words": n_words, "word_chars": word_chars[words.first[1:]] - word_chars[words.first[:-1]], "n_symbols": texts.counts(_IS_SYMBOL[texts.data]), "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": _sums(repeat, words), "n_covered_words": _sums(covered(lengths), words), "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray], cover: int = COVER_PERCENT, longest: int = LONGEST) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"])
    return m | {"base_failed": failed, "kept": ~failed & (100 * m["n_covered_words"] <= cover * m["n_words"]) & (m["longest_repeat"] <= longest)}


def _judge(batches: Iterator[pa.RecordBatch], least: int, cover: int, longest: int, rest: list[str]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for batch in batches:
        for row, end, texts in slices(batch, "text"):
            found = verdicts(measures(texts, least), cover, longest)
            part = batch.slice(row, end - row)
            columns = [part.column(part.schema.get_field_index(c)) for c in rest] + [pa.array(found[n], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names]
            yield pa.record_batch(columns, names=[*rest, *names])


def judge(docs: DataFrame, least: int = LEAST, cover: int = COVER_PERCENT, longest: int = LONGEST, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns in keep, which are passed on) with the measures and the verdict."""
    prepare(docs.sparkSession)
    rest = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    hidden = {c: "text" if c == "text" else f"_c{i}" for i, c in enumerate(rest)}
    rows = docs.selectExpr(*(f"`{c}` as {h}" for c, h in hidden.items()), *([] if "text" in rest else ["text"]))
    schema = ", ".join([*(f"{h} {kinds[c]}" for c, h in hidden.items()), _COLUMNS])
    out = rows.mapInArrow(partial(_judge, least=least, cover=cover, longest=longest, rest=list(hidden.values())), schema)
    own = [c.split()[0] for c in _COLUMNS.split(", ")]
    return out.selectExpr(*(f"{h} as `{c}`" for c, h in hidden.items() if c not in own), *own)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass all rules, with their columns."""
    marked = docs.select(*(docs[f"`{c}`"].alias(f"x{i}" if c != "text" else "text") for i, c in enumerate(docs.columns)))
    out = judge(marked, keep=marked.columns).filter("kept")
    return out.selectExpr(*(f"{m} as `{c}`" for m, c in zip(marked.columns, docs.columns)))


ORACLE_SQL = rf"""
with w as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
m as (
  select doc_id, text, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
grams as (
  select doc_id, k, pos, count(*) over (partition by doc_id, k, gram) as times
  from (select doc_id, k, pos, hash(words[pos:pos + k - 1]) as gram from (select doc_id, k, unnest(range(1, n_words - k + 2)) as pos, words from m, (values (3), ({LEAST})) t(k) where n_words >= k))),
hit as (select distinct doc_id, k, pos + j as word from (select doc_id, k, pos, unnest(range(0, k)) as j from grams where times > 1)),
c as (select doc_id, count(*) filter (where k = 3) as n_repeat_words, count(*) filter (where k = {LEAST}) as n_covered_words from hit group by doc_id),
longer as (
  select doc_id, count(*) as over from (
    select doc_id, count(*) over (partition by doc_id, gram) as times
    from (select doc_id, hash(words[pos:pos + {LONGEST}]) as gram from (select doc_id, unnest(range(1, n_words - {LONGEST} + 1)) as pos, words from m join c using (doc_id) where n_covered_words > {LONGEST})))
  where times > 1 group by doc_id),
j as (
  select m.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_covered_words, 0) as n_covered_words, coalesce(over, 0) as over from m left join c using (doc_id) left join longer using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words as base_failed,
  cast(n_covered_words as bigint) as n_covered_words,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) and 100 * n_covered_words <= {COVER_PERCENT} * n_words and over = 0 as kept
from j
"""
