"""Byte-level BPE as a lazily determinised finite-state transducer.

The encoding of a text's prefix has one last token, and cutting that token off
gives the encoding of the shorter prefix. So reading a byte means finding the last
token: the one suffix that is a token, stands for itself, and may follow the last
token of what is before it (two tokens may follow one another if merging their
bytes gives them back). Which tokens stay is known once all places where a token
could still grow trace back to one place; the tokens up to it are emitted. What
matters for what follows, the last emitted token and the bytes since, is the
state. States and their transitions are made when first met and kept in a bounded
table, as is a bounded cache of whole pieces. A transition that emits nothing leads to
the state whose key is one byte longer, so only those that emit are kept by themselves.

Decoding feeds token bytes to an incremental UTF-8 state machine: complete
characters leave at once, incomplete ones wait, ill-formed bytes become U+FFFD.

Null and empty texts give no token and decode to the empty text. A long text is cut into pieces by
the pattern like any other; a piece of any length is read byte by byte, with no table that grows with
it. Between two possible merges the lower rank goes first, then the one further left, so there are
no ties to settle. Rows that repeat an id, or a text, are encoded each by itself; an empty table
gives no row. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame


from kinweave.llm.common import prepare, whole
from kinweave.llm.textbatch import at_change, let_go

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MOST_STATES = 700_000
MOST_PIECES = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the neighbours with the lowest rank, leftmost first, while any are a token."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks) if any(a + b in ranks for a, b in zip(parts, parts[1:])) else None
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


_NEVER = 1 << 60
_SHIFT = 24
_MASK = (1 << _SHIFT) - 1
_NONE = b"\xff\xff\xff"
_START = _NONE
_MOST_PAIRS = 1_000_000
_MET = 1 << 21  # bytes of a table that says which hashes of pieces were met
#: A state's key: three bytes of the last emitted token, then the bytes since. Its places: where a token that
#: reaches further may begin, each followed by the tokens of the bytes before it; the last place is the end.
_BYTES = [bytes([b]) for b in range(256)]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.size = {t: len(b) for t, b in self.bytes_of.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.most_states, self.most_pieces = most_states, most_pieces
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.own: dict[int, bool] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.met, self.n_met = bytearray(_MET), 0  # hashes of pieces met once
        self.single: dict[int, tuple[int, ...]] = {}
        self._restart()

    def _restart(self, key: bytes = _START, places: tuple = (0, ())) -> int:
        """Empty tables but for the start state, and the state given if another; its number."""
        self.number: dict[bytes, int] = {_START: 0}
        self.keys, self.places, self.steps, self.outs, self.out_number = [_START], [(0, ())], {}, [()], {(): 0}
        self.shared: dict[tuple, tuple] = {}  # places that states with other last tokens have, too
        return 0 if key == _START else self._state(key, places)

    def _state(self, key: bytes, places: tuple) -> int:
        self.number[key] = n = len(self.keys)
        self.keys.append(key)
        self.places.append(self.shared.setdefault(places, places))
        return n

    def _stands(self, token: int) -> bool:
        if token not in self.own:
            self.own[token] = merge_bytes(self.bytes_of[token], self.ranks) == [token]
        return self.own[token]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte."""
        data = self.bytes_of[token]
        parts = [self.ranks[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 2:
            best = min((self.ranks.get(self.bytes_of[x] + self.bytes_of[y], _NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(token, made at, used up at) of the tokens at one edge while the merges of token go on; ranks are times."""
        edge = self.edges[side].get(token)
        if edge is None:
            edge, until, part = [], _NEVER, token
            while True:
                halves = self._halves(part)
                edge.append((part, part if halves else -1, until))
                if halves is None:
                    break
                until, part = part, halves[side]
            self.edges[side][token] = edge
        return edge

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b again.

        It does unless a token at a's right edge and one at b's left edge merge while
        both are there: before either is used up, and at equal rank the left one goes first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > _MOST_PAIRS:
                self.pairs.clear()
            known = True
            rights = self._edge(b, 0)
            for x, made_x, until_x in self._edge(a, 1):
                data = self.bytes_of[x]
                for y, made_y, until_y in rights:
                    if made_x < until_y and made_y < until_x:
                        rank = self.ranks.get(data + self.bytes_of[y])
                        if rank is not None and rank < until_x and rank <= until_y:
                            known = False
                            break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """A new transition: the number of the next state, and above _MASK that of what is emitted."""
        key = self.keys[state]
        head, data = key[:3], key[3:] + _BYTES[byte]
        ranks, prefixes, own, pairs = self.ranks, self.prefixes, self.own, self.pairs
        emitted = None if head == _NONE else int.from_bytes(head)
        end: tuple[int, ...] | None = None
        open_: list = []  # places and their tokens in turn, as in a state
        each = iter(self.places[state])
        for i, tokens in zip(each, each):
            piece = data[i:]
            if end is None:
                token = ranks.get(piece)
                if token is not None and (own.get(token) or self._stands(token)):
                    before = tokens[-1] if tokens else emitted
                    if before is None or pairs.get((before, token)) or self._may_follow(before, token):
                        end = (*tokens, token)
            if piece in prefixes:
                open_ += (i, tokens)
        if end is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        if open_ and not open_[1]:  # the bytes since may still become one token: nothing is settled
            key = head + data
            target = self.number.get(key)
            if target is None:
                if len(end) == 1:
                    end = self.single.setdefault(end[0], end)
                target = self._state(key, (*open_, len(data), end))
            return target
        same = len(end)
        for tokens in open_[1::2]:
            while tokens[:same] != end[:same]:
                same -= 1
        out = end[:same]
        keep = sum(map(self.size.__getitem__, out))
        key = (out[-1].to_bytes(3) if same else head) + data[keep:]
        target = self.number.get(key)
        if target is None:
            flat: list = []
            open_ += (len(data), end)
            for i, tokens in zip(open_[::2], open_[1::2]):
                tokens = tokens[same:]
                flat += (i - keep, self.single.setdefault(tokens[0], tokens) if len(tokens) == 1 else tokens)
            target = self._state(key, tuple(flat))
        if not same:
            return target
        n = self.out_number.get(out)
        if n is None:
            n = self.out_number[out] = len(self.outs)
            self.outs.append(out)
        step = self.steps[state << 8 | byte] = n << _SHIFT | target
        return step

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        single = self.ranks.get(data)
        if single is not None:
            return self.single.setdefault(single, (single,))
        if len(self.keys) > self.most_states:
            self._restart()
        state, out, get, longer, keys = 0, [], self.steps.get, self.number.get, self.keys
        for byte in data:
            step = longer(keys[state] + _BYTES[byte])
            if step is None:
                step = get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
                if len(self.keys) > 2 * self.most_states:  # one very long piece
                    out += self.outs[step >> _SHIFT]
                    state = step & _MASK
                    state = self._restart(self.keys[state], self.places[state])
                    get, longer, keys = self.steps.get, self.number.get, self.keys
                    continue
            state = step & _MASK
            if step > _MASK:
                out += self.outs[step >> _SHIFT]
        out += self.places[state][-1]
        return self.single.setdefault(out[0], tuple(out)) if len(out) == 1 else tuple(out)

    def _first(self, part: str) -> bool:
        """Whether a piece was not met before, by its hash: most are met once and not worth a place."""
        h = hash(part) & _MET - 1
        if self.met[h]:
            return False
        if self.n_met >= _MET >> 2:
            self.met, self.n_met = bytearray(_MET), 0
        self.met[h] = 1
        self.n_met += 1
        return True

    def encode(self, text: str) -> list[int]:
        """Tokens of text. Pieces met again are remembered in two tables; the older one is dropped when the newer is full."""
        parts = self.pattern.findall(text)
        found = list(map(self.pieces.get, parts))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            part = parts[at]
            tokens = self.pieces.get(part)
            if tokens is None:
                tokens = self.older.get(part)
                if tokens is None:
                    tokens = self.piece(part.encode())
                    if self._first(part):
                        found[at] = tokens
                        continue
                if len(part) <= 64:
                    if len(self.pieces) >= self.most_pieces:
                        self.older, self.pieces = self.pieces, {}
                    self.pieces[part] = tokens
            found[at] = tokens
        return list(chain.from_iterable(found))


def _utf8_steps() -> list[dict[int, int]]:
    """Transitions of well-formed UTF-8; state 0 stands between characters."""
    steps: list[dict[int, int]] = [{} for _ in range(8)]

    def put(state: int, low: int, high: int, to: int) -> None:
        steps[state].update(dict.fromkeys(range(low, high + 1), to))

    put(0, 0x00, 0x7F, 0), put(0, 0xC2, 0xDF, 1), put(0, 0xE0, 0xE0, 2), put(0, 0xE1, 0xEC, 3), put(0, 0xED, 0xED, 4), put(0, 0xEE, 0xEF, 3)
    put(0, 0xF0, 0xF0, 5), put(0, 0xF1, 0xF3, 6), put(0, 0xF4, 0xF4, 7)
    put(1, 0x80, 0xBF, 0), put(2, 0xA0, 0xBF, 1), put(3, 0x80, 0xBF, 1), put(4, 0x80, 0x9F, 1), put(5, 0x90, 0xBF, 3), put(6, 0x80, 0xBF, 3), put(7, 0x80, 0x8F, 3)
    return steps


_STEPS = _utf8_steps()


class StreamDecoder:
    """Text of a stream of tokens; a character comes out when its last byte has come in."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.text_of = {t: b.decode() if self._complete(b) else None for t, b in bytes_of.items()}
        self.state, self.held = 0, bytearray()

    @staticmethod
    def _complete(data: bytes) -> bool:
        try:
            data.decode()
        except UnicodeDecodeError:
            return False
        return True

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            to = _STEPS[self.state].get(byte)
            if to is None and self.state:
                out.append("�")
                self.state = 0
                self.held.clear()
                to = _STEPS[0].get(byte)
            if to is None:
                out.append("�")
                continue
            self.held.append(byte)
            self.state = to
            if not to:
                out.append(self.held.decode())
                self.held.clear()
        return "".join(out)

    def tokens(self, ids: Iterable[int]) -> str:
        parts = list(map(self.text_of.__getitem__, ids)) if not self.state else [None]
        if None not in parts:
            return "".join(parts)
        out = []
        for i in ids:
            text = self.text_of[i] if not self.state else None
            out.append(self.feed(self.bytes_of[i]) if text is None else text)
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.state else ""
        self.state = 0
        self.held.clear()
        return out


@lru_cache(maxsize=2)
def coder(path: str | None, name: str, most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES) -> tuple[Transducer, StreamDecoder, dict[int, str]]:
    import public_tokenizers

    ranks = load_ranks(path or public_tokenizers.path(name))
    machine = Transducer(ranks, public_tokenizers.PATTERN, most_states, most_pieces)
    return machine, StreamDecoder(machine.bytes_of), {i: str(i) for i in machine.bytes_of}


def _digest(batches: Iterator[pa.RecordBatch], path: str | None, name: str, most_states: int, most_pieces: int) -> Iterator[pa.RecordBatch]:
    let_go()
    machine, decoder, digits = coder(path, name, most_states, most_pieces)
    at_change[:] = [coder.cache_clear]
    gc.disable()  # the tables make no cycles: no use in walking them again and again
    try:
        yield from _digests(batches, machine, decoder, digits)
    finally:
        gc.enable()


def _digests(batches: Iterator[pa.RecordBatch], machine: Transducer, decoder: StreamDecoder, digits: dict[int, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column(1):
            ids = machine.encode(text.as_py())
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            decoded = decoder.tokens(ids) + decoder.end()
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(docs: DataFrame, path: str | None = None, name: str = VOCABULARY, most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text. The two bounds weigh memory against speed only."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", whole().alias("text")).mapInArrow(partial(_digest, path=path, name=name, most_states=most_states, most_pieces=most_pieces), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(batches: Iterator[pa.RecordBatch], path: str | None, name: str) -> Iterator[pa.RecordBatch]:
    machine, _, _ = coder(path, name)
    for batch in batches:
        rows = batch.num_rows
        for at in range(0, rows, 200):
            part = batch.slice(at, 200)
            yield pa.record_batch([part.column(0), pa.array([machine.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encoded(docs: DataFrame, path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """doc_id and ids, the tokens of every text."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", whole().alias("text")).mapInArrow(partial(_encode, path=path, name=name), f"doc_id {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str | None, name: str) -> Iterator[pa.RecordBatch]:
    _, decoder, _ = coder(path, name)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([decoder.tokens(ids.as_py() or []) + decoder.end() for ids in batch.column(1)], pa.string())], names=["doc_id", "text"])


def decoded(tokens: DataFrame, path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """doc_id and text of tokens made by encoded()."""
    prepare(tokens.sparkSession)
    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path=path, name=name), f"doc_id {kind}, text string")
