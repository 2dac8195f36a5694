"""HTML extraction by minimum-cut labelling of text blocks.

A page is read as blocks: text between the starts and ends of block elements, with
character references decoded and white space made one space. A linear
classifier gives each block evidence for content (positive) or boilerplate (negative): its
length, its share of link text, headings, and the element it stands in. The evidence is the
capacity of the block's arc from the source or to the sink. Blocks that follow each other
or share a parent are joined by edges, stronger the closer they are in the document tree.
The minimum cut, found by maximum flow, is the labelling with the least total cost, and the
source side is the text: a weak block goes with its neighbours.

The weights are argued, not fitted, as no page is labelled: they are set down below in units
of the evidence of seven words. Names in class, id and role are soft evidence. They count in full on
containers and less on a paragraph; what an element holds may outvote them: a name says nothing
where the element holds the page's main article or nearly all of its words (a wrapper), nor in
names that tell of a layout (with-sidebar, no-sidebar). Inside an article, a marked element
loses the article's favour (adverts, comments).

Null, empty and text-less pages give the empty text; long pages are handled whole, in time
nearly linear in their length; equal pages give equal texts, and an empty table gives
no row. A tag cut off by the page's end is dropped. Markup need not be well-formed: end tags
close what they match, a new paragraph, list item or table cell closes an open one, and the
head ends at the first thing that can't stand in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import prepare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
_MARKED = re.compile(r"(?:\b(class|id|role|style|aria-hidden|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))|\b(hidden)\b", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")

#: Elements whose text never shows, or is no text (fixed values).
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
IN_HEAD = frozenset("base link meta title script style noscript template head html".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text (fixed values).
ASIDES = frozenset("nav footer aside form dialog menu button fieldset".split())
#: Words of class, id and role that mark boilerplate, and those that mark content (fixed values).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager footer masthead topbar search login comment comments disqus reply replies respond "
    "share sharing social related recommended widget complementary contentinfo".split()
)
GOOD = frozenset("article content entry main post story".split())
#: First words of names that tell how a page is laid out, not what an element holds.
LAYOUT = frozenset("has is no with without".split())
#: Elements that close an open one of the same group.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Weights of the classifier; a word's is PER_WORD, up to MOST_WORDS of a block.
BIAS, PER_WORD, MOST_WORDS, LINKED, HEADING = -1.5, 0.15, 30, -6.0, 1.5
IN_ARTICLE, GOOD_NAME, ASIDE, HEADER, MARKED, MARKED_TEXT, HIDDEN = 6.0, 3.0, -9.0, -9.0, -9.0, -3.0, -40.0
#: Elements that hold a single run of text: a name on them is weak evidence.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt".split())
#: The share of a page's words from which a marked element is a wrapper.
WRAPPER = 0.9
#: Strength of the edges: neighbours, and blocks of one parent; halved for each step apart in the tree, up to FAR steps.
NEXT, SIBLING, FAR = 8.0, 2.0, 10
_UNIT = 256


class _Element:
    __slots__ = ("article", "depth", "hidden", "marks", "name", "named", "parent", "score", "words")

    def __init__(self, name: str, parent: _Element | None, attributes: str = ""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.marks, self.named, self.hidden = _names(attributes) if attributes else (False, False, False)
        self.words, self.score, self.article = 0, 0.0, False

    def judge(self, holds_main: bool, all_words: int) -> None:
        """The evidence an element gives all that it holds, from its parent's, its name and its marks."""
        up = self.parent
        self.score, self.article = (up.score, up.article) if up else (0.0, False)
        own = 0.0
        if not holds_main and self.words < WRAPPER * all_words:
            if self.name in ASIDES:
                own = ASIDE
            elif self.name == "header" and not self.article:
                own = HEADER
            elif self.marks and not self.named:
                own = MARKED_TEXT if self.name in TEXT_ELEMENTS else MARKED
        if self.hidden:
            own = HIDDEN
        if own:
            if own != MARKED_TEXT:
                self.article = False
            self.score = max(HIDDEN, min(self.score, 0.0) + own)
        elif self.name in ("article", "main") and self.score >= 0:
            self.article = True
        elif self.named and self.score == 0:
            self.score = GOOD_NAME


def _names(attributes: str) -> tuple[bool, bool, bool]:
    """Whether names mark boilerplate, whether they mark content, and whether the element is hidden."""
    marks = named = gone = False
    for key, value, hidden in _MARKED.findall(attributes):
        if hidden:
            gone = True
            continue
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif key == "aria-hidden":
            gone |= value == "true"
        elif key != "aria-label":
            for name in value.split():
                words = _NAME.findall(name)
                if words and words[0] not in LAYOUT:
                    marks |= not MARKS.isdisjoint(words)
                    named |= not GOOD.isdisjoint(words) and MARKS.isdisjoint(words)
    return marks, named, gone


class Block:
    __slots__ = ("element", "heading", "linked", "text", "words")

    def __init__(self, text: str, element: _Element, linked: int, heading: bool):
        self.text, self.element, self.heading = text, element, heading
        self.words = text.count(" ") + 1
        self.linked = min(1.0, linked / len(text))

    def evidence(self) -> float:
        e = self.element
        out = BIAS + PER_WORD * min(self.words, MOST_WORDS) + LINKED * self.linked * (not e.article) + HEADING * self.heading
        return out + e.score + IN_ARTICLE * e.article


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with the elements they stand in judged."""
    out: list[Block] = []
    top = here = _Element("html", None)
    elements = [top]
    opened: dict[str, int] = {}
    endless: set[str] = set()
    parts: list[str] = []
    linked, in_link, heading, in_head = 0, 0, False, False

    def flush() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, here, linked, heading))
            parts.clear()
        linked = 0

    def close() -> None:
        nonlocal here
        opened[here.name] -= 1
        here = here.parent

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            if in_head and piece.strip():
                in_head = False
            if not in_head:
                parts.append(piece)
                if in_link:
                    linked += len(piece)
        if lt == n:
            break
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a bare <
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2] if m.lastindex else None
        if name is None:
            continue
        name = name.lower()
        if not page.endswith(">", lt, at):
            break  # cut off
        if m[1]:
            if name == "head":
                in_head = False
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in INLINE or name in UNSEEN:
                continue
            flush()
            heading = False
            if opened.get(name):
                while here.name != name:
                    close()
                close()
            continue
        if name == "head":
            in_head = True
            continue
        if in_head and name not in IN_HEAD:
            in_head = False
        if name in UNSEEN:
            if m[3].endswith("/") and name not in RAW:
                continue
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif name in RAW:
                at = n
            else:
                endless.add(name)  # never closed: the page goes on
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link += 1
            continue
        if in_head:
            continue
        flush()
        in_link = 0
        if name in VOID or name in ("html", "body"):
            continue
        closes = _CLOSES.get(name, ())
        if name in _ENDS_P and here.name == "p":
            close()
        elif here.name in closes:
            close()
            if name == "tr" and here.name == "tr":
                close()
        here = _Element(name, here, m[3])
        opened[name] = opened.get(name, 0) + 1
        elements.append(here)
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
    flush()
    _judge(out, elements)
    return out


def _judge(found: list[Block], elements: list[_Element]) -> None:
    for b in found:
        b.element.words += b.words
    for e in reversed(elements):  # children come after their parents
        if e.parent:
            e.parent.words += e.words
    mains = [e for e in elements if e.name in ("article", "main") and not e.marks and not e.hidden]
    main = max(mains, key=lambda e: (e.name == "main", e.words), default=None)
    holds = set()
    while main:
        holds.add(id(main))
        main = main.parent
    for e in elements:
        e.judge(id(e) in holds, elements[0].words)


def _apart(a: _Element, b: _Element) -> int:
    """Steps between two elements in the tree; FAR + 1 for more than FAR."""
    steps = 0
    while a is not b and steps <= FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(evidence: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (the smallest such side).

    evidence: capacity from the source if positive, to the sink if negative. Flow is
    pushed in rounds: distances from all nodes with flow left, then every shortest path
    in one walk over the arcs. Capacities are integers.
    """
    n = len(evidence)
    left = [round(e * _UNIT) for e in evidence]
    heads: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, w in edges:
        c = round(w * _UNIT)
        if c and a != b:
            heads[a].append(len(to))
            heads[b].append(len(to) + 1)
            to += (b, a)
            room += (c, c)  # arc k and its reverse k ^ 1
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if left[i] > 0]
        for i in queue:
            far[i] = 0
        end = n + 1
        for u in queue:
            if far[u] >= end:
                break
            for k in heads[u]:
                v = to[k]
                if far[v] < 0 and room[k] > 0:
                    far[v] = far[u] + 1
                    queue.append(v)
                    if left[v] < 0:
                        end = min(end, far[v])
        if end > n:
            return [d >= 0 for d in far]
        at = [0] * n
        for s in [i for i in queue if far[i] == 0]:
            path: list[int] = []
            u = s
            while left[s] > 0:
                if left[u] < 0:
                    amount = min(left[s], -left[u], *(room[k] for k in path))
                    left[s] -= amount
                    left[u] += amount
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    path, u = [], s
                    continue
                arcs = heads[u]
                while at[u] < len(arcs) and not (room[arcs[at[u]]] > 0 and far[to[arcs[at[u]]]] == far[u] + 1 <= end):
                    at[u] += 1
                if at[u] < len(arcs):
                    path.append(arcs[at[u]])
                    u = to[path[-1]]
                elif path:
                    k = path.pop()
                    u = to[k ^ 1]
                    at[u] += 1
                else:
                    break


def network(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Evidence of the blocks and the edges between them, two a block at most."""
    edges: list[tuple[int, int, float]] = []
    last_of: dict[int, int] = {}
    for i, b in enumerate(found):
        if i and (apart := _apart(found[i - 1].element, b.element)) <= FAR:
            edges.append((i - 1, i, NEXT / 2**apart))
        parent = id(b.element.parent or b.element)
        if (j := last_of.get(parent, -1)) >= 0 and j != i - 1:
            edges.append((j, i, SIBLING / (i - j)))
        last_of[parent] = i
    return [b.evidence() for b in found], edges


def extract(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, content in zip(found, minimum_cut(*network(found))) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [extract(x.as_py()) for x in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; other columns, whatever their names, are left out."""
    prepare(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
