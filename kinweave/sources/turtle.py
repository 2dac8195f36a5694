"""Turtle and TriG (and N3 without rules), read by one pass over the text.

Statements are tuples (s, p, o, o_kind, o_datatype, o_lang, g). Blank nodes are named
by a tag of the file and their label or number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

Statement = tuple[str, str, str, str, str | None, str | None, str | None]

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_SKIP = re.compile(r"(?:\s+|#[^\n]*)*")
_TOKEN = re.compile(
    r"""(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>\s"{}|^`]*>)|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<word>[A-Za-z]+)|(?P<op>\^\^|=>|[.;,=\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CHARS.get(m[3], m[3]), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Reader:
    def __init__(self, text: str, base: str = "", tag: str = ""):
        self.text, self.base, self.tag, self.at = text, base, tag, 0
        self.prefixes: dict[str, str] = {}
        self.made, self.graph = 0, None
        self.out: list[Statement] = []
        self.kind, self.value = "", ""
        self.step()

    def step(self) -> None:
        """Moves on to the next token."""
        at = _SKIP.match(self.text, self.at).end()
        if at == len(self.text):
            self.kind, self.value, self.at = "end", "", at
            return
        m = _TOKEN.match(self.text, at)
        if not m:
            raise ValueError(f"can't be read at {self.text[at : at + 40]!r}")
        self.kind, self.value, self.at = m.lastgroup, m.group(), m.end()

    def take(self, value: str) -> bool:
        if self.kind in ("op", "word", "at") and (self.value == value or self.kind == "word" and self.value.upper() == value):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"{value} expected, {self.value!r} found")

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.tag}.{self.made}"

    def iri(self) -> str:
        kind, value = self.kind, self.value
        if kind == "iri":
            self.step()
            return urljoin(self.base, unescape(value[1:-1])) if self.base else unescape(value[1:-1])
        if kind == "name":
            prefix, local = value.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix}:")
            self.step()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"an IRI expected, {value!r} found")

    def say(self, s: str, p: str, o: tuple[str, str, str | None, str | None]) -> None:
        self.out.append((s, p, *o, self.graph))

    def node(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, language) of a term; blank node lists and collections are said as they come."""
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return self.iri(), "iri", None, None
        if kind == "blank":
            self.step()
            return f"_:{self.tag}{value[2:]}", "bnode", None, None
        if kind in ("text", "long"):
            self.step()
            cut = 3 if kind == "long" else 1
            text = unescape(value[cut:-cut])
            if self.kind == "at":
                language = self.value[1:]
                self.step()
                return text, "literal", None, language
            return text, "literal", self.iri() if self.take("^^") else None, None
        if kind in ("integer", "decimal", "double"):
            self.step()
            return value, "literal", XSD + kind, None
        if kind == "word" and value in ("true", "false"):
            self.step()
            return value, "literal", XSD + "boolean", None
        if self.take("["):
            name = self.fresh()
            if not self.take("]"):
                self.about(name)
                self.need("]")
            return name, "bnode", None, None
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            names = [self.fresh() for _ in items]
            for k, item in enumerate(items):
                self.say(names[k], RDF + "first", item)
                self.say(names[k], RDF + "rest", (names[k + 1], "bnode", None, None) if k + 1 < len(items) else (RDF + "nil", "iri", None, None))
            return (names[0], "bnode", None, None) if items else (RDF + "nil", "iri", None, None)
        raise ValueError(f"a term expected, {value!r} found")

    def about(self, s: str) -> None:
        """Predicates and objects of a subject."""
        while True:
            if self.kind == "word" and self.value == "a":
                self.step()
                p = RDF + "type"
            elif self.take("="):
                p = "http://www.w3.org/2002/07/owl#sameAs"
            else:
                p = self.iri()
            while True:
                self.say(s, p, self.node())
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if (self.kind == "op" and self.value in ".]}") or self.kind == "end":
                return

    def subject(self) -> tuple[str, bool]:
        """(name, whether it says something by itself)."""
        alone = self.kind == "op" and self.value == "["
        value, kind, _, _ = self.node()
        if kind == "literal":
            raise ValueError(f"a subject expected, {value!r} found")
        return value, alone

    def _triples(self) -> None:
        s, alone = self.subject()
        if not (alone and self.kind == "op" and self.value in ".}"):
            self.about(s)

    def _directive(self) -> bool:
        for word in ("PREFIX", "BASE"):
            at = f"@{word.lower()}"
            dotted = self.kind == "at" and self.value == at
            if not (self.take(at) or self.take(word)):
                continue
            if word == "BASE":
                self.base = self.iri()
            else:
                if self.kind != "name" or not self.value.endswith(":"):
                    raise ValueError("a prefix expected")
                prefix = self.value[:-1]
                self.step()
                self.prefixes[prefix] = self.iri()
            if dotted:
                self.need(".")
            return True
        return False

    def _graph(self) -> None:
        """Statements in braces."""
        while not self.take("}"):
            self._triples()
            if not self.take("."):
                self.need("}")
                break
        self.graph = None

    def statements(self) -> Iterator[Statement]:
        while self.kind != "end":
            if not self._directive():
                if self.take("{"):
                    self._graph()
                    self.take(".")
                else:
                    named = self.take("GRAPH")
                    if named or self.kind in ("iri", "name", "blank"):
                        s, _ = self.subject()
                        if named or (self.kind == "op" and self.value == "{"):
                            self.need("{")
                            self.graph = s
                            self._graph()
                            self.take(".")
                        else:
                            self.about(s)
                            self.need(".")
                    else:
                        self._triples()
                        self.need(".")
            yield from self.out
            self.out.clear()


def read(text: str, base: str = "", tag: str = "") -> Iterator[Statement]:
    return Reader(text, base, tag).statements()
