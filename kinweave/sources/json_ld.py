"""JSON-LD as statements: contexts in the document, terms, types, languages, lists, sets, reverse properties and graphs.

Contexts at another address are not fetched: they raise ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from kinweave.sources.turtle import RDF, XSD, Statement

_KEYWORDS = {"@id", "@type", "@value", "@language", "@graph", "@list", "@set", "@reverse", "@context", "@index"}


class _Context:
    def __init__(self, base: str, terms: dict | None = None, vocab: str = "", language: str | None = None):
        self.base, self.terms, self.vocab, self.language = base, terms or {}, vocab, language

    def with_(self, given: object) -> _Context:
        """This context with another on top."""
        if isinstance(given, list):
            out = self
            for g in given:
                out = out.with_(g)
            return out
        if given is None:
            return _Context(self.base)
        if not isinstance(given, dict):
            raise ValueError(f"context {given!r} is not in the document")
        out = _Context(given.get("@base", self.base) or "", dict(self.terms), given.get("@vocab", self.vocab) or "", given.get("@language", self.language))
        for term, meaning in given.items():
            if not term.startswith("@"):
                out.terms[term] = meaning if isinstance(meaning, dict) else {"@id": meaning}
        return out

    def named(self, name: str, vocab: bool) -> str:
        """The IRI (or keyword) of a term, compact or relative name."""
        if name in _KEYWORDS:
            return name
        if vocab and name in self.terms:
            meaning = self.terms[name].get("@id", name)
            if meaning is None or meaning == name and ":" not in name:
                return self.vocab + name if meaning else ""
            return meaning if meaning in _KEYWORDS else self.named(meaning, False) if ":" in meaning and meaning.split(":")[0] != name else self.vocab + meaning if ":" not in meaning else meaning
        if ":" in name:
            prefix, local = name.split(":", 1)
            if prefix == "_" or local.startswith("//"):
                return name
            if prefix in self.terms:
                return self.named(prefix, True) + local
            return name
        return self.vocab + name if vocab else urljoin(self.base, name) if self.base else name


class _Reader:
    def __init__(self, tag: str):
        self.tag, self.made, self.out = tag, 0, []

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.tag}.{self.made}"

    def name(self, iri: str) -> tuple[str, str]:
        return (f"_:{self.tag}{iri[2:]}", "bnode") if iri.startswith("_:") else (iri, "iri")

    def node(self, x: dict, c: _Context, g: str | None) -> tuple[str, str]:
        """Says what an object tells of its node; returns the node's (name, kind)."""
        c = c.with_(x["@context"]) if "@context" in x else c
        keys = {k: c.named(k, True) for k in x}
        own = next((x[k] for k, m in keys.items() if m == "@id"), None)
        s, kind = self.name(c.named(own, False)) if isinstance(own, str) else (self.fresh(), "bnode")
        for key, p in keys.items():
            value = x[key]
            if p == "@type":
                for t in value if isinstance(value, list) else [value]:
                    self.out.append((s, RDF + "type", *self.name(c.named(t, True)), None, None, g))
            elif p == "@graph":
                only = not any(m not in ("@context", "@graph", "@id") for m in keys.values()) and own is None
                for y in value if isinstance(value, list) else [value]:
                    self.node(y, c, g if only else s)
            elif p == "@reverse":
                for q, back in value.items():
                    for y in back if isinstance(back, list) else [back]:
                        o, _ = self.node(y, c, g) if isinstance(y, dict) else self.name(c.named(y, False))
                        self.out.append((o, c.named(q, True), s, kind, None, None, g))
            elif p and not p.startswith("@") and (":" in p):
                self.values(s, p, value, c.terms.get(key, {}), c, g)
        return s, kind

    def values(self, s: str, p: str, value: object, term: dict, c: _Context, g: str | None) -> None:
        back = "@reverse" in term
        if back:
            p = c.named(term["@reverse"], False)
        if term.get("@container") == "@list" and not (isinstance(value, dict) and "@list" in value):
            value = {"@list": value if isinstance(value, list) else [value]}
        if term.get("@container") == "@language" and isinstance(value, dict):
            value = [{"@value": v, "@language": k} for k, vs in value.items() for v in (vs if isinstance(vs, list) else [vs])]
        if isinstance(value, dict) and "@set" in value:
            value = value["@set"]
        for v in value if isinstance(value, list) else [value]:
            found = self.value(v, term, c, g)
            if found is None:
                continue
            if back:
                self.out.append((found[0], p, *self.name(s), None, None, g) if s.startswith("_:") else (found[0], p, s, "iri", None, None, g))
            else:
                self.out.append((s, p, *found, g))

    def value(self, v: object, term: dict, c: _Context, g: str | None) -> tuple | None:
        """(value, kind, datatype, language) of one value."""
        kind = term.get("@type")
        if v is None:
            return None
        if isinstance(v, dict):
            if "@list" in v:
                items = [y for x in (v["@list"] if isinstance(v["@list"], list) else [v["@list"]]) if (y := self.value(x, term | {"@container": None}, c, g))]
                names = [self.fresh() for _ in items]
                for k, item in enumerate(items):
                    self.out.append((names[k], RDF + "first", *item, g))
                    self.out.append((names[k], RDF + "rest", *((names[k + 1], "bnode") if k + 1 < len(names) else (RDF + "nil", "iri")), None, None, g))
                return (names[0], "bnode", None, None) if names else (RDF + "nil", "iri", None, None)
            if "@value" in v:
                datatype = v.get("@type")
                return self.plain(v["@value"], c.named(datatype, True) if datatype else None, v.get("@language"))
            return (*self.node(v, c, g), None, None)
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return (*self.name(c.named(v, kind == "@vocab")), None, None)
        language = term.get("@language", c.language) if isinstance(v, str) and not kind else None
        return self.plain(v, c.named(kind, True) if kind and kind != "@none" else None, language)

    @staticmethod
    def plain(v: object, datatype: str | None, language: str | None) -> tuple:
        if isinstance(v, bool):
            return "true" if v else "false", "literal", datatype or XSD + "boolean", None
        if isinstance(v, int):
            return str(v), "literal", datatype or XSD + "integer", None
        if isinstance(v, float):
            return (str(int(v)), "literal", datatype or XSD + "integer", None) if v == int(v) and not datatype else (repr(v), "literal", datatype or XSD + "double", None)
        return str(v), "literal", datatype, language


def read(text: str, base: str = "", tag: str = "") -> Iterator[Statement]:
    reader, top = _Reader(tag), json.loads(text)
    for x in top if isinstance(top, list) else [top]:
        reader.node(x, _Context(base), None)
        yield from reader.out
        reader.out.clear()
