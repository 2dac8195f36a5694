"""RDF/XML as statements."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

from kinweave.sources.turtle import RDF, Statement

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"
#: Attributes of the syntax itself, which are no properties (fixed values).
_SYNTAX = {f"{_R}{x}" for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "bagID", "aboutEach")} | {f"{_XML}lang", f"{_XML}base", "about", "ID", "resource"}


def _iri(name: str) -> str:
    return name[1:].replace("}", "", 1) if name.startswith("{") else name


class _Reader:
    def __init__(self, base: str, tag: str):
        self.tag, self.base, self.made = tag, base, 0

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.tag}.{self.made}"

    def named(self, e: ElementTree.Element, base: str) -> tuple[str, str]:
        """(name, kind) of the node an element stands for."""
        get = lambda x: e.get(_R + x, e.get(x))
        if (about := get("about")) is not None:
            return urljoin(base, about) if base else about, "iri"
        if (own := get("ID")) is not None:
            return f"{base}#{own}", "iri"
        if (node := e.get(f"{_R}nodeID")) is not None:
            return f"_:{self.tag}{node}", "bnode"
        return self.fresh(), "bnode"

    def node(self, e: ElementTree.Element, lang: str | None, base: str) -> Iterator[Statement | tuple[str, str]]:
        """Statements about an element's node, and its (name, kind) as the last item."""
        lang, base = e.get(f"{_XML}lang", lang), e.get(f"{_XML}base", base)
        s, kind = self.named(e, base)
        if e.tag != f"{_R}Description":
            yield s, RDF + "type", _iri(e.tag), "iri", None, None, None
        yield from self.attributes(s, e, lang)
        items = 0
        for child in e:
            if child.tag == f"{_R}li":
                items += 1
            yield from self.property(s, child, lang, base, items)
        yield s, kind

    def attributes(self, s: str, e: ElementTree.Element, lang: str | None) -> Iterator[Statement]:
        for name, value in e.attrib.items():
            if name == f"{_R}type":
                yield s, RDF + "type", value, "iri", None, None, None
            elif name not in _SYNTAX and not name.startswith(_XML):
                yield s, _iri(name), value, "literal", None, lang or None, None

    def _inner(self, e: ElementTree.Element, lang: str | None, base: str, found: list) -> Iterator[Statement]:
        for x in self.node(e, lang, base):
            if len(x) == 2:
                found.append(x)
            else:
                yield x

    def property(self, s: str, e: ElementTree.Element, lang: str | None, base: str, item: int) -> Iterator[Statement]:
        lang, base = e.get(f"{_XML}lang", lang), e.get(f"{_XML}base", base)
        p = f"{RDF}_{item}" if e.tag == f"{_R}li" else _iri(e.tag)
        parse = e.get(f"{_R}parseType")
        children = list(e)
        found: list[tuple[str, str]] = []
        if parse == "Resource":
            o = self.fresh()
            yield s, p, o, "bnode", None, None, None
            for k, child in enumerate(children, 1):
                yield from self.property(o, child, lang, base, k)
        elif parse == "Collection":
            for child in children:
                yield from self._inner(child, lang, base, found)
            names = [self.fresh() for _ in found]
            yield (s, p, names[0], "bnode", None, None, None) if names else (s, p, RDF + "nil", "iri", None, None, None)
            for k, (o, kind) in enumerate(found):
                yield names[k], RDF + "first", o, kind, None, None, None
                yield (names[k], RDF + "rest", names[k + 1], "bnode", None, None, None) if k + 1 < len(names) else (names[k], RDF + "rest", RDF + "nil", "iri", None, None, None)
        elif parse is not None:
            inner = (e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in children)
            yield s, p, inner, "literal", RDF + "XMLLiteral", None, None
        elif children:
            yield from self._inner(children[0], lang, base, found)
            o, kind = found[0]
            yield s, p, o, kind, None, None, None
        elif (resource := e.get(f"{_R}resource", e.get("resource"))) is not None or e.get(f"{_R}nodeID") is not None or any(a not in _SYNTAX and not a.startswith(_XML) for a in e.attrib):
            o, kind = (urljoin(base, resource) if base else resource, "iri") if resource is not None else self.named(e, base)
            yield s, p, o, kind, None, None, None
            yield from self.attributes(o, e, lang)
        else:
            datatype = e.get(f"{_R}datatype")
            yield s, p, e.text or "", "literal", datatype, None if datatype else (lang or None), None


def read(text: str | bytes, base: str = "", tag: str = "") -> Iterator[Statement]:
    root = ElementTree.fromstring(text)
    reader = _Reader(base, tag)
    lang, base = root.get(f"{_XML}lang"), root.get(f"{_XML}base", base)
    for e in root if root.tag == f"{_R}RDF" else [root]:
        yield from (x for x in reader.node(e, lang, base) if len(x) == 7)
