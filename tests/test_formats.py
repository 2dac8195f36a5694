"""One graph in every format, escapes, and what can't be read."""

import gzip

import pytest

from kinweave.sources import json_ld, rdf, rdf_xml, triples, turtle

XSD = turtle.XSD
TURTLE = """
@prefix : <http://x/> . PREFIX f: <http://f/>
@base <http://b/dir/> .
<a> a :Person ; f:name "José"@nl, 'it''s' ; f:age 7 , 1.5 ; f:size 2e3 ; f:ok true ; .   # a comment . ; ,
<a> f:long \"\"\"two
lines "quoted" \\u00e9\\n\"\"\" ; f:date "1850-02-03"^^<http://www.w3.org/2001/XMLSchema#date> .
_:n1 f:knows [ f:name "x" ] ; f:list ( 1 <../c> ) .
f:1850.5 :p\\/q <http://z/#i> .
[] f:empty () .
"""


def test_turtle():
    got = list(turtle.read(TURTLE.replace("'it''s'", "'its'"), "", "t"))
    plain = {(s, p, o, k, d, lang) for s, p, o, k, d, lang, _ in got}
    a = "http://b/dir/a"
    assert {
        (a, turtle.RDF + "type", "http://x/Person", "iri", None, None), (a, "http://f/name", "José", "literal", None, "nl"), (a, "http://f/name", "its", "literal", None, None), (a, "http://f/age", "7", "literal", XSD + "integer", None),
        (a, "http://f/age", "1.5", "literal", XSD + "decimal", None), (a, "http://f/size", "2e3", "literal", XSD + "double", None), (a, "http://f/ok", "true", "literal", XSD + "boolean", None),
        (a, "http://f/long", 'two\nlines "quoted" é\n', "literal", None, None), (a, "http://f/date", "1850-02-03", "literal", XSD + "date", None), ("http://f/1850.5", "http://x/p/q", "http://z/#i", "iri", None, None),
    } <= plain
    knows = next(x for x in got if x[1] == "http://f/knows")
    assert knows[0] == "_:tn1" and (knows[2], "http://f/name", "x", "literal", None, None) in plain
    head = next(x for x in got if x[1] == "http://f/list")[2]
    first = {x[0]: x[2] for x in got if x[1] == turtle.RDF + "first"}
    rest = {x[0]: x[2] for x in got if x[1] == turtle.RDF + "rest"}
    assert (first[head], first[rest[head]], rest[rest[head]]) == ("1", "http://b/c", turtle.RDF + "nil")
    assert len(got) == 18


def test_trig():
    got = list(turtle.read("@prefix : <http://x/> . :a :p :b . { :c :p 1 } :g { :d :p :e . :d :q :f } GRAPH <http://h> { :i :p [ :q :j ] . }"))
    assert {(x[0][-1], x[6]) for x in got if not x[0].startswith("_:")} == {("a", None), ("c", None), ("d", "http://x/g"), ("i", "http://h")} and len(got) == 6


@pytest.mark.parametrize("text", ["<a> <b> .", "x:a x:b x:c .", "<a> <b> \"c", "<a> <b> { <c> <d> <e> } .", "\"s\" <p> <o> ."])
def test_turtle_errors(text):
    with pytest.raises(ValueError):
        list(turtle.read(text))


XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:f="http://f/" xml:base="http://b/dir/" xml:lang="en">
<f:Person rdf:about="a" f:nick="n"><f:name xml:lang="nl">José</f:name><f:age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">7</f:age><f:knows rdf:resource="../c"/>
<f:child><f:Person rdf:nodeID="k"><f:name>x</f:name></f:Person></f:child><f:part rdf:parseType="Resource"><f:q>1</f:q></f:part><f:all rdf:parseType="Collection"><rdf:Description rdf:about="http://i"/></f:all></f:Person>
<rdf:Bag rdf:ID="bag"><rdf:li>one</rdf:li><rdf:li rdf:nodeID="k"/></rdf:Bag></rdf:RDF>"""


def test_rdf_xml():
    got = list(rdf_xml.read(XML, "", "t"))
    a, lang = "http://b/dir/a", lambda p: next((o, x) for s, q, o, _, _, x, _ in got if q == p)
    plain = {(s, p, o, k, d) for s, p, o, k, d, _, _ in got}
    assert lang("http://f/name") == ("José", "nl") and lang("http://f/nick") == ("n", "en")
    assert {(a, turtle.RDF + "type", "http://f/Person", "iri", None), (a, "http://f/age", "7", "literal", XSD + "integer"), (a, "http://f/knows", "http://b/c", "iri", None), (a, "http://f/child", "_:tk", "bnode", None)} <= plain
    assert {("http://b/dir/#bag", turtle.RDF + "_1", "one", "literal", None), ("http://b/dir/#bag", turtle.RDF + "_2", "_:tk", "bnode", None), ("_:tk", "http://f/name", "x", "literal", None)} <= plain
    head = next(x[2] for x in got if x[1] == "http://f/all")
    assert (head, turtle.RDF + "first", "http://i", "iri", None) in plain and (head, turtle.RDF + "rest", turtle.RDF + "nil", "iri", None) in plain
    assert len(got) == 16


JSON = """{"@context": {"f": "http://f/", "name": "f:name", "knows": {"@id": "f:knows", "@type": "@id"}, "born": {"@id": "f:born", "@type": "http://www.w3.org/2001/XMLSchema#date"},
 "all": {"@id": "f:all", "@container": "@list"}, "label": {"@id": "f:label", "@container": "@language"}, "childOf": {"@reverse": "f:child"}, "@vocab": "http://v/", "@base": "http://b/dir/"},
 "@id": "a", "@type": ["Person", "f:X"], "name": {"@value": "José", "@language": "nl"}, "knows": ["../c", "_:k"], "born": "1850-02-03", "age": 7, "size": 1.5, "ok": true, "all": [1, 2],
 "label": {"en": "e", "nl": ["n", "m"]}, "f:part": {"f:q": null, "name": "x"}, "childOf": {"@id": "p"}}"""


def test_json_ld():
    got = list(json_ld.read(JSON, "", "t"))
    plain = {(s, p, o, k, d, lang) for s, p, o, k, d, lang, _ in got}
    a = "http://b/dir/a"
    assert {
        (a, turtle.RDF + "type", "http://v/Person", "iri", None, None), (a, turtle.RDF + "type", "http://f/X", "iri", None, None), (a, "http://f/name", "José", "literal", None, "nl"), (a, "http://f/knows", "http://b/c", "iri", None, None),
        (a, "http://f/knows", "_:tk", "bnode", None, None), (a, "http://f/born", "1850-02-03", "literal", XSD + "date", None), (a, "http://v/age", "7", "literal", XSD + "integer", None), (a, "http://v/size", "1.5", "literal", XSD + "double", None),
        (a, "http://v/ok", "true", "literal", XSD + "boolean", None), (a, "http://f/label", "m", "literal", None, "nl"), ("http://b/dir/p", "http://f/child", a, "iri", None, None),
    } <= plain
    assert len(got) == 20
    graphs = list(json_ld.read('[{"@id": "http://g", "@graph": [{"@id": "http://s", "http://p": "o"}]}, {"@graph": {"@id": "http://s", "http://p": "q"}}]'))
    assert {(x[2], x[6]) for x in graphs} == {("o", "http://g"), ("q", None)}
    with pytest.raises(ValueError):
        list(json_ld.read('{"@context": "http://elsewhere/", "name": "x"}'))


GRAPH = {("http://x/a", "http://x/name", "Zoë \"q\"", "literal", None, None), ("http://x/a", "http://x/knows", "http://x/b", "iri", None, None), ("http://x/b", "http://x/age", "7", "literal", XSD + "integer", None)}
FILES = {
    "g.nt": f'<http://x/a> <http://x/name> "Zo\\u00EB \\"q\\"" .\n<http://x/a> <http://x/knows> <http://x/b> . # note\n<http://x/b><http://x/age>"7"^^<{XSD}integer>.\n',
    "g.nq": f'<http://x/a> <http://x/name> "Zoë \\"q\\"" .\n<http://x/a> <http://x/knows> <http://x/b> .\n<http://x/b> <http://x/age> "7"^^<{XSD}integer> .\n',
    "g.ttl": '@prefix x: <http://x/> . x:a x:name "Zoë \\"q\\"" ; x:knows x:b . x:b x:age 7 .',
    "g.trig": '@prefix x: <http://x/> . { x:a x:name "Zoë \\"q\\"" ; x:knows x:b . x:b x:age 7 . }',
    "g.n3": "@prefix x: <http://x/> . x:a x:name 'Zoë \"q\"' ; x:knows x:b . x:b x:age 7 .",
    "g.jsonld": '{"@context": {"@vocab": "http://x/"}, "@id": "http://x/a", "name": "Zoë \\"q\\"", "knows": {"@id": "http://x/b", "age": 7}}',
    "g.rdf": f'<rdf:RDF xmlns:rdf="{turtle.RDF}" xmlns:x="http://x/"><rdf:Description rdf:about="http://x/a"><x:name>Zoë "q"</x:name><x:knows><rdf:Description rdf:about="http://x/b"><x:age rdf:datatype="{XSD}integer">7</x:age></rdf:Description></x:knows></rdf:Description></rdf:RDF>',
}


def test_every_format_gives_the_same_graph(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
        assert {tuple(r)[:6] for r in rdf.read(spark, str(tmp_path / name)).collect()} == GRAPH, name
    (tmp_path / "g.ttl.gz").write_bytes(gzip.compress(FILES["g.ttl"].encode()))
    assert rdf.read(spark, str(tmp_path / "g.ttl.gz")).count() == 3
    with pytest.raises(ValueError):
        rdf.read(spark, "g.hdt")


ESCAPES = {
    "Jos\\u00e9": "José", "\\U0001F600": "😀", "\\uD83D\\uDE00": "😀", "\\uD83D": "�", "\\U00110000": "�", "c\\\\temp": "c\\temp", "c\\\\\\temp": "c\\\temp", "a\\tb\\nc\\rd\\be\\ff": "a\tb\nc\rd\be\ff", "\\\"\\'": "\"'",
    "\\\\u00e9": "\\u00e9", "plain": "plain", "": "", "\\\\\\u00e9\\\\": "\\é\\",
}


def test_escapes(spark):
    lines = [f'<urn:{i}> <urn:p\\u00e9> "{e}" .' for i, e in enumerate(ESCAPES)] + ["<urn:\\u00e9> <urn:p> _:b.1 _:g.", f'<urn:long> <urn:p> "{"x" * 200_000}" .']
    got = {r.s: r for r in triples.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert [got[f"urn:{i}"].o for i in range(len(ESCAPES))] == list(ESCAPES.values()) and got["urn:0"].p == "urn:pé"
    assert (got["urn:é"].o, got["urn:é"].o_kind, got["urn:é"].g) == ("_:b.1", "bnode", "_:g") and len(got["urn:long"].o) == 200_000


def test_blank_nodes_of_two_files_differ(spark, tmp_path):
    for name in ("a.nt", "b.nt"):
        (tmp_path / name).write_text("_:x <urn:p> _:y .")
    rows = rdf.read(spark, str(tmp_path / "a.nt")).union(rdf.read(spark, str(tmp_path / "b.nt"))).collect()
    assert len({r.s for r in rows} | {r.o for r in rows}) == 4
