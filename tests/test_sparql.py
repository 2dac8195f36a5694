import pytest

from kinweave.sources import sparql, triples

LINES = ["<n:a> <p:name> \"anna\" .", "<n:b> <p:name> \"bert\" .", "<n:c> <p:name> \"carl\" .", "<n:a> <p:age> \"9\" .", "<n:b> <p:age> \"10\" .", "<n:a> <p:knows> <n:b> .", "<n:b> <p:knows> <n:c> ."]
LINES += ['<n:a> <p:say> "ja"@nl .', '<n:a> <p:say> "yes"@en-GB .', '<n:a> <p:say> "oui" .', '<n:a> <p:size> "7"^^<t:int> .', "<n:c> <p:likes> <n:a> .", "<n:d> <p:likes> <n:d> .", "<n:c> <p:likes> _:b ."]
LINES += ["<n:a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <t:P/1> .", "<n:b> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <t:P/1> ."]

CASES = [
    ("SELECT ?n WHERE { ?x a t:P\\/1 ; p:name ?n . }", {("anna",), ("bert",)}),
    ("SELECT ?n ?a WHERE { ?x p:name ?n . OPTIONAL { ?x p:age ?a . FILTER(?a > 9) } }", {("anna", None), ("bert", "10"), ("carl", None)}),
    ("SELECT ?n WHERE { ?x p:name ?n . OPTIONAL { ?x p:age ?a } FILTER(!BOUND(?a)) }", {("carl",)}),
    ("SELECT DISTINCT * WHERE { { SELECT ?x WHERE { ?x p:knows ?y } } ?x p:age ?a }", {("n:a", "9"), ("n:b", "10")}),
    ("SELECT ?n WHERE { ?x p:name ?n FILTER(?x = <n:c> || STRSTARTS(?n, \"a\")) }", {("anna",), ("carl",)}),
    ("SELECT ?n WHERE { ?x p:name ?n . FILTER NOT EXISTS { ?x p:knows ?y } }", {("carl",)}),
    ("SELECT ?n WHERE { ?x p:name ?n . MINUS { ?x p:age ?a } }", {("carl",)}),
    ("SELECT ?n WHERE { ?x p:name ?n . VALUES ?n { \"anna\" \"dora\" } }", {("anna",)}),
    ("SELECT ?v WHERE { { ?x p:age ?v } UNION { ?x p:name ?v } FILTER(?v IN (\"9\", \"carl\")) }", {("9",), ("carl",)}),
    ("SELECT ?u WHERE { ?x p:name ?n . BIND(UCASE(?n) AS ?u) FILTER(STRLEN(?n) = 4 && REGEX(?n, \"^[AB]\", \"i\")) }", {("ANNA",), ("BERT",)}),
    ("SELECT ?p (COUNT(?o) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p HAVING (COUNT(?o) > 2)", {("p:name", 3), ("p:say", 3), ("p:likes", 3)}),
    ("SELECT (MAX(?a) AS ?m) (SUM(?a) AS ?t) WHERE { ?x p:age ?a }", {("10", 19.0)}),
    ("SELECT ?n WHERE { ?x p:name ?n ; p:age ?a } ORDER BY DESC(?a) LIMIT 1", {("bert",)}),
    ("SELECT ?n WHERE { ?x p:name ?n ; p:age ?a } ORDER BY ?a OFFSET 1", {("bert",)}),
    ("SELECT ?n WHERE { BIND(\"bert\" AS ?n) ?x p:name ?n }", {("bert",)}),
    ("SELECT ?x ?n WHERE { VALUES (?x ?n) { (<n:a> \"anna\") (<n:a> \"bert\") (UNDEF \"carl\") (<n:b> UNDEF) } ?x p:name ?n }", {("n:a", "anna"), ("n:c", "carl"), ("n:b", "bert")}),
    ("SELECT ?v WHERE { ?x p:say ?v FILTER(LANG(?v) = \"nl\") }", {("ja",)}),
    ("SELECT ?v WHERE { ?x p:say ?v FILTER(LANGMATCHES(LANG(?v), \"EN\") || LANG(?v) = \"\") }", {("yes",), ("oui",)}),
    ("SELECT DISTINCT ?p ?d WHERE { <n:a> ?p ?v FILTER(!isIRI(?v) && ?p != p:name) BIND(DATATYPE(?v) AS ?d) }", {("p:age", "http://www.w3.org/2001/XMLSchema#string"), ("p:say", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), ("p:say", "http://www.w3.org/2001/XMLSchema#string"), ("p:size", "t:int")}),
    ("SELECT DISTINCT ?o WHERE { ?x p:likes ?o FILTER(isBlank(?o)) }", {("_:b",)}),
    ("SELECT ?y WHERE { <n:a> p:knows+ ?y }", {("n:b",), ("n:c",)}),
    ("SELECT ?x WHERE { ?x p:knows+ <n:c> }", {("n:a",), ("n:b",)}),
    ("SELECT ?x ?y WHERE { ?x p:knows+ ?y }", {("n:a", "n:b"), ("n:a", "n:c"), ("n:b", "n:c")}),
    ("SELECT ?y WHERE { <n:a> p:knows* ?y }", {("n:a",), ("n:b",), ("n:c",)}),
    ("SELECT ?y WHERE { <n:a> p:knows? ?y }", {("n:a",), ("n:b",)}),
    ("SELECT ?y WHERE { <n:a> (p:knows|p:likes)+ ?y }", {("n:a",), ("n:b",), ("n:c",), ("_:b",)}),
    ("SELECT ?n WHERE { <n:a> p:knows/p:knows/p:name ?n }", {("carl",)}),
    ("SELECT ?x WHERE { <n:b> ^p:knows ?x }", {("n:a",)}),
    ("SELECT ?n WHERE { <n:c> (^p:knows)+/p:name ?n }", {("anna",), ("bert",)}),
    ("SELECT ?v WHERE { <n:b> !(p:name|p:knows|a) ?v }", {("10",)}),
    ("SELECT ?x ?a ?n WHERE { ?x p:name ?n . OPTIONAL { ?x p:age ?a } OPTIONAL { ?y p:age ?a ; p:knows ?x } }", {("n:a", "9", "anna"), ("n:b", "10", "bert"), ("n:c", "10", "carl")}),
    ("SELECT ?n WHERE { ?x p:name ?n . OPTIONAL { ?x p:age ?a } MINUS { ?x p:knows ?y . ?x p:age ?a } }", {("carl",)}),
    ("SELECT ?m WHERE { ?x p:name \"anna\" ; p:knows ?y . ?y p:name ?m }", {("bert",)}),
]


@pytest.fixture(scope="module")
def graph(spark):
    t = triples.parse(spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1))
    return spark.createDataFrame(t.collect(), t.schema).coalesce(1)


@pytest.mark.parametrize("text, want", CASES)
def test_query(graph, text, want):
    got = [tuple(r) for r in sparql.query(graph, "PREFIX p: <p:>\nPREFIX t: <t:>\n" + text).collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_cartesian_product(graph):
    text = "SELECT * WHERE { { ?x <p:name> ?n } UNION { ?y <p:age> ?n } { ?x <p:knows> ?z } UNION { ?y <p:size> ?z } ?x <p:name> ?n }"
    df = sparql.query(graph, text)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan  # rows that would pair with all are looked for, one from each side


def test_unbound_on_both_sides(graph):
    text = "SELECT ?n WHERE { ?x <p:name> ?n . OPTIONAL { ?x <p:age> ?a } OPTIONAL { ?u <p:nick> ?a } }"
    assert {r.n for r in sparql.query(graph, text).collect()} == {"anna", "bert", "carl"}
    with pytest.raises(Exception, match="share no bound variable"):
        sparql.query(graph, "SELECT * WHERE { ?x <p:name> ?n . OPTIONAL { ?x <p:age> ?a } { SELECT ?a ?k WHERE { ?k <p:knows> ?l OPTIONAL { ?l <p:nick> ?a } } } }").collect()


def test_bound(graph):
    assert [r.n for r in sparql.query(graph, "SELECT ?x ?n WHERE { ?x <p:name> ?n }", {"x": "n:b"}).collect()] == ["bert"]


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x <p:a> ?y . ?u <p:b> ?v }", "SELECT ?x WHERE { BIND(?y AS ?x) ?x <p:a> ?z }", "SELECT ?x WHERE { ?x <p:a>/ ?y }", "SELECT ?x", "ASK { ?x <p:a> ?y }", "SELECT ?x WHERE { ?x no:p ?y }"])
def test_errors(graph, text):
    with pytest.raises(ValueError):
        sparql.query(graph, text)
