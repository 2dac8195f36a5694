"""A remote query service: rows of a SELECT query by HTTP, page by page, fetched by the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.sources.triples import COLUMNS, SCHEMA

#: Solutions asked for at once.
PAGE = 10_000
_KINDS = {"uri": "iri", "bnode": "bnode", "literal": "literal", "typed-literal": "literal"}
Fetch = Callable[[str, str], dict]


def fetch(url: str, query: str) -> dict:
    """The service's answer to a query, in the SPARQL results format (JSON)."""
    request = Request(url, urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"})
    with urlopen(request, timeout=600) as answer:
        return json.load(answer)


def _solutions(get: Fetch, url: str, query: str) -> list[dict]:
    return get(url, query)["results"]["bindings"]


def _paged(query: str, variables: list[str], page: int, size: int) -> str:
    """One page of a query, in an order that is the same for all pages."""
    order = " ".join(f"?{v}" for v in variables)
    return f"SELECT {order} WHERE {{ {{ {query} }} }} ORDER BY {order} LIMIT {size} OFFSET {page * size}"


def _pages(batches: Iterator[pa.RecordBatch], get: Fetch, url: str, query: str, variables: list[str], size: int, as_triples: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page in batch.column(0).to_pylist():
            found = _solutions(get, url, _paged(query, variables, page, size))
            if as_triples:
                value = lambda x, v: x[v]["value"] if x[v]["type"] != "bnode" else f"_:{x[v]['value']}"
                rows = [(value(x, "s"), value(x, "p"), value(x, "o"), _KINDS[x["o"]["type"]], x["o"].get("datatype"), x["o"].get("xml:lang"), None) for x in found]
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(7)], names=COLUMNS)
            else:
                yield pa.record_batch([pa.array([x.get(v, {}).get("value") for x in found], pa.string()) for v in variables], names=variables)


def select(spark: SparkSession, url: str, query: str, variables: list[str], get: Fetch = fetch, size: int = PAGE, as_triples: bool = False) -> DataFrame:
    """Rows of a SELECT query (without prefixes of its own), a column a variable.

    The number of solutions is asked first; each page is a task's own request, so a lost executor
    only asks again.
    """
    total = int(_solutions(get, url, f"SELECT (COUNT(*) AS ?n) WHERE {{ {{ {query} }} }}")[0]["n"]["value"])
    pages = -(-total // size)
    schema = SCHEMA if as_triples else ", ".join(f"`{v}` string" for v in variables)
    numbers = spark.range(0, pages, 1, max(1, pages))
    return numbers.mapInArrow(partial(_pages, get=get, url=url, query=query, variables=variables, size=size, as_triples=as_triples), schema)


def triples(spark: SparkSession, url: str, get: Fetch = fetch, size: int = PAGE) -> DataFrame:
    """All triples a service holds."""
    return select(spark, url, "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", ["s", "p", "o"], get, size, True)
