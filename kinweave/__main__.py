"""Command line: python -m kinweave --workdir DIR --input FILES --function within_b_m."""

from __future__ import annotations

import argparse
import getpass
import sys
import time
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import rules
from kinweave.operators import between, closure, couples, summaries, within
from kinweave.shared import kept
from kinweave.sources import certificates, csvw, endpoint, files, link_files, person_csv, query_models, rdf, sparql, triples

PROCESSES = ("within_b_m", "within_b_d", "within_m_m", "between_b_d", "between_m_m", "between_d_m", "between_b_m")
_KINDS = {"b": "births", "d": "deaths", "m": "marriages"}


def _loaded(spark: SparkSession, path: str, columns: dict | None, sep: str, pico: bool) -> DataFrame:
    if rdf.format_of(path) != "people":
        return rdf.read(spark, path)
    rows = person_csv.read(spark, path, columns, sep)
    return person_csv.pico_triples(rows) if pico else person_csv.triples(rows)


def store(spark: SparkSession, workdir: str, inputs: str = "", reload: bool = False, append: bool = False, force: bool = False, columns: dict | None = None, sep: str = ";", pico: bool = False) -> DataFrame:
    """Triples of the work folder's store; it is filled from comma-separated files if empty, or if asked to reload or append.

    A store that was filled from other inputs is used only by force. An address of a query
    service is read from there each time.
    """
    if inputs.startswith(("http://", "https://")):
        return kept(endpoint.triples(spark, inputs), "endpoint")
    at, note = f"{workdir.rstrip('/')}/store", f"{workdir.rstrip('/')}/store-inputs.txt"
    paths = sorted(p.strip() for p in inputs.split(",") if p.strip())
    known = files.read_text(spark, note).split("\n") if files.exists(spark, note) else []
    if files.children(spark, at) and not reload and not append:
        if paths and known and paths != known and not force:
            raise ValueError(f"the store was filled from {known}, not {paths}: use --reload, --append or --force")
    else:
        if not paths:
            raise ValueError("no input for the store")
        for p in paths:
            rdf.format_of(p)
        new = reduce(DataFrame.unionByName, [_loaded(spark, p, columns, sep, pico) for p in paths])
        more = append and not reload
        new.write.mode("append" if more else "overwrite").parquet(at)
        files.write_text(spark, note, "\n".join(sorted({*paths, *(known if more else ())})))
    return spark.read.parquet(at).dropDuplicates()


def data_model(spark: SparkSession, name: str) -> certificates.Model | dict[str, str]:
    """A built-in model, or one of queries from a YAML file; tells of variables its queries lack."""
    for known, model in certificates.MODELS.items():
        if name.lower() == known.lower():
            return model
    model = query_models.load(files.read_text(spark, name))
    for kind, variable in query_models.missing(model):
        print(f"the data model's {kind} lack ?{variable}", file=sys.stderr)
    return model


def records(graph: DataFrame, kind: str, model: certificates.Model | dict[str, str]) -> DataFrame:
    return query_models.certificates(graph, kind, model) if isinstance(model, dict) else certificates.certificates(graph, kind, model)


def linked(graph: DataFrame, process: str, o: argparse.Namespace, rule_set: dict | None, model: certificates.Model | dict[str, str] = certificates.Model()) -> DataFrame:
    _, a, b = process.split("_")
    a, b = (kept(records(graph, _KINDS[x], model), _KINDS[x]) for x in (a, b))
    common = {"most": o.max_lev, "fixed": o.fixed_lev, "block": not o.ignore_block, "ignore_date": o.ignore_date, "rule_set": rule_set}
    if process.startswith("between"):
        return between.between(a, b, process, **common)
    if process == couples.PROCESS and not o.ignore_relatives:
        return couples.couples(a, b, **common)
    passes = [within.within(a, b, process, g, relatives=not o.ignore_relatives, **common) for g in ("FEMALE", "MALE")]
    return passes[0].unionByName(passes[1])


def closed(spark: SparkSession, graph: DataFrame, workdir: str, namespace: str, ordered: bool, model: certificates.Model | dict[str, str] = certificates.Model()) -> DataFrame:
    """Writes person links, classes, sizes and reconstructed persons of all link files but those of within_m_m."""
    started = datetime.now().isoformat()
    found, seen = [], {}
    for n, path in enumerate(link_files.found(spark, workdir)):
        process = link_files.process_of(path)
        if process == couples.PROCESS:
            continue
        kind, *sides = process.split("_")
        make = closure.within_person_links if kind == "within" else closure.between_person_links
        for x in sides:
            if x not in seen:
                seen[x] = kept(records(graph, _KINDS[x], model), _KINDS[x])
        a, b = (seen[x] for x in sides)
        found.append(make(link_files.read_certificate_file(spark, path), a, b, link_files.short_title(process)).withColumn("seq", F.format_string("%05d %s %s", F.lit(n), F.col("a_event"), F.col("b_event"))))
    if not found:
        raise ValueError("no link files")
    links = kept(reduce(DataFrame.unionByName, found), "person-links")
    out = f"{workdir.rstrip('/')}/closure/results"
    link_files.write(link_files.as_person_file(links), f"{out}/links-individuals.csv")
    members = kept(closure.replayed_classes(links) if ordered else closure.classes(links).drop("class_id").withColumnRenamed("class_uuid", "class_id"), "classes")
    link_files.closure_terms(members).write.mode("overwrite").text(f"{out}/closureTerms.csv")
    link_files.write(closure.size_distribution(members), f"{out}/closureSizeDist.csv")
    activity, lines = closure.activity_lines(started, datetime.now().isoformat(), getpass.getuser(), namespace)
    persons = closure.reconstruction(members.withColumn("class_uuid", F.col("class_id")), namespace, activity)
    persons.unionByName(spark.createDataFrame([(x,) for x in lines], "value string")).write.mode("overwrite").text(f"{out}/dataset_reconstructed.nt")
    return members


def _options(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    p.add_argument("-f", "--function", help=f"one of {', '.join((*PROCESSES, 'closure'))}; all in sequence if left out")
    p.add_argument("-i", "--input", default="", help=f"comma-separated files ({', '.join(rdf.FORMATS)}, also with .gz), or the address of a query service")
    p.add_argument("-wd", "--workdir", required=True)
    p.add_argument("-m", "--model", default="PiCo-SDO", help=f"{', '.join(certificates.MODELS)}, or a YAML file of queries (default: PiCo-SDO)")
    p.add_argument("-ns", "--namespace", default="https://www.example.org/")
    p.add_argument("-rs", "--ruleset", help="a YAML file of rules")
    p.add_argument("--csv-map", help="a JSON file that tells what the columns of CSV inputs hold")
    p.add_argument("--delimiter", default=";", help="of CSV inputs")
    p.add_argument("--max-lev", type=int, choices=range(5), default=4)
    p.add_argument("--format", type=str.upper, choices=("CSV", "RDF"), default="CSV", help="of the links; closure reads CSV")
    p.add_argument("--query", help="a SELECT query, or a file that holds one; its rows are written to <workdir>/query")
    for name in ("reload", "append", "force", "fixed-lev", "ignore-date", "ignore-block", "ignore-relatives", "ordered-ids", "debug"):
        p.add_argument(f"--{name}", action="store_true")
    o = p.parse_args(argv)
    o.function = o.function and o.function.lower()
    if o.function and o.function not in (*PROCESSES, "closure"):
        p.error(f"unknown function {o.function}")
    return o


def _told(what: str, counts: DataFrame) -> None:
    print(what, *(f"  {r[0]}: {r[1]}" for r in counts.collect()), sep="\n", file=sys.stderr)  # a few rows


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = _options(argv)
    begun = time.time()
    spark = spark or SparkSession.builder.appName("kinweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files.make_folder(spark, o.workdir)
    columns = csvw.load(files.read_text(spark, o.csv_map)) if o.csv_map else None
    model = data_model(spark, o.model)
    graph = store(spark, o.workdir, o.input, o.reload, o.append, o.force, columns, o.delimiter, isinstance(model, certificates.PersonsInContext))
    if o.query:
        text = files.read_text(spark, o.query) if len(o.query) < 250 and "{" not in o.query and files.exists(spark, o.query) else o.query
        found = sparql.query(graph, text)
        if o.debug:
            found.explain("formatted")
        link_files.write(found, f"{o.workdir.rstrip('/')}/query")
        return
    if o.debug:
        _told("statements", triples.statement_count(graph).select(F.lit("all"), "n"))
        _told("classes", triples.class_counts(graph))
    rule_set = rules.load(files.read_text(spark, o.ruleset)) if o.ruleset else None
    for process in [o.function] if o.function else [*PROCESSES, "closure"]:
        if process == "closure":
            closed(spark, graph, o.workdir, o.namespace, o.ordered_ids, model)
            continue
        options = link_files.suffix(o.max_lev, o.fixed_lev, o.ignore_relatives, o.ignore_date, o.ignore_block)
        links, path = linked(graph, process, o, rule_set, model), link_files.place(o.workdir, process, options)
        if o.debug:
            links.explain("formatted")
        table = link_files.as_certificate_file(links)
        if o.format == "RDF":
            link_files.as_triples(table).write.mode("overwrite").text(path.removesuffix(".csv") + ".nt")
            continue
        link_files.write(table, path)
        if o.debug:
            written = link_files.read_certificate_file(spark, path)
            _told(process, summaries.link_summary(written).select(F.concat_ws(" ", *(c for c in ("family_line", "kind") if c in written.columns)), "n_links"))
    if o.debug:
        print(f"{time.time() - begun:.0f} s", file=sys.stderr)


if __name__ == "__main__":
    main()
