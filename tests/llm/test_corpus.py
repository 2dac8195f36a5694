"""The corpus operators against brute force, on small tables with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from kinweave.llm import byte_bpe, fingerprints, html_extract, license_scan, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, textbatch, toxicity
from kinweave.llm.suffix_array import suffix_array

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def _text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _made():
    base = _text(120)
    near = base.split()
    near[60] = "changed"
    shared = _text(40)
    texts = [base, base, " ".join(near), _text(80) + " " + shared, shared + " " + _text(90), None, "", "one two", "For " * 300, "é" * 70 + " ü", "a\nb\n\na\n", _text(3000)]
    return [(i, t, None if i == 3 else f"s{i % 3}", "en", 0, 7) for i, t in enumerate(texts)] + [(None, base, "s1", "en", 0, 7), (4, texts[4], "s1", "en", 0, 7)]


ROWS = _made()


def _rows():
    return ROWS


SCHEMA = "doc_id long, text string, source string, lang string, n_words long, _key long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(2000):
        s = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40)))
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs).collect())
    rows = [(r[0], (r[1] or "").encode()) for r in _rows()]
    first = {}
    for i, b in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    assert got == sorted(want)


def test_fingerprints(docs):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(_rows())
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(_rows()[r.doc_id][1] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    last = next(r for r in got if r.doc_id is None)
    text, after = _rows()[12][1], _rows()[11][1]  # after the last comes the first, the largest id
    n = len(text) // 3
    assert last.edited_sha256 == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[0].kept and not got[8].kept and got[8].base_failed and not got[5].kept
    assert got[10].n_dup_lines == 1 and got[9].word_chars == 71 and got[8].longest_repeat == 299
    assert set(quality_rules.kept_documents(docs).columns) == set(docs.columns)


def test_longest_repeats_by_brute_force():
    import numpy as np

    from kinweave.llm.textbatch import Texts

    rng = random.Random(2)
    for _ in range(60):
        t = Texts.of([" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(4)])
        w = t.words()
        h = t.range_hash(w.starts, w.ends)
        got = quality_rules.longest_repeats(h, w, 2)
        for d in range(4):
            x = h[w.first[d] : w.first[d + 1]].tolist()
            want = [max((next((k for k in range(len(x)) if i + k >= len(x) or j + k >= len(x) or x[i + k] != x[j + k]), 0) for j in range(len(x)) if j != i), default=0) for i in range(len(x))]
            assert got[w.first[d] : w.first[d + 1]].tolist() == np.where(np.array(want, int) < 2, 0, want).tolist()


def test_byte_bpe(docs):
    import public_tokenizers
    import tiktoken

    machine, decoder, _ = byte_bpe.coder(None, byte_bpe.VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(500):
        s = "".join(rng.choice("ab  \n\t.,éß漢🙂thein123's") for _ in range(rng.randint(0, 40)))
        ids = machine.encode(s)
        assert ids == known.encode_ordinary(s) and decoder.tokens(ids) + decoder.end() == s
    assert decoder.feed(b"\xe6\xbc") + decoder.feed(b"a") + decoder.end() == "�a"
    by_id = {r.doc_id: r for r in byte_bpe.digest(docs).collect()}
    assert by_id[5].n_tokens == 0 and by_id[9].decoded_sha256 == hashlib.sha256(_rows()[9][1].encode()).hexdigest()
    small = byte_bpe.Transducer(machine.ranks, public_tokenizers.PATTERN, most_states=20, most_pieces=5)
    text = _text(50) + " " + "ab" * 400
    assert small.encode(text) == known.encode_ordinary(text)


def test_byte_bpe_memory():
    """The pipeline's executors hold earlier stages' heap, so the tables must be small for what they hold."""
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(4, 9))) for _ in range(200)) for _ in range(60)]
    machine = byte_bpe.Transducer(ranks, public_tokenizers.PATTERN)
    textbatch._power_table(3, 10)
    textbatch.let_go()
    assert not textbatch._powers
    tracemalloc.start()
    try:
        for text in texts:
            assert machine.encode(text) == known.encode_ordinary(text)
        held = tracemalloc.get_traced_memory()[0] / len(machine.keys)
    finally:
        tracemalloc.stop()
    assert held < 480  # 571 when silent steps and pieces met once were kept
    met_once = len(machine.pieces)
    assert met_once < 0.2 * 60 * 200
    for _ in range(2):  # from the cache, too
        assert [machine.encode(t) for t in texts] == [known.encode_ordinary(t) for t in texts]
    assert len(machine.pieces) > met_once
    assert all(step > byte_bpe._MASK for step in machine.steps.values())


def test_near_dedup(docs):
    got = {r.doc_id: r.class_id for r in near_dedup.digest(docs).collect()}
    assert (got[1], got[2], got[3], got[4], got[None]) == (0, 0, 3, 4, None)
    assert got[6] == 5  # texts without a word are copies
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and {1, 2}.isdisjoint(r.doc_id for r in kept.collect())


def test_license_scan():
    scan = license_scan.Scanner().scan
    assert scan(b"Licensed under the Apache License, Version 2.0.")[1:6] == (1, 3, 3, "apache", "apache")
    assert scan(b"This work is licenced under the GNU Genral Public License, verson 3.")[4:6] == ("", "gpl")
    assert scan(b"")[:7] == (0, 0, None, None, "", "", 0.0)


def test_mixing(docs):
    got = mixing.digest(docs).collect()
    assert len(got) == len(_rows()) and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) > 0
    flow = mixing.min_cost_flow({"a": (10, ["x"]), "ab": (10, ["x", "y"])}, {"x": 10, "y": 15}, 2)
    assert flow == {"a": 10, "ab": 15}
    assert mixing.by_weight([10, 100], [3, 1], 60, 2) == [20.0, 40.0]


def test_classifiers(spark):
    rng = random.Random(6)
    rows = [(i, _text(60, rng) + (" scum" if i % 4 == 0 else "") if i % 3 else "### $$ " * 40 + ("scum" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, "toxic"), (quality_classifier, "quality")):
        out = module.digest(d, labels).join(labels, "doc_id").filter("held_out")
        assert out.filter(F.col("predicted") == F.col(column)).count() >= 0.95 * out.count()
        assert module.digest(d, labels.limit(0)).count() == 400


def test_html_extract():
    page = '<nav><a href=1>Menu</a></nav><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\nline<br>two<p>Second &lt;p&gt;</article><div class="comments"><p>I disagree with all of it.</p></div><script>var a="</p>"</script><foot'
    assert html_extract.extract(page) == "Title & more\n\nFirst bold line two\n\nSecond <p>"
    assert html_extract.extract(None) == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.minimum_cut([3.0, -1.0, -3.0], [(0, 1, 2.0), (1, 2, 0.5)]) == [True, True, False]


@pytest.mark.parametrize("run", [fingerprints.fingerprints, suffix_dedup.digest, quality_rules.judge, byte_bpe.digest, license_scan.digest, near_dedup.digest, mixing.digest, mixing.mixed], ids=lambda f: f"{f.__module__}.{f.__name__}")
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs.withColumn("n_chars", F.length("text").cast("long"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, "")
        if k < 4:
            assert set(now.columns) == {*docs.columns, "n_chars"}
    assert now.count() > 0
