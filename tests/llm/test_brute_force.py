"""Operators against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import itertools
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import fingerprints, html_extract, license_scan, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, toxicity

WORDS = [f"w{i}" for i in range(500)]
SPACE = " \t\n\x0b\x0c\r"


def _words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def _shingles(text):
    w = _words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _corpus():
    rng = random.Random(8)
    texts = [None, "", " \n", "one", "one two three", "é ü\tß"]
    for k in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([30, 80, 200]))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 6, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "x"
            texts.append("  ".join(w) if k % 2 else " ".join(w))
    texts += ["again and again this " * 50, "again and again this " * 50 + "end", " ".join(rng.choice(WORDS) for _ in range(30000))]
    rows = [(i, t, None if i % 7 == 0 else "abc"[i % 3], "en" if i % 2 else None, 3, 7) for i, t in enumerate(texts)]
    return [*rows, (None, texts[6], "a", "en", 3, 7), (9, texts[9], "a", "en", 3, 7), (10, "another text for this id " * 9, "a", "en", 3, 7)]


ROWS = _corpus()
#: Columns whose names clash with those of the operators.
SCHEMA = "doc_id long, text string, source string, lang string, _size long, copies long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def _sketch(text):
    w, out = _words(text), set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.add(h >> 16)
    found = sorted(out)
    return [h for k, h in enumerate(found) if h < (1 << 48) // fingerprints.SCALE or k < fingerprints.LEAST]


def _likeness(a, b):
    if not a or not b:
        return float(a == b)
    tops = [1 << 48 if len(s) < 64 else max((1 << 48) // 8 - 1, s[-1]) if len(s) == 64 else (1 << 48) // 8 - 1 for s in (a, b)]
    x, y = ({h for h in s if h <= min(tops)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_fingerprints(docs):
    import hashlib

    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    shown = lambda s: "".join(f"{h:012X}" for h in s)
    for k, row in enumerate(order):
        if row[0] in (9, 10) or order[(k + 1) % len(order)][0] in (9, 10):
            continue  # repeated ids have no one next
        (r,) = got[row[0]]
        text, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = _sketch(text), _sketch(edited), _sketch(after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(a), shown(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(_likeness(a, b)), pytest.approx(_likeness(a, c)))


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(3)
    long, short = [rng.choice(WORDS) + str(rng.random()) for _ in range(20000)], []
    short = long[4000:6000]
    rows = spark.createDataFrame([(" ".join(long), " ".join(short))], "a string, b string").select(fingerprints.word_list(F.col("a")).alias("a"), fingerprints.word_list(F.col("b")).alias("b"))
    rows = rows.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    inside, around, same = rows.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.merged(F.col("a"), F.col("b")) == F.col("a")).first()
    assert inside == 1.0 and abs(around - 0.1) < 0.03 and same


def _similarity(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    wa, wb = ({s: 1 + math.log(n) for s, n in x.items()} for x in (a, b))
    total = sum(1 / sum(max(wa.get(z, 0) / wa[s], wb.get(z, 0) / wb[s]) for z in wa.keys() | wb.keys()) for s in wa.keys() & wb.keys())
    return max(plain, total)


def test_near_dedup_against_all_pairs(docs):
    import hashlib

    one = {}
    for r in ROWS:
        if r[0] is not None and len(_words(r[1])) < 5000:
            key = hashlib.md5((r[1] if _words(r[1]) else "").encode()).hexdigest()
            one[r[0]] = min(one.get(r[0], (key, r[1])), (key, r[1]))
    sets = {i: _shingles(t) for i, (_, t) in one.items()}
    of = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        if of[i] != of[j] and _similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((of[i], of[j]))
            of = {k: a if v == b else v for k, v in of.items()}
    got = near_dedup.digest(docs).collect()
    assert len(got) == len(ROWS) and [r.class_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.class_id for r in got if r.doc_id in of} == of


def test_probability_jaccard_is_estimated():
    import numpy as np

    from kinweave.llm.textbatch import Texts

    rng = random.Random(4)
    a = [rng.choice(WORDS[:60]) for _ in range(300)]
    b = a[:250] + [rng.choice(WORDS[:60]) for _ in range(50)]
    h, o, t = near_dedup.weighted_shingles(Texts.of([" ".join(a), " ".join(b)]), 2)
    sig = near_dedup.signatures(h, o, 1 + np.log(t), 2, 4000)
    wa, wb = (Counter(zip(x, x[1:])) for x in (a, b))
    wa, wb = ({s: 1 + math.log(n) for s, n in x.items()} for x in (wa, wb))
    want = sum(1 / sum(max(wa.get(z, 0) / wa[s], wb.get(z, 0) / wb[s]) for z in wa.keys() | wb.keys()) for s in wa.keys() & wb.keys())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_pairs_at_the_threshold_are_banded():
    p = near_dedup.THRESHOLD**near_dedup.ROWS
    assert 1 - (1 - p) ** near_dedup.BANDS > 0.9999


LICENCES = [
    "Licensed under CC BY-SA 4.0.", "licensed under CC BY-ND 4.0", "Lisensed under CC BY-NC 4.0", "small rights reserved", "All rights resrved", "released under the NIT license", "Released under the MIT licence",
    "GNU General Public License and the MIT License, MIT license", "gnu lesser general public license", None, "", "ccc by", "cc by", "cc. by!", "Apache License Apache license",
]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_scan_against_brute_force(spark):
    rng = random.Random(9)
    texts = list(LICENCES)
    for notice in license_scan.NOTICES:
        for edits in range(4):
            chars = list(notice)
            for _ in range(edits):
                chars[rng.randrange(len(chars))] = rng.choice("abe ")
            texts.append(f"Some {rng.choice(WORDS)} before, {''.join(chars).upper()}: and {rng.choice(WORDS)} after.")
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[0], 0)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id or 0] or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in low).split(" ")
        words = [w for w in words if w]
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        near = {}  # label: the least edits of a span of whole words that may carry it
        for notice, (label, own) in license_scan.NOTICES.items():
            n, most = notice.count(" ") + 1, len(notice) // license_scan.CHARS_PER_ERROR
            for i in range(len(words)):
                for j in range(max(i + 1, i + n - 3), min(len(words), i + n + 3) + 1):
                    span = " ".join(words[i:j])
                    if f" {own} " in f" {span} " and (d := _edits(span, notice)) <= most:
                        near[label] = min(near.get(label, 99), d)
        found = set(r.labels.split(",")) - {""}
        assert {x for _, x in places} <= found <= {x for _, x in places} | set(near)
        assert bool(found) == bool(places or near), text
        if near:  # what needs the fewest edits is there
            assert found & {k for k, d in near.items() if d == min(near.values())}, (text, near, found)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(found)


def test_license_scan_of_long_texts():
    import time

    scan, base = license_scan.Scanner().scan, b"some words licensed under cc by more mit license "
    took = []
    for n in (2000, 8000):
        start = time.perf_counter()
        assert scan(base * n)[1] == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.5


def _best_flow(supply, quota, copies):
    """(words, cost) of the best flow by trying every amount on every arc."""
    arcs = [(p, s) for p, (_, members) in supply.items() for s in members]
    best = (0, 0)
    for amounts in itertools.product(*(range(copies * supply[p][0] + 1) for p, _ in arcs)):
        taken = {p: sum(x for (q, _), x in zip(arcs, amounts) if q == p) for p in supply}
        if all(taken[p] <= copies * supply[p][0] for p in supply) and all(sum(x for (_, t), x in zip(arcs, amounts) if t == s) <= quota[s] for s in quota):
            cost = sum(max(0, min(taken[p] - k * supply[p][0], supply[p][0])) * k for p in supply for k in range(copies))
            best = max(best, (sum(amounts), -cost))
    return best[0], -best[1]


def test_flow_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        supply = {p: (rng.randint(0, 3), rng.sample("xyz", k)) for p, k in (("a", 1), ("b", 2), ("c", rng.randint(1, 2)))}
        quota = {s: rng.randint(0, 5) for s in "xyz"}
        flow = mixing.min_cost_flow(supply, quota, 2)
        cost = sum(max(0, flow[p] - supply[p][0]) for p in supply)
        assert (sum(flow.values()), cost) == _best_flow(supply, quota, 2)
        assert all(flow[p] <= 2 * supply[p][0] for p in supply)


def _mixed_by_hand(rows, patterns, order, copies=2):
    """How often each document is taken, from the flow's words per pattern."""
    out = {}
    for p, words in patterns.items():
        mine = sorted((r for r in rows if r[1] == p), key=lambda r: order[r[0]])
        total = sum(r[2] for r in mine)
        whole_copies, rest = divmod(words, total) if total else (0, 0)
        seen = 0
        for r in mine:
            seen += r[2]
            out[r[0]] = whole_copies + (rest > 0 and seen - r[2] / 2 <= rest)
    return out


def test_overlapping_mix(spark, docs, monkeypatch):
    import hashlib
    import json

    plain = spark.createDataFrame([r for r in ROWS if r[0] is not None][:80], SCHEMA)
    sources = F.array_compact(F.array("source", "lang"))
    rows = [(r[0], json.dumps(sorted({x for x in (r[2], r[3]) if x}), separators=(",", ":")), len(_words(r[1]))) for r in ROWS if r[0] is not None][:80]
    order = {r[0]: hashlib.md5(f"{mixing.SEED}:{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest() for r in ROWS if r[0] is not None}
    words = Counter()
    for _, p, n in rows:
        words[p] += n
    size = Counter()
    for p, n in words.items():
        for s in json.loads(p):
            size[s] += n
    names = sorted(size)
    targets = dict(zip(names, mixing.by_weight([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(words.values()), 2)))
    flow = mixing.min_cost_flow({p: (n, [json.dumps(s) for s in json.loads(p)]) for p, n in words.items()}, {json.dumps(s): int(t) for s, t in targets.items()}, 2)
    want = _mixed_by_hand(rows, flow, order)
    assert {r.doc_id: r.taken for r in mixing.overlapping(plain, sources).collect()} == {i: want[i] * n for i, _, n in rows}
    monkeypatch.setattr(mixing, "MOST_IN_CELL", 1)
    monkeypatch.setattr(mixing, "CELL_DIGITS", 1)
    assert {r.doc_id: r.taken for r in mixing.overlapping(plain, sources).collect()} == {i: want[i] * n for i, _, n in rows}
    assert mixing.mixed(docs).columns == docs.columns


PAGES = {
    "<html><head><title>x</title><p>{long}": "{long}",
    "<html><head><title>x</title>Bare words <b>here</b> and on and on for a while, long enough to be a text of its own<p>{long}": "Bare words here and on and on for a while, long enough to be a text of its own\n\n{long}",
    '<nav><a href=1>menu</a></nav><div class="content with-sidebar"><p>{long}</p><p>Short one here.</p><p>{long}</div><div class=sidebar>links here</div>': "{long}\n\nShort one here.\n\n{long}",
    '<div id="search-page"><article><p>{long}</article></div>': "{long}",
    '<div class=sidebar-wrap><p>{long}<p>{long}</div>': "{long}\n\n{long}",
    '<article><p>{long}<p class="notice">{long}<p>{long}<div class="ad">Buy this now today</div><p>End.</p></article><div class=comments><article><p>I think this is bad</article></div>': "{long}\n\n{long}\n\n{long}\n\nEnd.",
    '<article><p>{long}</p><div class="comments"><p>{long}</p></div></article>': "{long}",
    '<form><div><p>{long}</p><p>{long}</div><input name=x></form>': "{long}\n\n{long}",
    "<video><p>{long}": "{long}",
    "<p>{long}</p><p>tiny</p><p>{long}</p>": "{long}\n\ntiny\n\n{long}",
    '<article><p style="display: none">{long}</p><p>a &lt; b &#8212;  c</p></article><script>"</article>"</script>': "a < b — c",
    "": "",
    "<p>": "",
    "</div></p></x>": "",
}


def test_pages(spark):
    long = "word " * 39 + "end"
    rows = [(i, f"u{i}", p.replace("{long}", long), 1) for i, p in enumerate(PAGES)] + [(99, None, None, 1), (None, "u", "<p>" + long, 1), (0, "u0", "<p>" + long, 1)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string, text int")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    wants = [w.replace("{long}", long) for w in PAGES.values()]
    for r in got:
        assert r.n_chars == len(r.text)
        if r.url == f"u{r.page_id}" and not (r.page_id == 0 and r.text == long and wants[0] != long):
            assert r.text == wants[r.page_id], rows[r.page_id][2].replace(long, "{long}")
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_cut_decides():
    page = "<p>" + "word " * 30 + "</p><p>tiny</p><p>" + "word " * 30
    evidence, edges = html_extract.network(html_extract.blocks(page))
    assert [e > 0 for e in evidence] == [True, False, True] and html_extract.minimum_cut(evidence, edges) == [True, True, True]


def test_minimum_cut_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        evidence = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 4)) for _ in range(rng.randint(0, 14))]

        def cost(labels):
            return sum((0 if x else e) if e > 0 else (-e if x else 0) for e, x in zip(evidence, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: B023

        assert cost(html_extract.minimum_cut(evidence, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


def test_long_pages():
    import time

    took = []
    for n in (1000, 8000):
        page = "".join(f"<div><p>{'word ' * (i % 25)}end</p><a href=x>link {i}</a></div>" for i in range(n))
        start = time.perf_counter()
        assert html_extract.extract("<p>" + "word " * 40 + page)
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 0.5


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_of_odd_tables(spark, module, column):
    rng = random.Random(6)
    rows = [(i, ("bad " if i % 4 == 0 else "good ") + " ".join(rng.choice(WORDS) for _ in range(40)) + (" ### !!" * 20 if i % 4 == 0 else ""), 1, True) for i in range(300)]
    rows += [(300, None, 1, True), (301, "", 1, True), (None, "bad " * 50, 1, True), (5, rows[5][1], 1, True), (6, "bad " * 200_000, 1, True)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0) if column == "quality" else int(i % 4 == 0)) for i in range(302)] + [(7, 0), (7, 0), (None, 1), (8, None), (11, 5)], f"doc_id int, {column} int")
    for kind in ("int", "long"):
        out = module.digest(spark.createDataFrame(rows, f"doc_id {kind}, text string, score int, held_out boolean"), labels).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 5}) == 1 and len({r.score for r in out if r.doc_id in (300, 301)}) == 1
        assert not [r for r in out if r.doc_id is None and r.held_out]
    assert module.digest(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_sampled_features_go_to_few_files(spark, monkeypatch):
    rows = [(i, ("scum " if i % 4 == 0 else "") + f"words of text {i} " + WORDS[i % 50]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    found, files = [], []
    keep = toxicity.kept

    def counted(df, name):
        out = keep(df, name)
        files.append(len(out.inputFiles()))
        found.append(sorted((r.doc_id, r.label, bytes(r.x)) for r in out.collect()))
        return out

    monkeypatch.setattr(toxicity, "kept", counted)
    settings = {"spark.sql.shuffle.partitions": ("2", "60"), "spark.sql.adaptive.coalescePartitions.enabled": ("true", "false")}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        models = []
        for run in range(2):
            for k, v in settings.items():
                spark.conf.set(k, v[run])
            models.append(toxicity.train(docs, labels))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files) <= toxicity.FILES < 60
    assert found[0] == found[1] and len(found[0]) > 250
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(*models))


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, "same words in all texts " + WORDS[i % 50]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import zlib

    flip = lambda i: i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2
    for module, column in ((toxicity, "toxic"), (quality_classifier, "quality")):
        a, b = (spark.createDataFrame([(i, f(i)) for i in range(200)], f"doc_id long, {column} int") for f in (lambda i: i % 2, flip))
        assert sorted(module.digest(docs, a).collect()) == sorted(module.digest(docs, b).collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, docs, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, "")
    assert stage == 4 or out.columns == docs.columns
    assert out.count() <= 2 * len(ROWS)
    empty = run(spark, spark.createDataFrame([], SCHEMA), "")
    assert empty.columns == out.columns and empty.count() == 0


def test_long_repetitive_text(spark):
    text = "one two three four " * 40_000
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 160_000 and row.base_failed and not row.kept
    out = suffix_dedup.digest(spark.createDataFrame([(1, text), (2, text + "x")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: len(text)}


def _removed(rows, length=50):
    first, out = {}, {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(raw):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out[i] = sum(gone)
    return out


def test_hot_anchors(spark, monkeypatch):
    """Many different texts around one passage, some alike beyond it; groups of stretches that go on from batch to batch."""
    rng = random.Random(11)
    passage = "a passage that stands in every text of all "
    ends = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(12)]
    rows = [(i, f"{rng.choice(ends)} {rng.choice(ends)[:25]}{passage}{rng.choice(ends)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digest(docs).collect()} == _removed(rows)


def test_shares_of_a_bucket_give_all_pairs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, m = 60, 16
    sig = rng.integers(0, 2, (n, m)).astype(np.uint8)
    parts = rng.choice([1, 1, 1, 2, 3, 4], n)
    whole = {(i, j) for i in range(n) for j in range(i + 1, n) if parts[i] != parts[j] and (sig[i] == sig[j]).mean() >= 0.7}
    assert whole
    for shares in (1, 4):
        rows = [(7, s, i, int(parts[i]), bool(parts[i] != 1), sig[i].tobytes(), [7, i]) for i in range(n) for s in (range(shares) if parts[i] != 1 else [i % shares])]
        rows.sort()
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())))], names=list("abcdefg"))
        found = [p for b in near_dedup._across(iter([batch.slice(0, 33), batch.slice(33)]), m, 0.7) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert set(found) == whole
