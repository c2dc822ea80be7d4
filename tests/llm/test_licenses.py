"""The license scan against a plain one."""

import random

import pytest

import brute
from brute import ODD_TEXTS, SF
from newsflow.llm import op11_licenses as op

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BY_NAME = {t.name: t for t in op.TEMPLATES}


def base(text):
    """(n_words, n_base, first, last, labels) by trying every place."""
    w = brute.words(text)
    places = [
        (i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i: i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def short_labels(text):
    """Labels of the templates that stand whole, short ones only, the longest at a place."""
    w, found = brute.words(text), []
    for t in op.NOTICES:
        v = brute.words(t.text)
        if len(v) < op.SHORT:
            found += [(len(v), i, t.label) for i in range(len(w)) if w[i: i + len(v)] == v]
    return {x for n, i, x in found if not any(m > n and j <= i and i + n <= j + m and y != x for m, j, y in found)}


def got(df):
    return {r.doc_id: r for r in df.collect()}


def test_documents(spark, texts):
    rows = got(op.op11_licenses(spark, SF))
    assert set(rows) == set(texts)
    for i, text in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        labels = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} | short_labels(text) == labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_larger_documents_by_base_counts(spark):
    sf = SF.replace("0.001", "0.01")
    rows = got(op.op11_licenses(spark, sf))
    for x in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = rows[x.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(x.text)


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zzz"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    noise = " ".join(rng.choice(["alpha", "of", "the", "rights", "software", "license", "public", "general"]) for _ in range(400))
    long = [t for t in op.NOTICES if t.name.startswith("text:")]
    rows, want = [], {}
    for n, t in enumerate(long):
        half = t.text.split()
        cases = {
            0: t.text, 1: f"{noise} {t.text} {noise}", 2: changed(rng, t.text, len(half) // 12),
            3: " ".join([*half[: len(half) // 2], "one", "two", *half[len(half) // 2:]]), 4: f"{noise} {' '.join(half[: len(half) // 3])}"}
        for c, text in cases.items():
            rows.append((10 * n + c, text))
            want[10 * n + c] = t.label if c < 4 else None
    return rows, want


def test_copies_with_changes(spark, planted):
    rows, want = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in op.scanned(docs).collect()}
    for i, label in want.items():
        found = {x.label for x in spans[i] if not BY_NAME[x.template].base and x.template.startswith("text:")}
        assert found == ({label} if label else set()), (i, found)
    assert {i: len(s) for i, s in spans.items()} == {r.doc_id: len(r.spans) for r in op.scanned(docs.repartition(11)).collect()}


def test_odd_rows(spark, odd):
    extra = spark.createDataFrame(
        [(50, "MIT License mit-license MIT\nLICENSE general public public license", "a"), (None, "Apache License", "b"), (51, "license mit", "c"),
         (52, "mit license " * 5000, "d"), (53, "licensed under cc by-nc 4.0.", "e"), (53, "licensed under cc by-nc-sa 4.0", "f")],
        "doc_id long, text string, template string")
    rows = [*ODD_TEXTS]
    out = op.scanned(odd).collect()
    assert len(out) == odd.count() and sum(len(r.spans) for r in out) == 0
    assert sorted(r.n_words for r in out) == sorted([*map(len, map(brute.words, rows)), len(brute.words(rows[-1]))])
    assert op.scanned(odd.limit(0)).count() == 0
    by = {}
    for r in op.scanned(extra).collect():
        by.setdefault(r.doc_id, []).append([(x.template, x.start) for x in r.spans])
    assert by[50] == [[("phrase: mit", 0), ("phrase: mit", 2), ("phrase: mit", 4)]] and by[None] == [[("phrase: apache", 0)]]
    assert by[51] == [[]] and len(by[52][0]) == 5000
    assert sorted(by[53]) == [[], [("notice: cc by-nc", 0)]]


def test_longest_common_part():
    a, b = [b"a", b"b", b"c", b"d", b"e"], [b"a", b"x", b"c", b"e", b"d"]
    assert op.common(a, b, 5) == 3 and op.common(a, a, 1) == 5 and op.common(a, [], 2) == 0 and op.common([], b, 2) == 0
