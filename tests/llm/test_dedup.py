"""Near-duplicate classes and repeated passages against plain versions."""

import random

import numpy as np

import brute
from brute import ODD_TEXTS, SF
from newsflow.llm import op2_substring, op6_neardup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def class_ids(rows):
    return {r.doc_id: r.class_id for r in rows}


def test_near_classes_of_the_documents(spark, texts):
    got = op6_neardup.op6_near_dedup(spark, SF).collect()
    assert len(got) == len(texts) and class_ids(got) == brute.near_classes(texts)
    assert {r.doc_id for r in got if r.first} == set(class_ids(got).values())


def test_near_classes_of_a_large_group(spark):
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [(i, edited(rng, base, 1 + i % 3)) for i in range(300)]  # one group
    rows += [(1000 + i, prose(rng, 60)) for i in range(50)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)]
    rows += [(3000 + i, prose(rng, 150) + " " + base[:300]) for i in range(40)]  # a shared passage
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_ids(op6_neardup.classes(docs).collect())
    assert {got[i] for i in [*range(300), *range(2000, 2040)]} == {0}
    assert all(got[i] == i for i in [*range(1000, 1050), *range(3000, 3040)])
    assert got == class_ids(op6_neardup.classes(docs.repartition(13)).collect())


def test_near_classes_of_versions_around_hubs(spark):
    """Versions drift away from a text with many near copies: some are similar to versions alone."""
    rng = random.Random(9)
    rows = []
    for hub in range(40):
        base = prose(rng, 150)
        rows += [(100 * hub + i, edited(rng, base, 1)) for i in range(8)]
        version = base
        for i in range(6):
            version = edited(rng, version, 2)
            rows.append((100 * hub + 10 + i, version))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert class_ids(op6_neardup.classes(docs).collect()) == brute.near_classes(dict(rows))


def test_near_pairs_of_a_large_bucket_are_whole(spark, monkeypatch):
    """All texts share one bucket, and hundreds are not similar to the leader: no similar pair of different classes is left out."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [edited(rng, base, 1) for _ in range(30)]
    for i in range(60):  # versions away from the base, each with one near copy
        version = edited(rng, base, 8)
        texts += [version, edited(rng, version, 1)]
    texts += [prose(rng, 40) for _ in range(5)]
    nodes = list(enumerate(texts))
    words = op6_neardup._words(spark.createDataFrame(nodes, "node long, text string"))
    members = spark.createDataFrame([(1, i, i < 30) for i, _ in nodes], "key long, node long, ok boolean")
    monkeypatch.setattr(op6_neardup, "BLOCK", 4000)  # several blocks
    got = op6_neardup.verified(op6_neardup._across_blocks(members, words), words).collect()
    every = spark.createDataFrame([(i, j) for i, _ in nodes for j, _ in nodes if i < j and j >= 30], "a long, b long")
    want = {(r.a, r.b) for r in op6_neardup.verified(every, words).collect()}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50


def test_near_classes_of_odd_rows(odd):
    got = op6_neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = class_ids(got)
    assert by[0] == 0 and by[1] == by[2] == 1 and by[8] == by[9] == 8 and by[12] == by[13] == 12
    kept = op6_neardup.keep_first(odd)
    assert kept.columns == odd.columns
    # one of each: null, empty, white space, dots, one, ONE two, two lines, long, Japanese, odd signs, six words
    assert kept.count() == 11
    assert op6_neardup.classes(odd.limit(0)).count() == 0


def test_alignment_is_the_longest_chain():
    a = np.arange(1, 101, dtype=np.uint64)
    assert op6_neardup.aligned(a, a) == 100
    b = np.concatenate([a[:50], a[55:], a[50:55]])
    assert op6_neardup.aligned(a, b) == 95
    assert op6_neardup.aligned(a, a[::-1].copy()) == 1
    assert op6_neardup.aligned(a, a[:70]) == 0  # too short to be similar


def sentences(rng, n):
    return ". ".join(prose(rng, rng.randint(4, 9)).capitalize() for _ in range(n)) + "."


def test_repeated_passages_stay_once(spark):
    rng = random.Random(9)
    passages = [sentences(rng, 10) for _ in range(3)] + [prose(rng, 60).capitalize() + "."]
    rows = []
    for i in range(60):
        parts = [sentences(rng, 6), sentences(rng, 5)]
        if i % 2:
            parts.insert(1, passages[i % 4])
        rows.append((i, rng.choice(["\n", " "]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op2_substring.deduplicated(docs).toDF("doc_id", "text", "first_ids", "n_sentences", "n_removed").collect()}
    seen = set()
    for i, text in rows:
        mine = passages[i % 4] if i % 2 else None
        if mine is None or mine not in seen:
            assert got[i].text == text and got[i].n_removed == 0
            seen.add(mine)
        else:
            assert mine not in got[i].text and got[i].first_ids
            before, after = text.split(mine)
            assert got[i].text.split() == (before + after).split()


def test_passages_spliced_after_any_word_go_whole(spark):
    rng = random.Random(12)
    kinds = [prose(rng, 51), sentences(rng, 12), prose(rng, 70).capitalize() + ".", f"{prose(rng, 30)}. {prose(rng, 25)}"]
    rows, want = [], {}
    for i in range(80):
        p = kinds[i % 4]
        w = (sentences(rng, 8) if i % 3 else prose(rng, 60)).split()
        k = rng.randrange(len(w) + 1)
        rows.append((i, " ".join([*w[:k], p, *w[k:]])))
        want[i] = rows[-1][1].split() if i < 4 else w
    twice = prose(rng, 55)
    rows.append((80, f"{prose(rng, 7)} {twice} {prose(rng, 9)} {twice} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in op2_substring.remove_repeats(docs).collect()}
    assert all(got[i] == want[i] for i in want)
    left = " ".join(got[80])
    assert left.count(twice) == 1 and left.split() == [*rows[-1][1].split()[: 7 + 55 + 9], "end"]


def test_repeats_inside_one_text(spark):
    rng = random.Random(2)
    p = sentences(rng, 8)
    docs = spark.createDataFrame([(1, f"{p}\n{p}\n{p}")], "doc_id long, text string")
    assert op2_substring.remove_repeats(docs).first().text.strip() == p


def test_repeats_of_odd_rows(odd):
    got = op2_substring.remove_repeats(odd)
    assert got.columns == odd.columns
    rows = {r.shard: r for r in got.collect()}
    assert got.count() == odd.count()
    for i, t in enumerate(ODD_TEXTS):
        r = rows[f"row{i}"]
        if i not in (8, 9):  # the long texts repeat themselves and each other
            assert r.text == t and r.n_chars == (None if t is None else len(t))
    assert len(rows["row8"].text) < 1000 and rows["row9"].text == ""
    assert op2_substring.remove_repeats(odd.limit(0)).count() == 0


def test_shingle_similarity_matches_brute_force(texts):
    sets = brute.shingle_sets(texts)
    assert all(sets.values())
