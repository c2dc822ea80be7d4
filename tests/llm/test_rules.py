"""Quality rules, decontamination, toxicity and language against plain versions and held-out rows."""

import zlib

import numpy as np
import pytest

import brute
from brute import LONG, ODD_TEXTS, SF
from newsflow.llm import charlm, op3_decontamination, op4_toxicity, op7_quality, op8_language


def test_base_counts(spark, texts):
    got = op7_quality.op7_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(
            texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_base_counts_of_odd_rows(odd):
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, r.base_failed) for r in op7_quality.quality(odd).collect()
                 if r.doc_id is not None)
    want = sorted((True, i, brute.base_counts(t)[0], brute.base_counts(t)[5]) for i, t in enumerate(ODD_TEXTS) if i != 3)
    assert [g[1:] for g in got] == [w[1:] for w in sorted([*want, want[-1]])]
    kept = op7_quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 0  # the long text repeats itself


def test_bands_leave_out_a_languages_junk():
    rng = np.random.default_rng(2)
    size = np.where(np.arange(2000) % 2 == 0, 400, 6400)
    clean = 1.6 + rng.normal(size=2000) * 0.9 / np.sqrt(size)
    junk = np.full(500, 1.75)  # a fifth of the language, in texts of 3,000 bytes
    loss, size = np.concatenate([clean, junk]), np.concatenate([size, np.full(500, 3000)])
    band = {"xx": op7_quality.center(loss, size, np.ones(2500, np.int64))}
    kept = op7_quality._verdict(np.full(2500, "xx", object), loss, size, np.zeros(2500, bool), band)
    assert kept[:2000].mean() > 0.995 and not kept[2000:].any()


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 1 << 24, 500))
    model = charlm.fit(code, rng.integers(1, 9, len(code)))
    for context in [int(code[0]) >> 6, int(code[7]) >> 6, 12345]:
        p = np.exp(model.log_prob((context << 6) + np.arange(64)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_counts_do_not_depend_on_partitions(docs):
    a = {r.code: r.n for r in charlm.count(docs.repartition(1)).collect()}
    b = {r.code: r.n for r in charlm.count(docs.repartition(7)).collect()}
    assert a == b and sum(a.values()) == sum(len(r.text.encode()) for r in docs.select("text").collect())


def test_quality_of_an_empty_table(docs):
    assert op7_quality.quality(docs.limit(0)).count() == 0
    assert op7_quality.keep_good(docs.limit(0)).count() == 0


def check_items(docs, texts, items, spark):
    table = spark.createDataFrame(items, "item_id long, text string")
    for r in op3_decontamination.decontaminate(docs, table).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.decontaminated(texts[r.doc_id], items)


def test_decontamination(spark, texts, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    check_items(docs, texts, items, spark)


def test_decontamination_of_odd_items(spark):
    items = [
        (10, "one"), (2, "Two  three"), (2, "two three"), (None, "ONE-two"), (5, ""), (6, None), (7, "word " * 13), (8, "word " * 20),
        (9, "日本語"), (11, "a b c d e f g h i j k l m n"),
    ]
    texts = {i: t for i, t in enumerate([*ODD_TEXTS, "one two three", "a b c d e f g h i j k l m", "x ONE! two; three"]) if t != LONG}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_items(docs, texts, items, spark)
    assert op3_decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).where(
        "contaminated or n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, texts, docs, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()][:12]
    monkeypatch.setattr(op3_decontamination, "BLOCK_BYTES", 700)
    check_items(docs, texts, items, spark)


def test_clean_rows_keep_their_columns(spark, odd):
    table = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = op3_decontamination.keep_clean(odd, table)
    assert kept.schema == odd.schema
    assert kept.count() == odd.count() - 2  # "ONE two" and "one two\nthree four"


def test_toxicity_on_held_out_rows(spark):
    rows = [
        (i, f"plain w{i} text v{i % 7} of u{i % 5} kind" + (f" vile{i % 4} snark" if i % 5 == 0 else ""), int(i % 5 == 0))
        for i in range(1500)
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in op4_toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert held and all(p == y for p, y in held)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = op4_toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = op4_toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {op4_toxicity.NO_LABEL}


def test_label_model_weighs_voters_by_agreement():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.2
    good = [(rng.random(len(y)) < np.where(y, 0.8, 0.01)) for _ in range(3)]
    noise = rng.random(len(y)) < 0.3
    code = sum(v.astype(int) << i for i, v in enumerate([*good, noise]))
    post = op4_toxicity.label_model(np.bincount(code, minlength=16), 0.2)
    assert post[0b0111] > 0.9 and post[0b1000] < 0.1 and post[0b1111] > 0.9


def test_language_on_held_out_rows(spark, docs):
    got = op8_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.95


def test_language_of_odd_rows(odd):
    got = op8_language.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 4)] == ["und"] * 3 and by[0].score == 0
    assert by[10].lang_pred == "en" and by[8].lang_pred == "en"
    assert {r.lang_pred for r in op8_language.identify(odd.where("lang is null")).collect()} == {"und"}


def test_pair_tables_equal_the_convolution():
    net = op8_language.Network.new(["a", "b"])
    x = np.random.default_rng(5).integers(0, 256, (3, op8_language.WINDOW)).astype(np.uint8)
    padded = np.concatenate([x, np.zeros((3, 3), np.uint8)], 1)
    pooled = []
    for w, f, b in zip(op8_language.WIDTHS, net.filters, net.bias, strict=True):
        each = [net.embed[padded[:, t: t + w]].reshape(3, -1) @ f for t in range(op8_language.WINDOW)]
        pooled.append(np.max(each, 0) + b)
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(op8_language.Predictor(net).log_probs(x), want, atol=1e-4)


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(4)
    english = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there".split()
    czech = "který není přes většina když žádný člověk může říci příliš žluťoučký kůň úpěl ďábelské ódy během několika měsíců"
    rows = [(i, " ".join(rng.choice(english, 60)), "en") for i in range(2400)]
    learned = [i for i in range(5000, 5040) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows += [(i, czech, "cs") for i in learned[:1]] + [(learned[1], czech + " a ještě", None)]
    rows += [(9_000_000, rows[0][1], "en")] * 50  # a row that stands often counts once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in op8_language.identify(docs).collect()}
    assert got[learned[0]] == got[learned[1]] == "cs" and sum(got[i] == "en" for i in range(2400)) == 2400
    assert op8_language.identify(docs.limit(0)).count() == 0


def test_the_toxicity_sample_holds_one_text_an_id(spark):
    rows = [(i % 10, f"text {i}", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, toxic int")
    kept = [i for i in range(10) if zlib.crc32(str(i).encode()) % 4 != 2]
    sample = op4_toxicity._collected(spark, docs, labels).collect()
    assert sorted(r.doc_id for r in sample) == kept
    assert len(op4_toxicity.toxicity(docs, labels).collect()) == 500
    assert op4_toxicity.toxicity(docs.limit(0), labels).count() == 0
