import pytest
from pyspark.sql import functions as F

from newsflow.operators import entities as e
from newsflow.sources.dictionary import DictionaryError, load_surfaces

ENT = "position int, en string, aliases_en array<string>, weight double"
POL = "version int, entities map<string, struct<role:string, contextual_surfaces:map<string,struct<before:array<string>,after:array<string>,max_gap_chars:bigint>>>>"


def surfaces(spark, entities, policy=None, version=2):
    ents = spark.createDataFrame([(i, *x) for i, x in enumerate(entities)], ENT)
    return load_surfaces(ents, spark.createDataFrame([(version, policy or {})], POL))


DICT = [("Better", ["better"], 1.0), ("Bandcamp", [], 0.5), ("The Prodigy", ["prodigy band"], 1.0), ("사이키", ["사이키델릭"], 1.0), ("DJ", [], 0.3), ("!!!", [], 0.4)]
POLICY = {
    "Better": {"role": None, "contextual_surfaces": {"Better": {"before": ["DJ"], "after": ["DJ set", "remix"], "max_gap_chars": 4}}},
    "Bandcamp": {"role": "supporting", "contextual_surfaces": {}},
}


def brute(text, surf):
    at = text.find(surf)
    while at >= 0:
        a, b = text[at - 1] if at else " ", text[at + len(surf)] if at + len(surf) < len(text) else " "
        if not (a.isascii() and a.isalnum()) and not (b.isascii() and b.isalnum()):
            return True
        at = text.find(surf, at + 1)
    return False


TEXTS = ["The Prodigy return", "theprodigy", "new prodigy band!", "사망DJ 소식", "adjacent", "a 사이키 night", "x사이키델릭y 사이키델릭.", "DJ Better plays",
         "better days", "Better remix out", "better, the remix", "better xx remix", "bandcamp Friday", "go !!! live", "DJ the better one", "DJ, better"]


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_matches_equal_brute_force(spark, limit):
    """The same with a dictionary that Spark broadcasts and one that it shuffles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    ra = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(TEXTS)], "id string, title string, content string")
    got = {(r.id, r.canonical) for r in e.entity_index(ra, surfaces(spark, DICT, POLICY)).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    strong = {"Bandcamp": ["bandcamp"], "The Prodigy": ["the prodigy", "prodigy band"], "사이키": ["사이키", "사이키델릭"], "DJ": ["dj"], "!!!": ["!!!"]}
    want = {(str(i), c) for i, t in enumerate(TEXTS) for c, ss in strong.items() if any(brute(t.lower() + "\n", s) for s in ss)}
    ctx = {"DJ Better plays", "Better remix out", "DJ the better one", "DJ, better"}
    want |= {(str(i), "Better") for i, t in enumerate(TEXTS) if t in ctx}
    assert got == want - {(str(TEXTS.index("DJ the better one")), "Better")}  # the gap is five characters


def test_postings_hold_only_keys_that_the_dictionary_could_have(spark):
    """Short words and characters without a word do not travel unless some surface has such a key."""
    rows = [("1", "grand opening of the new prodigy band at 사이키 !!!"), ("2", "on to it"), ("3", None)]
    hay = spark.createDataFrame(rows, "id string, hay string")

    def keys(entities):
        got = e.key_postings(hay, surfaces(spark, entities)).collect()
        assert len(got) == len(set(got))
        return {(r.id, r.block_key) for r in got}

    assert keys([("Opening", [], 1.0), ("Prodigy Band", [], 1.0)]) == {("1", "opening"), ("1", "prodigy"), ("1", "grand opening"), ("1", "prodigy band")}
    assert keys([("Opening", [], 1.0)]) == {("1", "opening"), ("1", "prodigy")}
    assert {("1", "사이"), ("1", "사"), ("1", "!!"), ("1", "!")} <= keys([("!!!", [], 1.0)])
    assert not [k for _, k in keys([("!!!", [], 1.0)]) if k.isascii() and k.isalnum()]
    assert keys([]) == set()


def test_roles_partition_and_quota(spark):
    rows = [("1", "The Prodigy", None), ("2", "bandcamp", None), ("3", "bandcamp", ("accepted", "dance_experience", "k")), ("4", "a techno night", None), ("5", "nothing", None)]
    ra = spark.createDataFrame(
        [(i, t, "", (g,)) for i, t, g in rows],
        "id string, title string, content string, facts struct<correspondent_gate:struct<decision:string,path:string,candidate_key:string>>")
    idx = e.entity_index(ra, surfaces(spark, DICT, POLICY))
    parts = e.partition_articles(ra, idx)
    assert {r.id: r.partition for r in parts.collect()} == {
        "1": "qualifying", "2": "supporting_only", "3": "dance_experience", "4": "not_matched", "5": "not_matched"}
    got = {r.id: (r.selected, r.skip_reason) for r in e.select_quota(parts, ["id"], 3, 0.6).collect()}
    assert got == {"1": (True, None), "2": (False, "supporting_entity_only"), "3": (True, None), "4": (True, None), "5": (False, "non_entity_cap")}
    assert [r.batch for r in e.assign_batches(parts, ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_topic_evidence(spark):
    cases = {"Electronic music news": True, "synth e-bike tour": False, "new synth": True, "DJs play": True, "hip-hop DJ": False,
             "사망DJ": True, "테크노 파티": True, "テクノ": True, "adjust": False, "house party": False, "xDJ": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.e for r in df.select("t", e.has_topic_evidence(F.col("t"), F.lit("")).alias("e")).collect()}
    assert got == cases


@pytest.mark.parametrize("entities,policy,version", [
    (DICT, POLICY, 1), ([("", [], 1.0)], {}, 2), ([("A b", [""], 1.0)], {}, 2), ([("A b", [], None)], {}, 2),
    (DICT, {"Nobody": {"role": None, "contextual_surfaces": {}}}, 2), (DICT, {"Better": {"role": "odd", "contextual_surfaces": {}}}, 2),
    (DICT, {"Better": {"role": None, "contextual_surfaces": {"other": {"before": ["x"], "after": None, "max_gap_chars": None}}}}, 2),
    (DICT, {"Better": {"role": None, "contextual_surfaces": {"Better": {"before": [], "after": [], "max_gap_chars": None}}}}, 2),
    (DICT, {"Better": {"role": None, "contextual_surfaces": {"Better": {"before": ["x"], "after": [], "max_gap_chars": -1}}}}, 2),
    ([("A", [], 1.0)], {}, 2),
])
def test_broken_dictionaries_fail_closed(spark, entities, policy, version):
    with pytest.raises(DictionaryError):
        surfaces(spark, entities, policy, version)


def test_contains_join_equals_brute_force(spark):
    texts = ["alpha beta", "b", "ab", "", "xyz alpha"]
    pats = ["a", "ab", "alpha", "zzz", "ha b"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r.i, r.pattern) for r in e.contains_join(t, spark.createDataFrame([(p,) for p in pats], "pattern string"), ["i"]).collect()}
    assert got == {(i, p) for i, x in enumerate(texts) for p in pats if p in x}


def test_a_common_word_does_not_meet_all_its_surfaces(spark):
    """Forty texts and forty surfaces share their longest word; only the surfaces whose two words are in a text meet it."""
    names = [("extraordinary", f"n{i:02d}") for i in range(40)]
    dictionary = surfaces(spark, [(" ".join(n), [], 1.0) for n in names] + [("Extraordinary one two", [], 1.0)])
    texts = [(f"t{i:02d}", f"the Extraordinary, {b} and more" if i else "extraordinary one -- two") for i, (_, b) in enumerate(names)]
    hay = spark.createDataFrame(texts, "id string, text string").select("id", F.lower("text").alias("hay"))
    assert e._candidates(hay, dictionary).select("id", "surface").distinct().count() <= 41
    ra = spark.createDataFrame([(i, t.replace(",", ""), "") for i, t in texts], "id string, title string, content string")
    got = {(r.id, r.canonical) for r in e.entity_index(ra, dictionary).collect()}
    assert got == {(f"t{i:02d}", " ".join(n)) for i, n in enumerate(names) if i}


def test_patterns_with_one_beginning_meet_only_their_texts(spark):
    pats = ["common beginning " + c * 3 for c in "abcdefghij"] + ["common", "eginning ccc", "co"]
    texts = [(i, f"a common beginning {c * 3} x") for i, c in enumerate("abcdefghijkl")] + [(None, "uncommon"), (99, "")]
    t = spark.createDataFrame(texts, "i int, text string")
    p = spark.createDataFrame([(x,) for x in pats], "pattern string")
    got = sorted(((r.i, r.pattern) for r in e.contains_join(t, p, ["i"]).collect()), key=repr)
    assert got == sorted(((i, x) for i, s in texts for x in pats if x in s), key=repr)
    keyed = p.select("pattern", e.gram_size(F.col("pattern")).alias("_size"))
    assert {r.pattern: r._size for r in keyed.collect()} == {x: (16 if len(x) > 15 else 11 if len(x) > 10 else 5 if len(x) > 4 else 2) for x in pats}


def test_ablation_lists_every_new_match_beyond_the_places(spark):
    """The base's articles fill the one place; all matches of the added entity are still listed."""
    from newsflow.operators import audit

    rows = [("1", "The Prodigy"), ("2", "nova one live"), ("3", "nova one"), ("4", "nova one and the prodigy"), ("5", "nothing")]
    ra = spark.createDataFrame(
        [(i, t, "", "src", (None,)) for i, t in rows],
        "id string, title string, content string, source_name string, "
        "facts struct<correspondent_gate:struct<decision:string,path:string,candidate_key:string>>")
    base, add = surfaces(spark, [("The Prodigy", [], 1.0)]), surfaces(spark, [("Nova One", [], 1.0)])
    labels = spark.createDataFrame([("2", "relevant")], "id string, label string")
    got = {(r.canonical, r.id, r.label) for r in audit.entity_ablation(ra, base, add, labels, 1).collect()}
    assert got == {("Nova One", "2", "relevant"), ("Nova One", "3", None)}


def test_topic_words_lose_no_match(spark):
    """Every match of a pattern holds one of the words that are looked for first."""
    said = ["Electronic Music", "DANCE music", "house music", "Techno", "tranceX", "Dubstep", "drum AND bass", "Drum & Bass", "DnB", "electronic\n producer",
            "Electronic  Music Producer", "전자 음악", "일렉트로닉뮤직", "하우스 뮤직", "테크노", "트랜스", "덥스텝", "드럼 앤드베이스", "디제이", "電子音楽",
            "エレクトロニック・ミュージック", "ハウスミュージック", "テクノ", "トランス", "ダブステップ", "ドラム・アンド・ベース",
            "Synth", "SYNTHESIZER", "chiptune", "DJs", "djing", "ADJ", "İ DJ", "music", "producer", "", None]
    rows = [(t, c) for t in said for c in ["", "a", "e-bike hip-hop DJ synth"]] + [("e-bike", t) for t in said] + [("Rap", t) for t in said]
    df = spark.createDataFrame(rows, "title string, content string")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    t = F.coalesce("title", F.lit(""))
    plain = e.any_match(text, e.TOPIC_PATTERNS) | (text.rlike(e.rxi(e.SYNTH_WORD)) & ~t.rlike(e.rxi(e.VEHICLE_TITLE))) | (
        text.rlike(e.rxi(e.DJ_WORD)) & ~t.rlike(e.rxi(e.HIP_HOP_TITLE)))
    got = df.select("title", "content", e.has_topic_evidence(F.col("title"), F.col("content")).alias("a"), plain.alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and {r.a for r in got} == {True, False}
    for pattern, words in [*[(p, e.TOPIC_WORDS) for p in e.TOPIC_PATTERNS], (e.SYNTH_WORD, e.SYNTH_WORDS), (e.DJ_WORD, e.DJ_WORDS)]:
        found = df.where(text.rlike(e.rxi(pattern)))
        assert found.count() and found.where(~e._says_one(text, words)).count() == 0
