from newsflow.functions.ranking import lower_percentiles
from newsflow.operators import audit, lifecycle as lc, serving as v
from newsflow.sources import event_log


def test_slugs_equal_the_sequential_rule(spark):
    raw = ["a", "a", "a-2", "b", "b!", "a", "", "c c", "a-2", "c-c"]
    new = spark.createDataFrame([(f"{i:02d}", s) for i, s in enumerate(raw)], "id string, raw_slug string")
    taken = {"b", "a-3", "c-c-2"}
    old = spark.createDataFrame([(t,) for t in taken], "slug string")
    got = {r.id: r.slug for r in lc.allocate_slugs(new, old).collect()}
    want, used = {}, set(taken)
    for i, s in enumerate(raw):
        base = s.replace("!", "").replace(" ", "-") or f"article-{i:02d}"
        slug = next(x for x in [base] + [f"{base}-{n}" for n in range(2, 99)] if x not in used)
        used.add(slug)
        want[f"{i:02d}"] = slug
    assert got == want and len(set(got.values())) == len(raw)


def test_slugs_past_the_last_number(spark):
    new = spark.range(150).selectExpr("lpad(id, 4, '0') AS id", "'same' AS raw_slug")
    got = [r.slug for r in lc.allocate_slugs(new, spark.createDataFrame([("x",)], "slug string")).collect()]
    assert len(set(got)) == 150 and "same-98" in got and "same-99" not in got


def test_display_names(spark):
    rows = [("Nina Kraviz", "니나 크라비츠", "established", ["니나 크라비스"]), ("Nina", "니나", "established", []), ("ABC", "에이비씨", "established", []), ("Open", "오픈", "open", [])]
    names = lc.display_names(spark.createDataFrame(rows, "en string, ko string, ko_status string, ko_avoid array<string>"))
    texts = ["Nina Kraviz plays", "xNina Nina!", "ABC Open", "니나 크라비스 공연", "$1 Nina\\"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, title string")
    got = {r.id: r.title for r in lc.apply_display_names(df, names).collect()}
    assert [got[str(i)] for i in range(5)] == ["니나 크라비츠 plays", "xNina 니나!", "ABC Open", "니나 크라비츠 공연", "$1 니나\\"]
    again = lc.apply_display_names(spark.createDataFrame(list(got.items()), "id string, title string"), names)
    assert {r.id: r.title for r in again.collect()} == got
    loose = {r.id: r.title for r in lc.apply_display_names(df, names, bounded=False).collect()}
    assert loose["1"] == "x니나 니나!"


def test_percentiles_equal_the_sorted_list(spark):
    vals = [(k, float(v)) for k in "ab" for v in ([3, 1, 2, 2, 9] if k == "a" else [7] * 20 + list(range(50)))]
    got = {r.k: (r.p50, r.p90) for r in lower_percentiles(spark.createDataFrame(vals, "k string, v double"), ["k"], "v", [0.5, 0.9]).collect()}
    for k in "ab":
        s = sorted(v for kk, v in vals if kk == k)
        assert got[k] == tuple(s[min(len(s) - 1, int((len(s) - 1) * f))] for f in (0.5, 0.9))


def test_contract(spark):
    df = spark.createDataFrame([("1", "", "http://x.com", "z"), ("1", "t", "bad", "a")], "id string, title string, url string, kind string")
    spec = {"required": ["id", "title", "url", "body"], "nonblank": ["title"], "urls": ["url"], "enums": {"kind": ["a"]}, "identity": ["id"], "class_column": "kind", "class_counts": {"a": 2}}
    got = {(r.problem, r.field) for r in audit.check_contract(df, spec).collect()}
    assert got == {("missing_field", "body"), ("extra_field", "kind"), ("blank", "title"), ("bad_url", "url"), ("bad_value", "kind"), ("duplicate", "id"), ("class_count", "kind")}


def test_content_blocks(spark):
    text = "First\n\n![Alt](https://x.com/i.png)\n\n*From [Name](https://s.com/a) today*"
    df = spark.createDataFrame([("1", text, "https://x.com/lead.jpg"), ("2", "One", None)], "id string, content string, image_url string")
    got = [(r.id, r.kind, r.alt or r.text, r.href) for r in v.content_blocks(df).orderBy("id", "pos").collect()]
    assert got == [("1", "image", None, "https://x.com/lead.jpg"), ("1", "paragraph", "First", None), ("1", "image", "Alt", "https://x.com/i.png"),
                   ("1", "attribution", "Name", "https://s.com/a"), ("2", "paragraph", "One", None)] or got[0][2] == ""


def test_event_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-02 03:04:05", "r", "suggest", "s", None, "x", "u", "t", '{"a":1}')],
                                 "ts string, run_id string, pipeline string, stage string, reason string, source string, item_url string, title string, detail string")
    rows = rows.withColumn("ts", rows.ts.cast("timestamp"))
    path = str(tmp_path / "log")
    event_log.write_event_log(rows, path)
    event_log.write_event_log(rows, path)
    back = event_log.read_event_log(spark, path)
    assert back.count() == 2 and back.first().detail == '{"a":1}' and back.first().pipeline == "suggest"
    assert audit.first_candidate(back.withColumn("detail", back.item_url), "s", back.item_url).first().first_at is not None
