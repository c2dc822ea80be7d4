import datetime
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.functions import dates, unicode, urls
from newsflow.functions.html import PARTS, scan_pages
from newsflow.functions.text import clean_text, decode_entities, says
from newsflow.functions.unicode import first_json_array, nfkc
from newsflow.operators import extract as x
from newsflow.operators import gate as g


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_published_forms(spark):
    got = values(spark, lambda c: dates.parse_published(c).cast("string"), [
        "2026-01-02T03:04:05Z", "2026-01-02 03:04", "2026-01-02T03:04:05+09:00", "Fri, 02 Jan 2026 03:04:05 GMT", "2026-01-02 junk", "1999-01-01", "x", None, "2 Jan 2026 03:04:05 BST"])
    assert got == ["2026-01-02 03:04:05", "2026-01-02 03:04:00", "2026-01-01 18:04:05", "2026-01-02 03:04:05", "2026-01-02 00:00:00", None, None, None, "2026-01-02 02:04:05"]


def test_listing_dates(spark):
    today = F.lit("2026-01-10").cast("date")
    got = values(spark, lambda c: dates.listing_date(c, today).cast("string"), ["2026.02.03", "2026年3月4日", "12月31日", "1/5", "5th March 2027", "Mar 7", "13/45", "no date", "Sept 4 2026", "Lineup 2 Feb"])
    assert got == ["2026-02-03", "2026-03-04", "2025-12-31", "2026-01-05", "2027-03-05", "2026-03-07", None, None, None, "2026-02-02"]


@pytest.mark.parametrize("text,want", [
    ("2026年8月29日 - 8月30日", ["2026-08-29"]), ("Sat, August 29 - Sun, August 30, 2026", ["2026-08-29"]), ("29 August - 30 August 2026", ["2026-08-29"]),
    ("２０２６年８月２９日", ["2026-08-29"]), ("2026년 8월 29일부터 2026년 8월 31일", ["2026-08-29"]), ("2026-08-29 and 2026/9/1", ["2026-08-29", "2026-09-01"]),
    ("土 29 8月 2026", ["2026-08-29"]), ("Aug 29th, 2026", ["2026-08-29"]), ("2026-02-31", []), ("August 29", []),
])
def test_explicit_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(nfkc("t").alias("t"))
    assert df.select(dates.explicit_dates(F.col("t"))).first()[0] == want


def test_urls(spark):
    u = ["https://www.A.com/p?utm_source=x&a=1&b&ref=q#f", "http://x.com/?q=a+b%26c", "https://x.com"]
    assert values(spark, urls.canonical_url, u) == ["https://www.A.com/p?a=1&b=#f", "http://x.com/?q=a+b%26c", "https://x.com"]
    assert values(spark, urls.strip_url, u) == ["https://www.A.com/p", "http://x.com/", "https://x.com/"]
    assert values(spark, urls.host_key, u) == ["a.com", "x.com", "x.com"]


def test_text(spark):
    assert values(spark, decode_entities, ["a &amp;amp; b &#65;&#x1F600; &copy; &lt;"]) == ["a &amp; b A\U0001F600 &copy; <"]
    assert values(spark, clean_text, ["News\nBody line\nnews\nMore subscribe tail\nlost", "x share y"]) == ["Body line\nMore", "x y"]
    assert values(spark, x.denoise_lines, ["Photo credit: A\n\n\nReal sentence, yes.\nby Jane Doe\nshort line of words\n\nAnother one."]) == ["Real sentence, yes.\n\nAnother one."]


def test_reflow(spark):
    df = spark.createDataFrame([("# Title\nHe said “a\nb”.\nNext",)], "t string")
    r = x.reflow(df, "t").first()
    assert (r.title, r.body) == ("Title", "He said “a b”.\n\nNext")


PAGES = [
    ("1", "https://x.com/a/big-story-here.html", '<meta property="og:title" content="Great night &amp; day | Mixmag"><h1>Other title here</h1>'),
    ("2", "https://x.com/a/big-story-here.html", "<title>404</title>"),
    ("3", "https://x.com/", '<h1>Page <b>one</b> title</h1><title>www.x.com</title><a href="https://youtu.be/abc">v</a>'),
]
COLS = "page_id string, url string, html string"


def test_titles_and_media(spark):
    df = spark.createDataFrame(PAGES, COLS)
    assert {r.page_id: r.title for r in x.page_titles(df).collect()} == {"1": "Great night & day", "2": "Big Story Here", "3": "Page one title"}
    assert {r.page_id: r.embed_url for r in x.page_media(df).collect()} == {"1": None, "2": None, "3": "https://youtu.be/abc"}


def test_page_text_prefers_the_article(spark):
    body = "<p>" + "Long sentence about music. " * 20 + "</p>"
    html = f"<nav>menu</nav><article class='post'>{body}</article><section>{'x ' * 200}</section>"
    r = x.page_text(spark.createDataFrame([("1", "https://x.com/", html)], COLS)).first()
    assert r.text.startswith("Long sentence") and "menu" not in r.text


PHOTO = [
    ("og", '<meta property="og:image" content="/p/a.jpg"><img src="/big-2000x1000.jpg">', "https://x.com/p/a.jpg"),
    ("logo", '<meta property="og:image" content="/logo.png"><script type="application/ld+json">{"image":{"url":"https://c.com/i.jpg"}}</script>', "https://c.com/i.jpg"),
    ("area", '<img src="a.jpg"><img src="b.jpg" width="300" height="400"><img srcset="/s.jpg 100w, /l.jpg 900w">', "https://x.com/l.jpg"),
    ("small", '<img src="t.jpg" width="50" height="50"><img src="u.jpg"><img src="v.jpg" class="avatar">', "https://x.com/e/u.jpg"),
    ("none", '<img src="data:xyz"><img src="/i.svg">', None),
]


def test_photo_and_time(spark):
    df = spark.createDataFrame([(n, "https://x.com/e/page", h) for n, h, _ in PHOTO], COLS)
    assert {r.page_id: r.photo_url for r in x.page_photo(scan_pages(df)).collect()} == {n: w for n, _, w in PHOTO}
    times = [("ld", '<script type="application/ld+json">[{"datePublished":"2026-01-02"}]</script><meta name="date" content="2026-02-02">', "2026-01-02"),
             ("meta", '<meta name="pubdate" content="2026-03-03"><meta name="date" content="2026-02-02">', "2026-02-02"),
             ("time", '<time datetime="2026-05-05"></time><time class="entry-date" datetime="2026-04-04"></time>', "2026-04-04"),
             ("bare", '<time datetime="2026-05-05"></time>', None)]
    df = spark.createDataFrame([(n, "https://x.com/", h) for n, h, _ in times], COLS)
    got = {r.page_id: r.published_at and r.published_at.date().isoformat() for r in x.page_published(scan_pages(df)).collect()}
    assert got == {n: w for n, _, w in times}


def test_link_choice(spark):
    html = "".join(f'<p>{c}</p><a href="{h}">{t}</a>' for c, h, t in [
        ("", "/news/one-long-slug", "A headline long enough"), ("2026/03/01", "/news/two-long-slug", "Second headline here"), ("2025/12/01", "/news/old-long-slug", "An old headline here"),
        ("", "/news/page/2", "Page two of the list"), ("", "/about/us", "About us and the team"), ("", "https://other.com/news/x-y", "Elsewhere headline"), ("", "/news/one-long-slug#c", "Again the same link")])
    links = x.page_links(scan_pages(spark.createDataFrame([("1", "https://x.com/news/", html)], COLS)))
    got = {r.url.rsplit("/", 1)[1]: (r["class"], r.reason, r.rank) for r in x.select_links(links, F.lit("2026-01-10").cast("date"), 2).collect()}
    assert got["two-long-slug"][:2] == ("future", "selected") and got["two-long-slug"][2] == 1
    assert got["2"][:2] == ("excluded", "pagination_excluded")
    assert "us" not in got and "x-y" not in got and set(got) == {"one-long-slug", "two-long-slug", "old-long-slug", "2"}


def test_model_arrays():
    assert first_json_array('<think>[1]</think> text [bad] then [{"a": 1}] end') == '[{"a": 1}]'
    assert first_json_array("nothing") is None


def test_items_are_checked(spark):
    raw = '[{"headline_en":" H ","summary_en":"S","entities_en":"One","news_type":"odd","event_date":"2026-1-1","facts":{"lineup":["A","TBA",{"name":"B"}],"venue":"n/a","ticket_url":"/t"},"confidence":"x"}, 5, {"headline_en":"","summary_en":"S"}]'
    rows = g.parse_items(spark.createDataFrame([("p", "https://x.com/e/1", raw), ("q", "https://x.com/", "no")], "page_id string, base_url string, response string")).orderBy("page_id", "item_no").collect()
    assert [r.status for r in rows] == ["ok", "not_object", "headline_empty", "no_array"]
    r = rows[0]
    assert (r.headline_en, r.entities_en, r.news_type, r.event_date, r.confidence) == ("H", ["One"], "other", None, 0.0)
    assert (r.facts.lineup, r.facts.venue, r.facts.ticket_url) == (["A", "B"], None, "https://x.com/t")


def test_binding(spark):
    md = "# One\nalpha quote here\n# Two\nbeta words\n# Three\ngamma"
    asked = [("x", ["Alpha quote"]), ("beta words", []), ("zzz", []), ("zzz", [])]
    items = spark.createDataFrame(
        [("p", n, h, [], {"k": q}) for n, (h, q) in enumerate(asked)],
        "page_id string, item_no int, headline_en string, entities_en array<string>, experience_evidence map<string,array<string>>")
    rows = g.bind_items(items, spark.createDataFrame([("p", md)], "page_id string, markdown string")).orderBy("item_no").collect()
    assert [r.source_text for r in rows[:3]] == ["# One\nalpha quote here", "# Two\nbeta words", "# Three\ngamma"]
    assert [(r.binding_reason, r.binding_confident) for r in rows] == [("evidence_quotes_bound", True), ("lexical_fallback", True), ("lexical_binding_ambiguous", False), ("lexical_binding_ambiguous", False)]


def test_rules_know_other_scripts(spark):
    got = values(spark, lambda c: says(c, g.DANCE_CENTRALITY), ["DJ set이", "レイヴtechno night", "a DJ set", "techno night"])
    assert got == [False, False, True, True]
    assert values(spark, lambda c: says(c, g.PROGRAM_INDEPENDENCE), ["10pm-새벽", "10pm- x", "doors 9"]) == [True, False, True]


def test_event_date_tiers(spark):
    d = datetime.date
    ev = [("a", [d(2026, 1, 1)], [], None, False), ("b", [], [d(2026, 1, 2)], None, False), ("c", [], [d(2026, 1, 2), d(2026, 1, 3)], None, False),
          ("d", [], [], d(2026, 1, 4), True), ("e", [], [], d(2026, 1, 4), False), ("f", [], [], None, False)]
    evidence = spark.createDataFrame(ev, "page_id string, json_ld_dates array<date>, body_dates array<date>, url_date date, url_supported boolean")
    items = spark.createDataFrame([(p, n, c) for p in "abcdef" for n, c in ((0, None), (1, "2026-01-02"))], "page_id string, item_no int, event_date string")
    got = {(r.page_id, r.item_no): (str(r.resolved_date) if r.resolved_date else None, r.date_reason) for r in g.resolve_event_date(items, evidence).collect()}
    assert got[("a", 0)] == ("2026-01-01", "source_date_inferred") and got[("a", 1)] == ("2026-01-01", "llm_date_corrected")
    assert got[("b", 0)] == (None, "body_date_unconfirmed") and got[("b", 1)] == ("2026-01-02", "llm_date_supported")
    assert got[("c", 0)] == (None, "ambiguous_source_dates") and got[("c", 1)] == ("2026-01-02", "llm_date_supported")
    assert got[("d", 0)] == ("2026-01-04", "source_date_inferred") and got[("e", 0)][1] == "url_date_without_body_month_day" and got[("f", 1)][1] == "unsupported_event_date"


def test_gate(spark):
    text = "2026년 8월 29일 Hall A. DJ 공연 22:00, 무대 시간표. 무료 입장"
    full = {"dance_centrality": ["DJ 공연 22:00"], "program_independence": ["무대 시간표"], "public_access": ["무료 입장"]}
    cases = [
        ("ok", text, full, True, 0, 0, "accepted", "dance_experience"), ("entity", "x", {}, True, 1, 0, "accepted", "entity"),
        ("private", text + " members only", {**full, "private_or_restricted": ["members only"]}, True, 1, 0, "rejected", "none"),
        ("unsure", text + " members only", {**full, "private_or_restricted": ["members only"]}, False, 1, 0, "needs_verification", "none"),
        ("weak", "DJ 공연 tonight", {"dance_centrality": ["DJ 공연"]}, True, 0, 0, "needs_verification", "dance_experience"),
        ("none", "a house fair", {}, True, 0, 0, "rejected", "none"), ("support", "a fair", {}, True, 0, 2, "rejected", "none"),
    ]
    rows = [(n, 0, "T", "club_event", "2026-08-29", ("Hall A",), t, ev, s, q, p, "body_full_date", False, "https://x.com/e") for n, t, ev, s, q, p, _, _ in cases]
    df = spark.createDataFrame(rows, "page_id string, item_no int, headline_en string, news_type string, event_date string, facts struct<venue:string>, source_text string, "
                               "experience_evidence map<string,array<string>>, binding_confident boolean, n_qualifying long, n_supporting long, date_evidence string, page_date_confident boolean, page_url string")
    for k in ("open_time", "close_time", "ticket_price", "ticket_url"):
        df = df.withColumn("facts", F.col("facts").withField(k, F.lit(None).cast("string")))
    got = {r.page_id: (r.decision, r.path) for r in g.unified_gate(g.ground_evidence(df)).collect()}
    assert got == {n: (d, p) for n, *_, d, p in cases}
    keys = {r.page_id: r.candidate_key for r in g.candidate_key(df.withColumn("base_url", F.col("page_url"))).collect()}
    assert len(set(keys.values())) == 1 and all(len(k) == 16 for k in keys.values())


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "https://a.example.com/x/", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    return {int(r.page_id): r for r in scan_pages(df).collect()}


def test_tags_of_a_megabyte(spark):
    long, quoted = "b " * 500_000, "x" * 1_000_000
    got = texts_of(spark, [
        f"<p>a</p><b {long}", f"<p>a</p><b {long}>c</b>", f'<p>a</p><b title="{quoted}">c</b>', f"<p>a</p><b {long * 1}'>c</b>",
        "<p>a</p>" + "<a " * 300_000, "<p>a</p>" + "<!-- " * 200_000, "<p>a</p>" + '<a x="' * 100_000, "<p>a</p>" + "<b q=' " * 100_000 + ">c",
        "<p>a</p>" + "<i>" * 200_000 + "c", "<p>a</p><script>" + "<" * 900_000, "<p>a</p>" + "<b\"'" * 100_000 + ">c</b>"])
    for i, r in got.items():
        assert r.text.split() in (["a"], ["a", "c"]), (i, r.text[:50])
    assert got[1].text.split() == got[2].text.split() == got[8].text.split() == ["a", "c"]


def test_silent_elements_nest(spark):
    got = texts_of(spark, [
        "<template><template>a</template>b</template>c", "<svg><style>x</style><noscript>y<svg>z</svg>w</noscript>v</svg>c", "<svg/>c<template/>d",
        "<svg><svg><svg><svg><svg><svg>a</svg>b</svg>b</svg>b</svg>b</svg>b</svg>c", "a</svg>b</noscript>c", "a<noscript>b", "a<svg>b</noscript>c",
        "<noscript><p>b<svg>"])
    assert [got[i].text.replace("\n", "") for i in range(8)] == ["c", "c", "cd", "c", "abc", "a", "ac", ""]


def test_linked_data_stands_outside_comments(spark):
    ld = '<script {}>{{"@type":"Event","url":"https://a.example.com/e","startDate":"{}"}}</script>'
    kind = 'type="application/ld+json"'
    page = (
        f"<!-- {ld.format(kind, '2024-01-01')} --><style>{ld.format(kind, '2024-01-02').replace('/script', '/scrip')}</style>"
        f"<script>var a = '<!--';</script>{ld.format(kind, '2024-01-03')}<script>--></script>"
        f"<noscript>{ld.format('TYPE = Application/LD+JSON id=x', '2024-01-04')}</noscript>{ld.format('data-type=a/ld+json', '2024-01-05')}<!-- "
        + ld.format(kind, "2024-01-06"))
    assert [e.start for e in texts_of(spark, [page])[0].ld_events] == ["2024-01-03", "2024-01-04"]


def test_a_batch_is_never_held_as_python_strings():
    """A batch of 40 MB of text takes a few MB of Python objects; pandas held all of it, and every result."""
    texts = pa.array([f"\uff21{i} " + "Straße " * 2800 if i % 9 else None for i in range(2000)])
    tracemalloc.start()
    got = unicode.each(texts, unicode.fold, pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000 and len(got) == 2000
    assert got[1].as_py() == ("a1 " + "strasse " * 2800).strip() and got[0].as_py() == ""
    assert unicode.each(pa.array([], pa.string()), unicode.fold, pa.string()).to_pylist() == []


def plan_nodes(df):
    """(name, expressions) of every node of the optimized plan."""
    def walk(node):
        yield node.nodeName(), node.expressions().mkString(" ")
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().optimizedPlan()))


def test_a_page_is_scanned_once_and_outside_lambdas(spark):
    """Every pass over a page is the output of a generator, which the optimizer can't write out again at each use, as it did per meta key."""
    df = spark.createDataFrame([("1", "https://x.com/news/", "<p>")], COLS)
    published = x.page_published(scan_pages(df, only=["meta", "times", "ld_values"]))
    chosen = x.select_links(x.page_links(scan_pages(df, only=["links"])), F.lit("2026-01-10").cast("date"))
    for out, pattern in ((published, "(?:meta|link|img"), (chosen, r"</a\s*>"), (chosen, "年")):
        holds = [name for name, text in plan_nodes(out) if pattern in text]
        assert holds and set(holds) == {"Generate"}, (pattern, holds)
    assert sum("</a" in text for _, text in plan_nodes(chosen)) == 1  # not once for the links, their ranks and the excluded ones


def test_every_considered_link_keeps_one_reason(spark):
    rows = [("p", "https://x.com/news/", i, u, f"https://x.com/news/{u}", "t", "A headline long enough", "", d) for i, (u, d) in enumerate([
        ("page/2", None), ("page/2", None), ("a-story", "2026-01-12"), ("b-story", None), ("a-story", "2026-01-11"), ("c-story", "2025-12-30"), ("d-story", "2026-01-11"), ("about", None)])]
    rows += [("q", "https://x.com/list/", 0, "e", "https://x.com/event/old-story", "t", "A headline long enough", "", "2025-12-30")]
    links = spark.createDataFrame(rows, "page_id string, page_url string, pos int, href string, absolute string, text string, title string, context string, structured_date string")
    got = sorted((r.page_id, r.url.rsplit("/", 1)[1], r["class"], r.reason, r.rank or 0) for r in x.select_links(links, F.lit("2026-01-10").cast("date"), 3).collect())
    assert got == sorted([
        ("p", "2", "excluded", "pagination_excluded", 0), ("p", "2", "excluded", "pagination_excluded", 0), ("p", "d-story", "future", "selected", 1),
        ("p", "a-story", "future", "selected", 2), ("p", "b-story", "unknown", "selected", 3), ("p", "c-story", "past", "cap_exceeded", 0),
        ("q", "old-story", "past", "past_excluded", 0)])


def test_parts_of_a_scan_are_those_of_the_whole(spark):
    html = '<meta name="a" content="&eacute;&amp;eacute;<img src=x>"><time datetime="2026-01-01">t</time><img src="/i.png" alt="<time datetime=z>"><p>b &nbsp;c</p><a href="/n">d</a><!-- x'
    df = spark.createDataFrame([("1", "https://x.com/", html), ("2", None, None)], COLS)
    whole = scan_pages(df)
    for part in PARTS:
        assert sorted(map(str, whole.select("page_id", part).collect())) == sorted(map(str, scan_pages(df, only=[part]).select("page_id", part).collect()))
    one = whole.where("page_id = '1'").head()
    assert [(m.key, m.content) for m in one.meta] == [("a", "é&eacute;<img src=x>")] and [t.stamp for t in one.times] == ["2026-01-01"]


ITEMS = "page_id string, item_no int, headline_en string, entities_en array<string>, experience_evidence map<string,array<string>>"


def test_the_text_of_a_page_meets_its_items_once(spark):
    """Text and items are each read once and nothing is stored on the way, where each copy of the text took the input's size."""
    items = spark.createDataFrame([("p", 0, "x", [], {})], ITEMS)
    out = g.bind_items(items, spark.createDataFrame([("p", "# One\na")], "page_id string, markdown string"))
    names = [name for name, _ in plan_nodes(out)]
    assert names.count("Join") == 1 and sum(n in ("LogicalRDD", "LocalRelation") for n in names) == 2


def test_items_beyond_the_blocks_get_their_share_and_repeated_text_is_widened(spark):
    items = spark.createDataFrame([("p", n, "zzz", ["e"], {"k": [None, ""]}) for n in (2, 0, 1)] + [("q", 0, "a", [], None), ("none", 0, "a", [], {}), ("p", None, "a", [], {})], ITEMS)
    pages = spark.createDataFrame([("p", "# A\nbb"), ("q", None), ("r", "x")], "page_id string, markdown string")
    got = {(r.page_id, r.item_no): (r.source_text, r.binding_reason, r.entities_en) for r in g.bind_items(items, pages).collect()}
    # the item without a number comes first and takes the only block; four items share six characters, one each; blanks are one text
    reason = "lexical_binding_ambiguous"
    assert got == {("p", 0): (" ", reason, ["e"]), ("p", 1): ("A", reason, ["e"]), ("p", 2): ("\n\n\n", "duplicate_source_segment", ["e"]), ("q", 0): ("", reason, [])}


def test_texts_go_to_python_in_small_batches(spark):
    from newsflow.functions.lineage import ARROW_ROWS, arrow_rows

    @F.arrow_udf("long")
    def rows(a: pa.Array) -> pa.Array:
        return pa.array([len(a)] * len(a), pa.int64())

    before = spark.conf.get(ARROW_ROWS)
    df = spark.range(0, 1000, 1, 1).select(rows("id").alias("n"))
    with arrow_rows(spark, 16):
        assert df.agg(F.max("n")).head()[0] <= 16
    assert spark.conf.get(ARROW_ROWS) == before and spark.range(0, 1000, 1, 1).select(rows("id").alias("n")).agg(F.max("n")).head()[0] == 1000
