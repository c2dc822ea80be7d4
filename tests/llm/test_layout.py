"""Sharding, chat, packing and page text: exact laws and round trips."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import SF
from newsflow.llm import op1_sharding, op5_chat, op9_packing, op10_html
from newsflow.llm import textbytes as tb
from newsflow.llm.wordids import WordIds


def test_shards_have_exact_sizes_and_gapless_slots(spark, texts):
    got = op1_sharding.op1_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = {}
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_do_not_depend_on_partitions(docs):
    def run(n):
        rows = docs.select("doc_id", "source").repartition(n)
        out = op1_sharding.shuffle_into_shards(rows, ["doc_id"], 5, rows_per_block=16)
        return sorted((r.doc_id, r.shard, r.slot) for r in out.collect())

    assert run(1) == run(9)


def test_shards_of_odd_rows(odd):
    out = op1_sharding.shuffle_into_shards(odd, ["doc_id", "text"], 4)
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) == odd.count() and max(sizes) - min(sizes) <= 1
    assert op1_sharding.shuffle_into_shards(odd.limit(0), ["doc_id"]).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(2)
    x = np.array([op1_sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(x.mean() - 6) < 0.15 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    big = op1_sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**9)
    assert abs(big - 3 * 10**8) < 10**6
    m = op1_sharding.split(rng, np.array([5, 5, 4]), [7, 0, 7])
    assert m.sum(1).tolist() == [7, 0, 7] and m.sum(0).tolist() == [5, 5, 4]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=40))
def test_packing_holds_every_token_once(lengths):
    sequences = op9_packing.pack(lengths)
    seen = [[] for _ in lengths]
    for size, parts in sequences:
        assert size & (size - 1) == 0 and size <= 4096 and sum(n for _, _, n in parts) == size
        for d, s, n in parts:
            seen[d].append((s, n))
    for n, pieces in zip(lengths, seen, strict=True):
        at = 0
        for s, k in sorted(pieces):
            assert s == at and k > 0
            at += k
        assert at == n
    assert len(op9_packing.step_groups(sequences)) == len(sequences)


TRICKY = [
    None, "", "the the, it's HE'LL 'tis don’t", "É é e\u0301 İ ß ÀÉÎ", "a1b22 3.5% x_y", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
    "日本語 text\u00a0no\u2003break\x1cx", "tab\tnew\n\nline\x0b\x0c", "…—“q” (x) [y] {z} !!! ?!.", "× ÷ a×b", "word " * 5000, "x" * 3000,
    "\U0001f600 smile\U0001f600", "a\u0301\u0327 \u0301b",
]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op9_packing.default_tokenizer())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_word_ids_are_the_tokenizers(many):
    import pyarrow as pa

    many = [t.encode("utf-8", "replace").decode() for t in many] + TRICKY
    enc, plain = _ENCODER, _ENCODER.tokenizer
    for s in tb.slices(pa.array(many, pa.string())):
        ids, at = enc.ids(s)
        for r in range(s.rows):
            assert ids[at[r]: at[r + 1]].tolist() == plain.encode(many[s.lo + r] or "", add_special_tokens=False).ids


_ENCODER = WordIds(op9_packing.default_tokenizer())


def check_packed(rows, texts):
    plain, by = tokenizer(), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for d, pieces in by.items():
        ids = np.array([*plain.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seq = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert seq.get(r.sequence_id, 0) == r.offset
        seq[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in seq.values())


def test_packed_documents(spark, texts):
    check_packed(op9_packing.op9_packing(spark, SF).collect(), texts)


def test_packed_odd_rows(spark):
    rows = dict(enumerate(TRICKY))
    check_packed(op9_packing.packed(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect(), rows)


def test_packed_clashing_columns(odd):
    got = op9_packing.packed(odd)
    assert got.where("start = 0").count() == odd.count() and op9_packing.packed(odd.limit(0)).count() == 0


def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    hard = r"\### Assistant: </turn> ok"
    convs = {-7: [("user", hard), ("assistant", hard)]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = op5_chat.op5_chat(spark, SF).collect()
    assert len(got) == len(convs)
    for r in got:
        turns = convs[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


HARD = st.lists(st.sampled_from([*"#</turn>|\\:\n aé", "</turn>", "### ", "<|image:0|>"]), max_size=30).map("".join)


@given(HARD, HARD)
def test_turns_are_read_back(role, text):
    v = op5_chat.Visitor()
    v.visit({"kind": "text", "text": text})
    body = "".join(v.body)
    assert not any(c in body for c in ("</turn>", "##", "<|")) and op5_chat.unescape(body) == text
    name = op5_chat._IN_ROLE.sub(lambda m: "\\" + m[0], op5_chat.escape(role))
    assert op5_chat.parse_turn(f"### {name}:\n{body}</turn>\n") == (role, text)


def test_parts_become_placeholders(spark):
    part = op5_chat.PART
    rows = spark.sql(f"""
        select 1L conv_id, 0L turn, 'user' role, from_json('[{{"kind":"text","text":"see "}},
            {{"kind":"image","ref":"a.png","width":57,"height":28}}, {{"kind":"audio","ref":"b.wav","seconds":1.5}},
            {{"kind":"document","ref":"c.pdf","pages":2}}, {{"kind":"odd"}}, {{"kind":"odd","text":"<|x"}}]', 'array<{part}>') parts
        union all select 1L, 1L, null, null""")
    got = op5_chat.format_turns(rows).orderBy("turn").collect()
    assert got[0].formatted == "### user:\nsee <|image:0|><|audio:1|><|document:2|><|file:3|><\\|x</turn>\n"
    assert [(a.nth, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536), (3, "file", None, 0)]
    assert got[0].expanded_tokens == 1577 and got[1].formatted == "### :\n</turn>\n"


def test_chat_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, 2, "user", "x"), (2, 1, "a:\nb", "")],
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op5_chat.read_back(op5_chat.format_turns(op5_chat.text_turns(rows))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\na\nassistant\nb\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"a:\nb\n\n").hexdigest() and got[None].n_turns == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="box ad-top">Buy</div>{body}
<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(("body", "want"), [
    ("<article><h1>Head</h1><p><b>One &amp;\n two.<br><p>Three&nbsp;<i>fo</i>ur</p><div id=comments>no</div></article>", "Head\nOne & two.\nThree four"),
    ("<p>a < b</p><div>c<form><p>mail</p></form>d</div>", "a < b\nc\nd"),
    ("<main>x<aside>y</aside><ul><li>1<li>2</ul></main><p>out</p>", "x\n1\n2"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut<di", "cut"), ("<div hidden>h</div><div style='display: none'>n</div>", ""),
    ("<table><tr><td>1<td>2<tr><td>3</table><p title='a>b'>q</p>", "1\n2\n3\nq"), ("<article><textarea>t</textarea><noscript>n</noscript>k</article>", "k"),
])
def test_main_text(body, want):
    page = PAGE.replace("{body}", body) if "cut" not in body else PAGE.split("{body}")[0] + body
    assert op10_html.Tree().feed(page).main_text() == want


@pytest.mark.parametrize("body", [
    "<html><head><meta charset=x><title>T</title><script>1</script><p>Text</p>",
    "<head><title>T</title>Text",
    "<head><title>T</title></head><select><option>A<option>B</select><p>Text",
    "<svg width=1 /><iframe src='x'/><p>Text",
    "<form><select><option>A</form><p>Text",
    "<p><button><p>Press</p></button>Text</p>",
    "<noscript><div class=notice>Off</noscript><p>Text",
    "<object data=a/>none</object><p>Text",
    "<div class='has-sidebar'><div class='entry-header'><p>Text</p></div><div class='cookie-banner'>Yes</div></div>",
])
def test_text_after_open_markup_stays(body):
    assert op10_html.Tree().feed(body).main_text() == "Text"


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_html.op10_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id]
        inner = page.html.split("<article>")[1].split("</article>")[0]
        assert r.url == page.url and r.n_chars == len(r.text)
        assert r.text == op10_html.Tree().feed(f"<article>{inner}").main_text()
        assert "track(" not in r.text and "©" not in r.text


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [
        (i, f"https://Site.example/{i}", f"<body><div class=top>Same words</div><div class=links><a href=/>link {i}</a></div>"
            f"<div class=body><p>Own text {i} of {i * i}</p></div></body>") for i in range(8)
    ]
    rows += [(90, None, None), (91, "odd", ""), (92, "https://site.example/x", "<p>lone"), (92, "https://site.example/x", "<p>lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("removed", "removed")
    got = [(r.page_id, r.text) for r in op10_html.extract(pages).collect()]
    assert sorted(got) == sorted(
        [(i, f"Own text {i} of {i * i}") for i in range(8)] + [(90, ""), (91, ""), (92, "lone"), (92, "lone")])
    assert op10_html.extract(pages.limit(0)).count() == 0


def test_style_tree_decides_inside_articles(spark):
    more = " and more of it" * 20
    tail = "<div class=x1>Read it in our app</div></article>"
    rows = [(i, "https://a.example/", f"<article><h1><a href=/{i}>Head {i}</a></h1><p>Text {i} of {i * i}{more}</p>{tail}") for i in range(8)]
    rows += [(100 + i, "https://a.example/", f"<p>Page {i}</p><article><h1>Copy</h1><p>One article on many pages{more}</p>{tail}") for i in range(200)]
    # versions of one article on a host of its own
    rows += [(300 + i, "https://b.example/", f"<article><h1>One</h1><p>One article{more}</p><p>{i} views</p>{tail}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op10_html.extract(pages.repartition(5)).collect()}
    assert all(got[i] == f"Head {i}\nText {i} of {i * i}{more}" for i in range(8))
    assert all(got[100 + i] == f"Copy\nOne article on many pages{more}" for i in range(200))
    assert all(got[300 + i] == f"One\nOne article{more}\n{i} views" for i in range(50))


@pytest.mark.parametrize("name", ["related-work", "notice-of-meeting", "login-guide", "share-of-votes", "commentary", "promotion-rules"])
def test_names_that_only_begin_like_noise_stay_in_an_article(name):
    page = f"<article><p>a</p><div class='{name}'><p>b</p></div><section id={name}>c</section></article>"
    assert op10_html.Tree().feed(page).main_text() == "a\nb\nc"


@pytest.mark.parametrize("name", ["ad", "ad-2", "share-widget", "x Related", "cookie-banner"])
def test_names_of_noise_go(name):
    assert op10_html.Tree().feed(f"<article><p>a</p><div class='{name}'>b</div></article>").main_text() == "a"


def test_a_letter_that_grows_in_lower_case():
    page = f"<p>{'İ' * 12}</p><script>x</SCRIPT><p>b</p><title>t</TITLE ><p>c</p>d"
    assert op10_html.Tree().feed(page).main_text() == "İ" * 12 + "\nb\nc\nd"


@pytest.mark.parametrize("page", [
    "<p>a</p>" + "<a " * 300_000 + "'", "<p>a</p>" + "<div>" * 20_000 + "</section>" * 20_000, "<p>a</p>" + '<a x="' * 150_000, "<p>a</p>" + "<!-- " * 200_000,
    "<p>a</p>" + "<svg>" * 20_000 + "</object>" * 20_000, "<p>a</p><b " + "x" * 1_000_000, "<p>a</p>" + "<script>" * 100_000, "<p>a</p>" + "<b q='" * 100_000])
def test_odd_markup_is_read_in_one_pass(page):
    start = time.perf_counter()
    assert op10_html.Tree().feed(page).main_text() == "a"
    assert time.perf_counter() - start < 20
