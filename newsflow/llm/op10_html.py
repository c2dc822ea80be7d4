"""Main text of pages by a site style tree (operator 10).

1. Every page is read into a tree of block elements.  A node's style is its path of tags and classes; its
   presentation is the sequence of its children's styles, its content the text below it.
2. The trees of one host are merged by path: Spark counts how often each node shows each presentation and each
   content.  A node's importance is ``(1 - GAMMA) * presentation + GAMMA * content``, both
   entropies relative to an even spread over the host's occurrences, times the share of its text outside links.
   Inside an article or main part every distinct part counts once, so an article carried on many pages keeps its entropy; links
   count as text there, and the mark itself is a prior: importance starts at the share of the host's main text that
   the node holds, and a title (``h1``) stays, so versions of one article don't cost a host its articles.
3. Branches of low importance are removed from every page.  Entropy cannot tell menus whose words change from page to
   page from articles, so nodes whose tag, class, id or role names them as menu, header, footer, sidebar, notice,
   advert, form or comments have importance 0; and where a page marks an article or main part, so have the
   branches outside it.

The counts of a host are partial sums, so a host with a third of all pages is added up before the
shuffle.  What a host removes is one row; Spark's own size check decides how it reaches the pages.

Text: references decoded, white space (also ``br``) inside a block one blank, blocks trimmed and joined by a line end.

Defined cases: a null or empty html has no text; a null or odd url is the host of its own text; broken and cut-off markup is
read as far as it goes; repeated rows are pages of their own (a page counts as often as it
stands); an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables

GAMMA = 0.9
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 5  # a host with fewer pages shows no style

# fixed values of HTML: elements that start a block, hold no text of the page, have no end
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("button canvas datalist head iframe math noscript object option select svg template textarea title".split())
RAW = frozenset(["script", "style", "textarea", "title"])
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo "
    "promotion related respond share sharing sidebar signup social sponsor sponsored subscribe subscription widget".split())

# every choice takes what it repeats for good, so a page is read once, whatever its markup; a quote counts behind "=" alone
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|([^<]++|<)", re.S)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CLOSED = re.compile(r"(?<![^\s\"'])/\s*\Z|(?:^|[\s\"'])[^\s=\"']+/\s*\Z")  # not the end of a bare value
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Node:
    __slots__ = ("tag", "path", "noise", "main", "children", "content", "chars", "linked", "low")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, low: bool):
        self.tag, self.path, self.noise, self.main, self.low = tag, path, noise, main, low
        self.children, self.content, self.chars, self.linked = 0, 0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(text)} if text else {}


def _is_noise(tag: str, attr: dict[str, str], in_main: bool) -> bool:
    if tag == "header" and in_main:  # an article's own head has its title
        return False
    if tag in NOISE_TAGS or "hidden" in attr or attr.get("aria-hidden") == "true":
        return True
    if attr.get("role") in NOISE_ROLES or _NONE.search(attr.get("style", "")):
        return True
    if tag in ("html", "body"):
        return False
    # "ad-top" is noise, "has-sidebar" and "entry-header" are not; inside an article "ad-2" and "share-widget" are, "related-work" is not
    names = [_NAME.findall(x) for x in (attr.get("class", "") + " " + attr.get("id", "")).split()]
    return any(x and all(y in NOISE_NAMES for y in (x if in_main else x[:1])) for x in names)


def _fold(h: int, x: int) -> int:
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little") + x.to_bytes(8, "little"))


class Tree:
    """Reads one page: its text blocks, and its nodes if ``nodes`` is given to count them."""

    def __init__(self, removed: frozenset[int] = frozenset(), nodes: Counter | None = None, host: str = ""):
        self.removed, self.nodes, self.host = removed, nodes, host
        self.stack = [_Node("", 0, False, False, False)]
        self.text: list[str] = []
        self.size = self.linked = 0
        self.links = 0
        self.silent: list[tuple[str, int]] = []  # open elements without text of the page, and the blocks open around them
        self.open: Counter = Counter()  # how many blocks and silent elements of each tag are open
        self.inside: Counter = Counter()  # nodes of the open main part
        self.blocks: list[tuple[bool, bool, str]] = []  # (in the main part, of low importance, text)

    def feed(self, page: str) -> Tree:
        at = 0
        while m := _TOKEN.match(page, at):
            at = m.end()
            if m[4] is not None:
                if self.silent and self.silent[-1][0] == "head" and not m[4].isspace():
                    self._speak()
                if not self.silent:
                    self.text.append(m[4])
                    if self.links:
                        self.linked += len(m[4])
                continue
            if m[2] is None:  # a comment or declaration stands between two texts
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not _CLOSED.search(m[3]):
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        return self

    def _start(self, tag: str, rest: str) -> None:
        top = self.silent[-1][0] if self.silent else ""
        if top == "head" and tag not in IN_HEAD or top == tag and tag in ("button", "option"):
            self._speak()
        if tag in SILENT or tag in RAW:
            if not _CLOSED.search(rest):
                self.silent.append((tag, len(self.stack)))
                self.open[tag] += 1
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self._flush()
            if tag == "hr":
                return
            self._close_implied(tag)
            up, attr = self.stack[-1], _attributes(rest)
            style = f"{tag}.{attr['class']}" if attr.get("class") else tag
            path = xxhash.xxh64_intdigest(style.encode(), up.path & 0xFFFFFFFF) & 0x7FFFFFFFFFFFFFFF
            main = up.main or tag in ("article", "main")
            noise = up.noise or _is_noise(tag, attr, up.main)
            self.stack.append(_Node(tag, path, noise, main, up.low or (path in self.removed and not (main and tag == "h1"))))
            self.open[tag] += 1

    def _close_implied(self, tag: str) -> None:
        if self.silent and len(self.stack) <= self.silent[-1][1]:  # a button is no part of the paragraph around it
            return
        top = self.stack[-1].tag
        if top == "p" or (top in ("li", "dd", "dt", "td", "th", "tr") and top == tag):
            self._pop()
        elif top in ("td", "th") and tag in ("td", "th", "tr"):
            self._pop()
            if tag == "tr" and self.stack[-1].tag == "tr":
                self._pop()

    def _speak(self) -> None:
        """The innermost silent element ends."""
        self.open[self.silent.pop()[0]] -= 1

    def _end(self, tag: str) -> None:
        if tag in SILENT or tag in RAW:
            if self.open[tag]:
                while self.silent[-1][0] != tag:
                    self._speak()
                depth = self.silent[-1][1]
                while len(self.stack) > depth:
                    self._pop()
                self._speak()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            self._flush()
            if self.open[tag]:
                while self.stack[-1].tag != tag:
                    self._pop()
                self._pop()

    def _pop(self) -> None:
        self._flush()
        n = self.stack.pop()
        self.open[n.tag] -= 1
        while self.silent and self.silent[-1][1] > len(self.stack):  # its end is missing
            self._speak()
        up = self.stack[-1]
        up.children = _fold(up.children, n.path)
        up.content = _fold(up.content, n.content)
        up.chars += n.chars
        up.linked += n.linked
        if self.nodes is not None:
            self.nodes[self.host, n.path, None, None, 0] += n.linked << 40 | n.chars
            if not n.main:
                self.nodes[self.host, n.path, n.children, n.content, 0] += 1
                return
            self.inside[n.path, n.children, n.content] += 1
            if not up.main:  # the whole part is known by what is in it
                part = _fold(n.children, n.content) | 1
                for k, v in self.inside.items():
                    self.nodes[self.host, *k, part] = v
                self.inside.clear()

    def _flush(self) -> None:
        if not self.text:
            return
        raw, linked = "".join(self.text), self.linked
        self.text, self.linked = [], 0
        text = _SPACE.sub(" ", html.unescape(raw)).strip()
        if not text:
            return
        n = self.stack[-1]
        n.content = _fold(n.content, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))
        n.chars += len(text)
        n.linked += min(linked, len(text))
        if not n.noise:
            self.blocks.append((n.main, n.low, text))

    def main_text(self) -> str:
        if any(main for main, _, _ in self.blocks):
            return "\n".join(t for main, low, t in self.blocks if main and not low)
        return "\n".join(t for _, low, t in self.blocks if not low)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), url, F.lit("")))


_NODE = "host string, path long, children long, content long, part long, n long, chars long, linked long"


def _signed(x: int | None) -> int | None:
    return None if x is None else x - (1 << 64) if x >= 1 << 63 else x


def style_nodes(pages: DataFrame) -> DataFrame:
    """Counts of (host, path, children, content, part), and text sizes of (host, path); added up within each batch.

    ``part`` is the article or main part around a node, 0 outside; a part counts once however many pages carry it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: Counter = Counter()
            sizes: dict = {}
            for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one: Counter = Counter()
                Tree(nodes=one, host=name).feed(page or "")
                for k, v in one.items():
                    if k[2] is None:
                        chars, linked = sizes.get(k[:2], (0, 0))
                        sizes[k[:2]] = (chars + (v & (1 << 40) - 1), linked + (v >> 40))
                    else:
                        nodes[k] = max(nodes[k], v) if k[4] else nodes[k] + v
            rows = [(h, p, _signed(c), _signed(t), _signed(m), n, 0, 0) for (h, p, c, t, m), n in nodes.items()]
            rows += [(h, p, None, None, 0, 0, c, k) for (h, p), (c, k) in sizes.items()]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield tables.record([
                    (f.split()[0], pa.string() if f.endswith("string") else pa.int64(), list(c))
                    for f, c in zip(_NODE.split(", "), cols, strict=True)
                ])

    each = pages.select("host", "html").mapInArrow(work, _NODE)
    n = F.when(F.col("part") == 0, F.sum("n")).otherwise(F.max("n"))
    return each.groupBy("host", "path", "children", "content", "part").agg(
        n.alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, n, importance) of the merged tree."""

    def entropy(what: str) -> DataFrame:
        each = nodes.where("n > 0").groupBy("host", "path", what).agg(F.sum("n").alias("n"))
        n = F.sum("n")
        even = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
        return each.groupBy("host", "path").agg(n.alias("n"), even.alias(f"h_{what}"))

    sizes = nodes.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max(F.col("part") != 0).alias("main"))
    free = F.when(F.col("chars") > 0, 1 - F.col("linked") / F.col("chars")).otherwise(1.0)
    whole = sizes.where("main").groupBy("host").agg(F.max("chars").alias("whole"))
    prior = F.when(F.col("whole") > 0, F.col("chars") / F.col("whole")).otherwise(1.0)
    spread = (1 - GAMMA) * F.col("h_children") + GAMMA * F.col("h_content")
    return (
        entropy("children").join(entropy("content").drop("n"), ["host", "path"]).join(sizes, ["host", "path"])
        .join(whole, "host", "left")
        .select("host", "path", "n", F.when(F.col("main"), prior + (1 - prior) * spread).otherwise(spread * free).alias("importance"))
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = tables.only(pages, (page_id, "page_id", "long"), (url, "url", "string"), (page, "html", "string"))
    pages = pages.withColumn("host", host(F.col("url")))
    nodes = tables.stored(style_nodes(pages), "style-nodes")
    low = importance(nodes).where((F.col("importance") < LEAST_IMPORTANCE) & (F.col("n") >= LEAST_PAGES))
    # one row a host: the paths of a host's low nodes are as many as its templates have nodes
    removed = tables.stored(low.groupBy("host").agg(F.collect_list("path").alias("removed")), "style-removed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                Tree(frozenset(gone or ())).feed(p or "").main_text()
                for p, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            ]
            yield tables.record([
                ("page_id", pa.int64(), b.column(0)), ("url", pa.string(), b.column(1)), ("text", pa.string(), texts),
                ("n_chars", pa.int64(), [len(t) for t in texts]),
            ])

    joined = pages.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    return joined.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tables.read(spark, sf_dir, "pages"))
