"""Page extraction: titles, text, media, times, links, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.dates import explicit_dates, has_month_day, listing_date, parse_iso, url_date
from newsflow.functions.html import scan_pages
from newsflow.functions.joins import top_rows
from newsflow.functions.lineage import settled
from newsflow.functions.text import (
    BOILERPLATE, SP, any_match, clean_text, decode_entities, html_to_text, once, or_empty, rx, rxi, says, squash, strip,
)
from newsflow.functions.unicode import nfkc
from newsflow.functions.urls import canonical_url, host_key, url_part

# --- fixed values: thresholds, patterns and word lists of the page rules ---
TITLE_MIN, TITLE_MAX = 8, 220
TITLE_SITE = r"\s+[-|–—]\s+(Bandcamp Daily|Beatportal|Attack Magazine|Inverted Audio|Mixmag|DJ Mag)$"
BAD_TITLE = r"^(page not found|not found|404|403|forbidden|access denied)\b"
CHROME = ["header", "nav", "footer", "aside", "form"]
EMBEDS = [
    r"https?://(?:www\.|m\.)?youtube\.com/watch\?[^\s\"'<>]*v=[\w-]+[^\s\"'<>]*",
    r"https?://(?:www\.)?youtu\.be/[\w-]+(?:[^\s\"'<>]*)?",
    r"https?://(?:www\.)?youtube(?:-nocookie)?\.com/embed/[\w-]+(?:[^\s\"'<>]*)?",
    r"https?://(?:[\w-]+\.)*soundcloud\.com/[^\s\"'<>]+",
    r"https?://open\.spotify\.com/(?:track|album|playlist)/[A-Za-z0-9]+(?:[^\s\"'<>]*)?",
]
JS_SIGNALS = [
    "enable javascript", "javascript is required", "please turn javascript on", "__next_data__",
    'id="__nuxt"', "data-reactroot",
]
PLAIN_MIN, JS_MIN = 800, 4000
IMAGE_META = ["og:image:secure_url", "og:image:url", "og:image", "twitter:image", "twitter:image:src", "link:image_src"]
IMAGE_KEYS = ["image", "thumbnailurl"]
DECORATIVE = (
    r"(?:^|[/_\-.])(?:logo|logos|icon|icons|favicon|sprite|sprites|avatar|placeholder|blank|spacer|pixel|watermark"
    r"|loading|loader|arrow|btn|button|social|share|noimage|no-image|dummy|default-thumb)(?:[/_\-.]|$)"
)
DECORATIVE_ATTR = r"\b(?:logo|icon|sprite|avatar|favicon|badge)\b"
NOT_PHOTO = r"\.(?:svg|ico|gif)$"
MIN_EDGE = 200
PUBLISHED_LD = ["datepublished", "datemodified", "uploaddate"]
PUBLISHED_META = [
    "article:published_time", "article:modified_time", "og:published_time", "og:updated_time", "datepublished",
    "datemodified", "date", "pubdate", "publishdate", "publish_date", "dc.date", "dc.date.issued", "dcterms.date",
    "dcterms.created", "parsely-pub-date", "sailthru.date",
]
PUBLISHED_ATTR = r"(?:published|pubdate|post-date|posted|entry-date|article-date)"
ITEM_EXCLUDE = [
    ("pagination_excluded", r"(?:/page/\d+/?$|/p/\d+/?$|[?&](?:paged|page)=\d+(?:&|$))"),
    ("archive_excluded", r"/(?:category|categories|tag|tags|archive|archives)(?:/|$)"),
    ("archive_excluded", r"/(?:19|20)\d{2}[-/](?:0?[1-9]|1[0-2])(?:/(?:0?[1-9]|[12]\d|3[01]))?/?$"),
    ("collection_excluded", r"/(?:news|articles?|events?|posts?|schedule)/?$"),
]
ITEM_PATH = (
    r"/(?:news|article|articles|event|events|party|schedule|lineup|posts?|topics?)/|/\d{4}/(?:\d{1,2}/)?"
    r"|/\d{4}-\d{1,2}-\d{1,2}(?:/|$)"
)
WORLDWIDE_PATH = r"/worldwide/[^/]+/?$"
ASSET_PATH = r"\.(?:avif|css|gif|ico|jpe?g|js|json|mp3|mp4|pdf|png|svg|webp|xml)(?:$|\?)"
NAV_TEXT = (
    r"^(?:home|about|contact|privacy|terms|login|sign in|sign up|search|menu|next|previous|facebook|instagram|twitter"
    r"|x|youtube|tiktok|more)$"
)
SKIP_SEGMENTS = ["about", "contact", "cookiepolicy", "create", "login", "privacy", "register", "search", "signup", "terms"]
COLLECTIONS = ["article", "articles", "event", "events", "news", "post", "posts", "schedule"]
PREFIX_MARKERS = ["news", "article", "articles", "event", "events"]
NEWS_SEGMENTS = ["news", "article", "articles", "post", "posts", "topics"]
NOISE_LINES = [
    "advertisement", "advertisements", "comments", "leave a comment", "add comment", "related articles", "read more",
    "subscribe", "newsletter", "login", "search", "share", "email", "facebook", "twitter", "reddit", "pinterest",
    "whatsapp", "telegram", "tags", "previous article", "next article", "more from author", "comments are closed",
    "sign up", "contact us", "submit music", "become a member", "members login", "share this article", "leave a reply",
    "사진 출처", "photo credit",
]
SHOP = [
    r"shop secure", r"secure (purchase|shopping|checkout)", r"world'?s largest", r"fast (shipping|delivery)",
    r"all major brands", r"full (product )?line.?up", r"lowest prices?", r"online store", r"add to (cart|basket)", r"in stock",
]
CREDIT_LINES = [
    r"^(photo|image)(graphy)?\s*(credit|by)?:?", r"^사진\s*출처:?", r"^photos? courtesy", r"^pictured?:", r"^credits:",
    r"^tags?:", r"^categories?:", r"^[a-z\s]+ \- [a-z]{3,}\s\d{1,2},\s\d{4}$", r"^by\s+[a-z\s]+$",
    r" - cdm create digital music",
]
STOP_MARKERS = ["\nMost Popular\n"]
MARKDOWN_MAX = 120000
# --- end of fixed values ---


# --- titles and text ------------------------------------------------------------------


def _meta_content(html: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose ``key`` attribute is ``value``; null without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    attr = lambda t, n: F.regexp_extract(t, rf"(?i)[\s\"']{n}\s*=\s*[\"']([^\"']*)[\"']", 1)
    hits = F.filter(tags, lambda t: (F.lower(attr(t, key)) == value) & (attr(t, "content") != ""))
    return F.when(F.size(hits) > 0, strip(decode_entities(attr(hits[0], "content"))))


def is_url_like(title: Column) -> Column:
    """Title that is or holds a URL or a domain."""
    t = F.lower(strip(title))
    return (
        t.rlike(r"^https?://") | t.rlike(r"^www\.") | t.rlike(rx(r"\bhttps?\b")) | t.rlike(rx(r"\bwww\b"))
        | t.rlike(rx(r"\b[a-z0-9-]+\.(com|net|org|co|uk|de|fr|io|fm)\b"))
    )


def title_from_url(url: Column) -> Column:
    """Title from the last path segment of eight characters or more, else null."""
    path = url_part(url, 3)
    slug = F.regexp_extract(path, "([^/]+)/*$", 1)
    words = F.regexp_replace(F.regexp_replace(slug, r"(?i)\.[a-z0-9]+$", ""), "[-_]+", " ")
    # the first letter of each ASCII word is raised; the rest keeps its case
    pieces = F.regexp_extract_all(words, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    title = strip(F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), ""))
    return F.when((url_part(url, 1) != "") & (F.length(title) >= TITLE_MIN), title)


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the first usable of og, twitter, h1 and title, else the URL's slug."""
    html = F.col("html")
    tag = lambda n: F.regexp_extract(html, rf"(?is)<{n}(?![A-Za-z0-9_])[^>]*>(.*?)</{n}>", 1)
    staged = pages.select(
        "page_id", "url",
        F.array(
            _meta_content(html, "property", "og:title"), _meta_content(html, "name", "twitter:title"),
            html_to_text(tag("h1")), html_to_text(tag("title")),
        ).alias("_c"),
    )
    cleaned = staged.withColumn(
        "_c", F.transform("_c", lambda c: strip(F.regexp_replace(squash(decode_entities(or_empty(c))), rxi(TITLE_SITE), "")))
    )
    good = F.filter("_c", lambda t: (F.length(t) >= TITLE_MIN) & ~is_url_like(t) & ~t.rlike(rxi(BAD_TITLE)))
    return cleaned.withColumn("_g", good).select(
        "page_id",
        F.coalesce(F.when(F.size("_g") > 0, F.substring(F.col("_g")[0], 1, TITLE_MAX)), title_from_url(F.col("url"))).alias("title"),
    )


def _text_score(text: Column, attrs: Column) -> Column:
    low = F.lower(text)
    hits = F.lit(0)
    for p in BOILERPLATE:
        hits = hits + F.regexp_count(low, F.lit(rx(p)))
    hint = F.when(attrs.rlike(rxi(r"\b(article|post|entry|content|story|single)\b")), 500).otherwise(0)
    return F.length(text) + F.regexp_count(text, F.lit("\n")) * 80 + hint - hits * 250


def page_text(pages: DataFrame, max_chars: int | None = 20000) -> DataFrame:
    """(page_id, text, score): the best-scored of article, main, section, description and whole page."""
    bare = F.regexp_replace("html", "(?s)<!--.*?-->", " ")
    for t in CHROME:
        bare = F.regexp_replace(bare, f"(?is)<{t}[^>]*>.*?</{t}>", " ")
    staged = pages.select(
        "page_id", bare.alias("_bare"),
        F.coalesce(_meta_content(F.col("html"), "property", "og:description"), _meta_content(F.col("html"), "name", "description")).alias("_desc"),
    )
    block = r"(?is)<(article|main|section)(?![A-Za-z0-9_])([^>]*)>(.*?)</\1>"
    found = staged.select(
        "page_id",
        F.concat(
            F.transform(
                F.regexp_extract_all("_bare", F.lit(block), F.lit(0)),
                lambda b: F.struct(F.lit(1).alias("kind"), F.regexp_extract(b, block, 2).alias("attrs"), F.regexp_extract(b, block, 3).alias("raw")),
            ),
            F.array(F.struct(F.lit(2).alias("kind"), F.lit("").alias("attrs"), F.col("_desc").alias("raw"))),
            F.array(F.struct(F.lit(3).alias("kind"), F.lit("").alias("attrs"), F.col("_bare").alias("raw"))),
        ).alias("c"),
    ).select("page_id", F.posexplode("c").alias("pos", "c")).select("page_id", "pos", "c.*").where("raw IS NOT NULL")
    texts = found.withColumn("text", F.when(F.col("kind") == 2, F.col("raw")).otherwise(clean_text(html_to_text(F.col("raw"))))).drop("raw")
    long_enough = F.when(F.col("kind") == 1, F.length("text") >= 250).otherwise(F.length("text") >= 80)
    scored = texts.where(long_enough).withColumn(
        "score",
        F.when(F.col("kind") == 2, F.length("text"))
        .when(F.col("kind") == 3, _text_score(F.col("text"), F.lit("")) - 600).otherwise(_text_score(F.col("text"), F.col("attrs"))),
    )
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    out = pages.select("page_id").join(best, "page_id", "left")
    best_text = F.coalesce("b.text", F.lit(""))
    best_text = best_text if max_chars is None else F.substring(best_text, 1, max_chars)
    return out.select("page_id", strip(best_text).alias("text"), F.col("b.score").alias("score"))


def page_media(pages: DataFrame) -> DataFrame:
    """(page_id, image_url, embed_url): cover image meta and the earliest embed address."""
    html = F.col("html")
    image = F.coalesce(_meta_content(html, "property", "og:image"), _meta_content(html, "name", "twitter:image"))
    hits = F.array(*[
        F.struct(F.regexp_instr(html, F.lit("(?i)" + p)).alias("at"), F.lit(i).alias("i"), F.regexp_extract(html, "(?i)(" + p + ")", 1).alias("u"))
        for i, p in enumerate(EMBEDS)
    ])
    found = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    return pages.select("page_id", image.alias("image_url"), found["u"].alias("embed_url"))


# --- assets from one tag scan ---------------------------------------------------------


def _photo_ok(url: Column) -> Column:
    path = url_part(url, 3)
    return url.rlike("^https?://[^/]+") & ~path.rlike("(?i)" + NOT_PHOTO) & ~path.rlike("(?i)" + DECORATIVE)


def page_photo(scanned: DataFrame) -> DataFrame:
    """(page_id, photo_url): meta image, linked-data image, else the largest body image.

    Ties go to the first in document order; addresses in meta are taken as absolute.
    """
    scheme, host, path = (url_part(F.col("url"), i) for i in (1, 2, 3))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.concat(root, F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "^$", "/"))

    def absolute(u: Column) -> Column:
        return (
            F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, F.lit(":"), u))
            .when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(folder, u))
        )

    metas = F.filter(
        F.flatten(F.array(*[F.transform(F.slice(F.filter("meta", lambda m: m["key"] == k), 1, 1), lambda m: absolute(m["content"])) for k in IMAGE_META])),
        _photo_ok,
    )
    linked = F.filter(F.transform(F.filter("ld_values", lambda v: v["key"].isin(IMAGE_KEYS)), lambda v: absolute(v["value"])), _photo_ok)
    head = scanned.select(
        "page_id", F.when(F.size(metas) > 0, metas[0]).alias("m"), F.when(F.size(linked) > 0, linked[0]).alias("l"),
    )
    imgs = scanned.select("page_id", "url", F.explode("images").alias("i")).select("page_id", "url", "i.*")
    entries = F.transform(
        F.filter(F.transform(F.split("srcset", ","), strip), lambda e: e != ""),
        lambda e: F.struct(
            F.coalesce(F.regexp_extract(e, rf"(?i)[{SP}](\d+)w(?:[{SP}]|$)", 1).try_cast("long"), F.lit(0)).alias("w"),
            F.regexp_extract(e, f"^([^{SP}]+)", 1).alias("u"),
        ),
    )
    widest = F.reduce(entries, F.lit(None).cast("struct<w:bigint,u:string>"), lambda acc, e: F.when(acc.isNull() | (e["w"] > acc["w"]), e).otherwise(acc))
    imgs = imgs.withColumn("_s", widest).withColumn("u", F.when(F.col("_s").isNotNull(), absolute(F.col("_s.u"))).otherwise(F.col("src")))
    px = lambda c: F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("long"), F.lit(0))
    name = lambda i: F.coalesce(F.regexp_extract(url_part(F.col("u"), 3), r"(?<!\d)(\d{2,4})x(\d{2,4})(?!\d)", i).try_cast("long"), F.lit(0))
    declared = (px("width") > 0) & (px("height") > 0)
    named = ~declared & (name(1) > 0)
    w, h = F.when(named, name(1)).otherwise(px("width")), F.when(named, name(2)).otherwise(px("height"))
    imgs = imgs.withColumn("w", w).withColumn("h", h)
    ok = _photo_ok(F.col("u")) & ~says(F.col("attrs"), DECORATIVE_ATTR) & ~(
        (F.col("w") > 0) & (F.col("h") > 0) & ((F.col("w") < MIN_EDGE) | (F.col("h") < MIN_EDGE))
    )
    area = F.greatest(F.col("w") * F.col("h"), F.coalesce(F.col("_s.w") * F.col("_s.w"), F.lit(0)))
    body = imgs.where(ok).groupBy("page_id").agg(F.max_by("u", F.struct(area.alias("a"), (-F.col("pos")).alias("p"))).alias("b"))
    return head.join(body, "page_id", "left").select("page_id", F.coalesce("m", "l", "b").alias("photo_url"))


def page_published(scanned: DataFrame) -> DataFrame:
    """(page_id, published_at): linked data, then known meta keys, then labelled times; ISO forms only.

    Only the first tag of a meta key counts, whatever it says.
    """
    ld = F.transform(
        F.filter("ld_values", lambda v: v["key"].isin(PUBLISHED_LD)), lambda v, i: F.struct(F.lit(1).alias("tier"), i.alias("pos"), v["value"].alias("value"))
    )
    keys = F.array(*[F.lit(k) for k in PUBLISHED_META])
    firsts = once(F.filter("meta", lambda m: m["key"].isin(PUBLISHED_META)), lambda known: F.transform(
        keys, lambda k: F.get(F.filter(known, lambda m: m["key"] == k), F.lit(0))))
    meta = F.transform(
        F.filter(firsts, lambda m: m.isNotNull()), lambda m, i: F.struct(F.lit(2).alias("tier"), i.alias("pos"), m["content"].alias("value")))
    times = F.transform(
        F.filter("times", lambda t: t["label"].rlike("(?i)" + PUBLISHED_ATTR)), lambda t, i: F.struct(F.lit(3).alias("tier"), i.alias("pos"), t["stamp"].alias("value"))
    )
    stamped = F.transform(F.concat(ld, meta, times), lambda c: parse_iso(c["value"]))
    return scanned.select("page_id", F.get(F.filter(stamped, lambda at: at.isNotNull()), F.lit(0)).alias("published_at"))


def fetch_adequacy(scanned: DataFrame) -> DataFrame:
    """(page_id, n_chars, adequacy) of pages scanned for ``JS_SIGNALS``: ok, too_short or needs_script."""
    n = F.length("text")
    return scanned.select(
        "page_id", n.alias("n_chars"),
        F.when(n < PLAIN_MIN, "too_short").when(F.col("signalled") & (n < JS_MIN), "needs_script").otherwise("ok").alias("adequacy"),
    )


def page_links(scanned: DataFrame) -> DataFrame:
    """One row per anchor: page_id, page_url, pos, href, absolute, text, title, context, structured_date."""
    return scanned.select("page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("pos", "l")).select(
        "page_id", "page_url", "pos", "l.*"
    )


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda s: s != "")


def select_links(links: DataFrame, today: Column, n: int = 4, exclude: list[tuple[str, str]] | None = None) -> DataFrame:
    """Item links of listing pages: (page_id, url, item_date, class, reason).

    Upcoming dates come first, then undated links by score, then past dates on news pages;
    the first ``n`` of a page are selected.  Every considered link keeps a reason.
    """
    rules = ITEM_EXCLUDE if exclude is None else exclude
    rows = links.where(F.col("absolute").isNotNull() & (strip(or_empty(F.col("href"))) != "")).select(
        "page_id", "page_url", "pos", "href", "text", "title", "context", "structured_date",
        F.regexp_replace("absolute", "(?s)#.*$", "").alias("_whole"),
    )
    # every step is computed once a link; the links are read once, and each keeps one row until it has its reason
    rows = settled(rows, "url", once(F.col("_whole"), lambda u: F.regexp_replace(canonical_url(u), "(?s)#.*$", "")))
    rows = rows.where(F.col("url").rlike("^https?://") & (host_key(F.col("url")) == host_key(F.col("page_url"))))
    reason = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        reason = F.when(F.col("url").rlike("(?i)" + pattern), name).otherwise(reason)
    parts = F.struct(
        reason.alias("excluded"), url_part(F.col("url"), 3).alias("path"), url_part(F.col("page_url"), 3).alias("base_path"),
        _segments(url_part(F.col("url"), 3)).alias("segs"), _segments(url_part(F.col("page_url"), 3)).alias("base_segs"),
    )
    rows = settled(rows, "_p", parts)
    path, base_path, segs, base_segs = (F.col(f"_p.{c}") for c in ("path", "base_path", "segs", "base_segs"))
    prefix = F.lit("")
    for m in reversed(PREFIX_MARKERS):
        at = F.array_position(base_segs, F.lit(m)).cast("int")
        prefix = F.when(at > 0, F.concat(F.lit("/"), F.array_join(F.slice(base_segs, F.lit(1), F.greatest(at, F.lit(1))), "/"))).otherwise(prefix)
    label = strip(F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("title"), F.lit("")))
    no_slash = lambda p: F.regexp_replace(p, "/+$", "")
    worldwide = path.rlike("(?i)" + WORLDWIDE_PATH)
    keep = (
        (no_slash(path) != no_slash(base_path))
        & ~F.coalesce(F.try_element_at(segs, F.lit(-1)).isin(COLLECTIONS), F.lit(False))
        & ~F.arrays_overlap(segs, F.array(*[F.lit(s) for s in SKIP_SEGMENTS]))
        & ((prefix == "") | F.lower(path).startswith(F.concat(prefix, F.lit("/"))) | worldwide)
        & ~F.col("url").rlike("(?i)" + ASSET_PATH) & ~label.rlike("(?i)" + NAV_TEXT)
    )
    score = (
        F.when(F.concat(path, F.lit("/")).rlike("(?i)" + ITEM_PATH) | worldwide, 5).otherwise(0)
        + F.when(F.length(label) >= 12, 2).otherwise(0) + F.when(F.size(segs) >= 2, 1).otherwise(0)
    )
    excluded = F.col("_p.excluded")
    news = F.arrays_overlap(base_segs, F.array(*[F.lit(s) for s in NEWS_SEGMENTS]))
    date_text = F.concat_ws(" ", *[or_empty(F.col(c)) for c in ("structured_date", "href", "context", "text", "title")])
    rows = settled(rows, "_k", F.struct((excluded.isNull() & keep).alias("keep"), score.alias("score"))).where(excluded.isNotNull() | F.col("_k.keep")).select(
        "page_id", "url", "pos", excluded.alias("_excluded"), F.col("_k.score").alias("score"), news.alias("_news"), date_text.alias("_text"))
    # all links of a page meet in one place, where both windows work
    rows = rows.repartition("page_id").withColumn("_nth", F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.col("pos").asc())))
    cand = rows.where("_excluded IS NOT NULL OR (_nth = 1 AND score >= 2)")
    cand = settled(cand, "item_date", F.when(F.col("_excluded").isNull(), listing_date(F.col("_text"), today)))
    cls = (
        F.when(F.col("_excluded").isNotNull(), "excluded").when(F.col("item_date").isNull(), "unknown")
        .when(F.col("item_date") >= today, "future").otherwise("past")
    )
    cand = cand.withColumn("class", cls)
    days = F.datediff(F.col("item_date"), F.lit("1970-01-01").cast("date"))
    lane = F.when(F.col("class") == "future", 0).when(F.col("class") == "unknown", 1).otherwise(2)
    within = F.when(F.col("class") == "future", days).when(F.col("class") == "unknown", -F.col("score")).otherwise(-days)
    open_ = F.col("_excluded").isNull() & ((F.col("class") != "past") | F.col("_news"))
    order = Window.partitionBy("page_id").orderBy(F.col("_open").desc(), F.col("_lane").asc(), F.col("_in").asc(), F.col("pos").asc())
    ranked = cand.select("page_id", "url", "item_date", "class", "pos", "_excluded", open_.alias("_open"), lane.alias("_lane"), within.alias("_in")).withColumn(
        "_rank", F.row_number().over(order))
    rank = F.when(F.col("_open") & (F.col("_rank") <= n), F.col("_rank"))
    return ranked.select(
        "page_id", "url", "item_date", "class",
        F.coalesce("_excluded", F.when(rank.isNotNull(), "selected").when(~F.col("_open"), "past_excluded").otherwise("cap_exceeded")).alias("reason"),
        rank.alias("rank"),
    )


# --- lines and paragraphs -------------------------------------------------------------


def denoise_lines(col: Column) -> Column:
    """Text without noise lines: exact words, credits, bylines, shop copy, short fragments.

    Runs of blank lines become one; leading and trailing blanks go.
    """
    def noisy(line: Column) -> Column:
        t = strip(line)
        low = F.lower(t)
        words = F.size(F.split(t, f"[{SP}]+"))
        short = (F.length(t) < 50) & (
            F.exists(F.array(*[F.lit(n) for n in NOISE_LINES]), lambda n: F.contains(low, n))
            | ((words > 2) & (words < 10) & ~t.rlike("[.?!:,]"))
        )
        return (low != "") & (low.isin(NOISE_LINES) | any_match(t, CREDIT_LINES) | any_match(t, SHOP) | short)

    lines = F.filter(F.split(col, "\n"), lambda x: ~noisy(x))
    # blank lines are emptied first, then runs of them meet as consecutive newlines
    text = F.array_join(F.transform(lines, lambda x: F.when(strip(x) == "", "").otherwise(x)), "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, "^\n+|\n+$", "")


def _quotes_on_one_line(col: Column, left: str, right: str) -> Column:
    quoted = f"{left}[^{right}]*{right}"
    parts = F.regexp_extract_all(col, F.lit(f"(?s){quoted}|[^{left}]+|{left}"), F.lit(0))
    inner = lambda p: strip(F.regexp_replace(F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), "\n+", " "), " {2,}", " "))
    return F.array_join(
        F.transform(parts, lambda p: F.when((F.length(p) >= 2) & p.startswith(left) & p.endswith(right), F.concat(F.lit(left), inner(p), F.lit(right))).otherwise(p)), ""
    )


def reflow(df: DataFrame, col: str) -> DataFrame:
    """(…, title, body): quotes on one line, blank-line paragraphs, a short first chunk lifted as title."""
    t = _quotes_on_one_line(_quotes_on_one_line(or_empty(F.col(col)), "“", "”"), '"', '"')
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "(?<!\n)\n(?!\n)", "\n\n")
    staged = df.withColumn("_t", strip(t)).withColumn("_p", F.split("_t", "\n\n"))
    head = strip(F.col("_p")[0])
    lift = (F.size("_p") > 1) & (F.length(head) <= 150) & ~head.startswith("“") & ~head.startswith('"')
    title = strip(F.regexp_replace(head, f"^[#*_{SP}]+|[#*_{SP}]+$", ""))
    return staged.withColumn("title", F.when(lift, title).otherwise("")).withColumn(
        "body", F.when(lift, strip(F.array_join(F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))), "\n\n"))).otherwise(F.col("_t"))
    ).drop("_t", "_p")


def trim_text(col: Column, markers: list[str] | None = None, max_chars: int = MARKDOWN_MAX) -> Column:
    """Text up to the first stop marker and at most ``max_chars`` characters."""
    out = col
    for m in STOP_MARKERS if markers is None else markers:
        out = F.when(F.contains(out, F.lit(m)), F.substring_index(out, m, 1)).otherwise(out)
    return F.substring(out, 1, max_chars)


def title_backfill(ra: DataFrame, pages: DataFrame, limit: int = 30, dry_run: bool = True) -> DataFrame:
    """Newest articles with a URL for a title, with the page's title and what would change.

    ``pages`` (page_id, url, html); only the pages of the listed articles are read on.
    """
    n = min(max(limit, 1), 100)
    t = F.col("title")
    cand = ra.where(t.ilike("http%") | t.ilike("www.%")).select("id", "title", "url", "published_at")
    top = top_rows(cand, [F.col("published_at").desc_nulls_last(), F.col("id").asc()], n, "pos").where(is_url_like(t))
    # at most a hundred rows
    wanted = pages.join(F.broadcast(top.select("url").distinct()), "url", "left_semi")
    titles = page_titles(wanted).join(wanted.select("page_id", "url"), "page_id").groupBy("url").agg(F.min("title").alias("new_title"))
    out = top.join(titles, "url", "left")
    changed = F.coalesce(F.col("new_title") != F.col("title"), F.lit(False))
    return out.select(
        "pos", "id", "url", F.col("title").alias("old_title"), "new_title", changed.alias("changed"),
        (changed & F.lit(dry_run)).alias("would_update"), (changed & F.lit(not dry_run)).alias("updated"),
    )


# --- date evidence --------------------------------------------------------------------


def event_date_candidates(df: DataFrame, col: str, key: str) -> DataFrame:
    """(key, pos, event_date): fully stated dates of a text, first seen first."""
    folded = df.select(key, nfkc(F.col(col)).alias("_text"))
    return folded.select(key, F.posexplode(explicit_dates(F.col("_text"))).alias("pos", "d")).select(key, "pos", F.col("d").cast("date").alias("event_date"))


def page_date_evidence(scanned: DataFrame, markdown: str = "text") -> DataFrame:
    """(page_id, json_ld_dates, body_dates, url_date, url_supported) of each page."""
    starts = F.array_join(F.transform("ld_events", lambda e: e["start"]), " ;; ")
    staged = scanned.select(
        "page_id", "url", nfkc(starts).alias("_starts"), nfkc(F.col(markdown)).alias("_text"), url_date(F.col("url")).alias("url_date"),
    ).select(
        "page_id", "url_date", explicit_dates(F.col("_starts")).alias("_ld"), explicit_dates(F.col("_text")).alias("_body"),
        F.lower("_text").alias("_low"),
    )
    dates = lambda c: F.transform(c, lambda x: x.cast("date"))
    return staged.select(
        "page_id", dates("_ld").alias("json_ld_dates"), dates("_body").alias("body_dates"), "url_date",
        (F.col("url_date").isNotNull() & has_month_day(F.col("_low"), F.col("url_date"))).alias("url_supported"),
    )
