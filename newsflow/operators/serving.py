"""Serving queries: listings, images, popularity, taxonomy, search, article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.joins import first_per_key, salted_join, top_per_key, top_rows
from newsflow.functions.text import SP, or_empty, rxi, squash, strip

# --- fixed values: listing sizes, taxonomy aliases, blocked image path, interview patterns, tiers ---
LISTING = 200
TOP_PATHS = 500
CATEGORY_ALIASES = {
    "festival": ["festival", "festivals", "event", "events", "residency", "residencies", "페스티벌", "행사", "레지던시"],
    "release": ["release", "releases", "릴리즈", "신보"],
    "news": ["news", "뉴스"],
    "interview": ["interview", "인터뷰"],
}
GENRE_ALIASES = {
    "house": ["house", "하우스"],
    "techno": ["techno", "테크노"],
    "edm": [
        "edm", "electronic dance music", "electronic", "dance", "trance", "트랜스", "drum and bass",
        "drum & bass", "drum-and-bass", "dnb", "d&b", "dubstep", "덥스텝", "ambient", "앰비언트",
    ],
}
BLOCKED_IMAGE_PATH = "static.ra.co/images/"
INTERVIEW_URL = ["/interview/", "/interviews/", "/feature/", "/features/", "/talks/", "/conversation/"]
INTERVIEW_TITLE = [
    "interview", "in conversation", "conversation with", "talks to", "speaks to", "chats to", "catches up", "Q&A",
]
INTERVIEW_CONTENT = ["interview", "in conversation", "talks to", "speaks to", "catches up"]
SOURCE_TIERS = {
    "A": [
        "Mixmag", "DJ Mag", "The Quietus", "Crack Magazine", "Ransom Note", "5 Magazine", "909originals",
        "Create Digital Music", "Groove Magazine", "Tsugi", "Attack Magazine", "Bandcamp Daily",
    ],
    "B": [
        "Electronic Groove", "When We Dip", "Data Transmission", "Decoded Magazine", "Synthtopia",
        "DJ TechTools", "FAZEmag", "EDM Identity",
    ],
    "C": ["EDM Sauce", "EDMTunes", "We Rave You", "EDM Maniac", "RaverRafting", "By The Wavs", "The Nocturnal Times"],
    "manual": ["Resident Advisor", "Beatportal"],
}
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMPTY_DESCRIPTION = "한국어 EDM 뉴스 종합"
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\((https?://[^)\s]+)\)"
ATTRIBUTION = r"^\*([^\n]*?)\[([^\]]+)\]\((https?://[^)\s]+)\)([^\n]*?)\*$"
# --- end of fixed values ---


def taxonomy_slug(col: Column) -> Column:
    """Lower-case slug with hyphens; Hangul is kept."""
    out = F.regexp_replace(F.lower(strip(or_empty(col))), "&", " and ")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")


def _slug_text(value: str) -> str:
    import re

    out = re.sub("[^a-z0-9가-힣]+", "-", value.strip().lower().replace("&", " and "))
    return out.strip("-")


def taxonomy_key(col: Column, aliases: dict[str, list[str]]) -> Column:
    """The section a label belongs to through its aliases, else its own slug."""
    slug = taxonomy_slug(col)
    out = slug
    for key, names in aliases.items():
        out = F.when(slug.isin([_slug_text(n) for n in names]), key).otherwise(out)
    return out


def category_key(col: Column) -> Column:
    return taxonomy_key(col, CATEGORY_ALIASES)


def genre_key(col: Column) -> Column:
    return taxonomy_key(col, GENRE_ALIASES)


def taxonomy_match(col: Column, slug: str, aliases: dict[str, list[str]] | None = None) -> Column:
    """True when the label and the slug name the same section."""
    a = CATEGORY_ALIASES if aliases is None else aliases
    return taxonomy_key(col, a) == taxonomy_key(F.lit(slug), a)


def taxonomy_params(articles: DataFrame) -> DataFrame:
    """(kind, slug): distinct non-empty taxonomy slugs of published articles."""
    pairs = F.array(
        F.struct(F.lit("category").alias("kind"), taxonomy_slug(F.col("category")).alias("slug")),
        F.struct(F.lit("genre").alias("kind"), taxonomy_slug(F.col("genre")).alias("slug")),
    )
    return articles.where("published").select(F.inline(pairs)).where("slug <> ''").distinct()


def usable_image(col: Column) -> Column:
    return F.coalesce(
        col.rlike("(?i)^https?://") & ~F.contains(F.lower(col), F.lit(BLOCKED_IMAGE_PATH)), F.lit(False)
    )


def first_markdown_image(content: Column) -> Column:
    url = F.regexp_extract(or_empty(content), MARKDOWN_IMAGE, 2)
    return F.when(url != "", url)


def resolve_image(articles: DataFrame, links: DataFrame, ra: DataFrame, markdown: bool = True) -> DataFrame:
    """``articles`` with ``resolved_image``: own image, else a cluster member's, else one in the text.

    The first member is the one with the smallest id.
    """
    ids = articles.where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
    member = (
        links.join(ids, "cluster_id", "left_semi")
        .join(ra.where(usable_image(F.col("image_url"))).select(F.col("id").alias("raw_article_id"), "image_url"), "raw_article_id")
        .groupBy("cluster_id").agg(F.min_by("image_url", "raw_article_id").alias("_member"))
    )
    choice = [F.when(usable_image(F.col("image_url")), F.col("image_url")), F.col("_member")]
    if markdown:
        choice.append(first_markdown_image(F.col("content")))
    return articles.join(member, "cluster_id", "left").withColumn("resolved_image", F.coalesce(*choice)).drop("_member")


def _newest(articles: DataFrame, n: int) -> DataFrame:
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    return top_rows(articles.where("published"), order, n, "newest_pos")


def latest_articles(
    articles: DataFrame, links: DataFrame, ra: DataFrame, category: str | None = None,
    genre: str | None = None, limit: int = 50,
) -> DataFrame:
    """Newest 200 published articles, then the category and genre, then the limit, with images."""
    rows = _newest(articles, LISTING)
    if category:
        rows = rows.where(taxonomy_match(F.col("category"), category))
    if genre:
        rows = rows.where(taxonomy_match(F.col("genre"), genre, GENRE_ALIASES))
    rows = top_rows(rows, [F.col("newest_pos").asc()], limit, "pos").drop("newest_pos")
    return resolve_image(rows, links, ra, markdown=False)


def popular_articles(views: DataFrame, articles: DataFrame, latest: DataFrame, k: int = 5) -> DataFrame:
    """(id, slug, pos): most viewed published articles, filled up from ``latest`` (id, slug, pos)."""
    top = top_rows(views.select("slug", "views_30d"), [F.col("views_30d").desc(), F.col("slug").asc()], k, "v")
    top = top.where("views_30d > 0")
    # at most k rows
    hit = articles.where("published").select("id", "slug").join(F.broadcast(top), "slug")
    hit = hit.select("id", "slug", F.lit(0).alias("part"), F.col("v").alias("p"))
    rest = latest.join(hit, "id", "left_anti").select("id", "slug", F.lit(1).alias("part"), F.col("pos").alias("p"))
    return top_rows(hit.unionByName(rest), [F.col("part").asc(), F.col("p").asc()], k, "pos").select("id", "slug", "pos")


def article_slug(path: Column) -> Column:
    """Decoded slug of an article path, null for other paths."""
    bare = F.regexp_replace(path, "[?#].*$", "")
    slug = strip(F.try_url_decode(F.regexp_extract(bare, "^/articles/([^/]+)/?$", 1)))
    return F.when(slug != "", slug)


def page_view_counts(page_views: DataFrame, as_of: Column, n: int = TOP_PATHS) -> DataFrame:
    """(path, views) of the 30 days up to ``as_of``: the ``n`` most viewed paths."""
    since = as_of - F.expr("INTERVAL 30 DAYS")
    counts = page_views.where((F.col("ts") >= since) & (F.col("ts") <= as_of)).groupBy("path").agg(F.count("*").alias("views"))
    return counts.orderBy(F.col("views").desc(), F.col("path").asc()).limit(n)


def sync_views(page_views: DataFrame, current: DataFrame, as_of: Column, n: int = TOP_PATHS) -> DataFrame:
    """New snapshot of (slug, views_30d, updated_at): counted slugs replaced, others kept."""
    fresh = (
        page_view_counts(page_views, as_of, n).withColumn("slug", article_slug(F.col("path")))
        .where("slug IS NOT NULL").groupBy("slug").agg(F.sum("views").alias("_v"))
    )
    return current.join(fresh, "slug", "full_outer").select(
        "slug", F.coalesce("_v", "views_30d").alias("views_30d"),
        F.when(F.col("_v").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _like(text: str) -> str:
    return "%" + "".join("\\" + c if c in "\\%_" else c for c in text) + "%"


def search_articles(
    articles: DataFrame, text: str, fields: tuple[str, ...] = ("title", "content"),
    published: bool | None = True, limit: int = 30,
) -> DataFrame:
    """Case-insensitive substring search; wildcards in the text count as characters.

    Published results are newest first by publication, others by creation.
    """
    rows = articles if published is None else articles.where(F.col("published") == published)
    cond = F.lit(False)
    for f in fields:
        cond = cond | F.coalesce(F.ilike(F.col(f), F.lit(_like(text)), F.lit("\\")), F.lit(False))
    order = F.col("published_at").desc_nulls_last() if published else F.col("created_at").desc_nulls_first()
    narrow = rows.where(cond).select("id", "slug", "title", "published", "published_at", "created_at", "category")
    return top_rows(narrow, [order, F.col("id").asc()], limit, "pos")


def lookup_articles(articles: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id): the published article with that slug, else with that id when it is a UUID."""
    pub = articles.where("published").select("id", "slug")
    by_slug = keys.join(pub.where("slug IS NOT NULL").select(F.col("slug").alias("key"), F.col("id").alias("_s")), "key", "left")
    ids = pub.where(F.col("id").rlike(UUID)).select(F.col("id").alias("key"), F.col("id").alias("_i"))
    return by_slug.join(ids, "key", "left").select("key", F.coalesce("_s", "_i").alias("id"))


def related_articles(articles: DataFrame, per_article: int = 3) -> DataFrame:
    """(id, related_id, pos): up to three others among the category's newest ten listed articles."""
    listed = _newest(articles.select("id", "category", "published", "published_at"), LISTING)
    top = top_per_key(listed.withColumn("ck", category_key(F.col("category"))), ["ck"], [F.col("newest_pos").asc()], 10, "r")
    # at most LISTING rows in all, so the lists fit a broadcast
    lists = top.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("l"))
    rows = articles.where("published AND category IS NOT NULL AND category <> ''").select("id", category_key(F.col("category")).alias("ck"))
    joined = rows.join(F.broadcast(lists), "ck")
    others = F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, per_article)
    return joined.select("id", F.posexplode(others).alias("p", "x")).select(
        "id", F.col("x.id").alias("related_id"), (F.col("p") + 1).alias("pos")
    )


def content_blocks(articles: DataFrame, leading: str = "image_url") -> DataFrame:
    """Ordered blocks of each article: (id, pos, kind, text, alt, href).

    Kinds: image, attribution, paragraph.  A leading image the text lacks comes first.
    """
    text = F.col("content")
    mark = F.regexp_replace(text, MARKDOWN_IMAGE, "\u0000\u0001$1\u0001$2\u0000")
    pieces = F.split(mark, "\u0000")

    def blocks(x: Column) -> Column:
        image = F.split(x, "\u0001")
        paras = F.filter(F.transform(F.split(x, "\n\n"), strip), lambda s: s != "")
        return F.when(
            x.startswith("\u0001"),
            F.array(_block(F.lit("image"), F.lit(None), strip(image[1]), strip(image[2]))),
        ).otherwise(F.transform(paras, _paragraph))

    lead = strip(F.col(leading))
    first = F.when(
        (lead != "") & ~F.contains(text, lead),
        F.array(_block(F.lit("image"), F.lit(None), F.lit(""), lead)),
    ).otherwise(F.array().cast(f"array<{_BLOCK}>"))
    all_blocks = F.concat(first, F.flatten(F.transform(pieces, blocks)))
    rows = articles.where(strip(or_empty(text)) != "").select("id", F.posexplode(all_blocks).alias("pos", "b"))
    return rows.select("id", "pos", "b.kind", "b.text", "b.alt", "b.href")


_BLOCK = "struct<kind:string,text:string,alt:string,href:string>"


def _block(kind: Column, text: Column, alt: Column, href: Column) -> Column:
    return F.struct(
        kind.alias("kind"), text.cast("string").alias("text"), alt.cast("string").alias("alt"),
        href.cast("string").alias("href"),
    ).cast(_BLOCK)


def _paragraph(p: Column) -> Column:
    link = F.regexp_extract(p, ATTRIBUTION, 3)
    return F.when(
        link != "",
        _block(
            F.lit("attribution"),
            F.concat(F.regexp_extract(p, ATTRIBUTION, 1), F.lit("|"), F.regexp_extract(p, ATTRIBUTION, 4)),
            F.regexp_extract(p, ATTRIBUTION, 2), link,
        ),
    ).otherwise(_block(F.lit("paragraph"), p, F.lit(None), F.lit(None)))


def meta_description(content: Column) -> Column:
    """One line of at most 155 characters, cut at a word."""
    flat = squash(F.regexp_replace(content, r"!\[[^\]]*\]\(https?://[^)\s]+\)", " "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, 152), f"[{SP}]+[^{SP}]*$", ""), F.lit("..."))
    return F.when(flat == "", EMPTY_DESCRIPTION).when(F.length(flat) <= 155, flat).otherwise(cut)


def discover_interviews(ra: DataFrame, limit: int = 100) -> DataFrame:
    """Newest open articles that look like interviews, by URL, title or text."""
    state = F.col("suggestion_state")
    cond = F.lit(False)
    for col, words in (("url", INTERVIEW_URL), ("title", INTERVIEW_TITLE), ("content", INTERVIEW_CONTENT)):
        for w in words:
            cond = cond | F.coalesce(F.ilike(F.col(col), F.lit(f"%{w}%")), F.lit(False))
    rows = ra.where(state.isNull() | state.isin("new", "suggested")).where(cond)
    narrow = rows.select("id", "title", "url", "published_at", "suggestion_state")
    return top_rows(narrow, [F.col("published_at").desc_nulls_last(), F.col("id").asc()], limit, "pos")


def apply_tiers(sources: DataFrame, tiers: dict[str, list[str]] | None = None) -> DataFrame:
    """``sources`` with ``tier`` by name; an unlisted name keeps its tier, ``B`` without one."""
    old = F.col("tier") if "tier" in sources.columns else F.lit(None).cast("string")
    out = F.coalesce(old, F.lit("B"))
    for tier, names in (tiers or SOURCE_TIERS).items():
        out = F.when(F.col("name").isin(names), tier).otherwise(out)
    return sources.withColumn("tier", out)


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """``sources`` plus the new ones whose URL is not there yet."""
    fresh = first_per_key(new, ["url"], [F.col("name").asc()]).join(sources.select("url"), "url", "left_anti")
    return sources.unionByName(fresh, allowMissingColumns=True)


def tier_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("tier").agg(F.count("*").alias("n"))
