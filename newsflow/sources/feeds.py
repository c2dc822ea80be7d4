"""Feed heads and published exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.joins import top_per_key
from newsflow.functions.text import or_empty

# --- fixed values: export sizes, taxonomy pages, XML names of special characters ---
FEED_HEAD, FEED_SIZE, FEED_TEXT, SITEMAP_SIZE = 10, 50, 200, 5000
CATEGORY_PAGES = ["festival", "release", "news", "interview"]
GENRE_PAGES = ["house", "techno", "edm"]
XML_NAMES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
# --- end of fixed values ---


def head_per_source(items: DataFrame, n: int = FEED_HEAD, source: str = "source_id", pos: str = "pos") -> DataFrame:
    """First ``n`` items of each feed by feed position."""
    return top_per_key(items, [source], [F.col(pos).asc()], n, "head_rank").drop("head_rank")


def escape_xml(col: Column) -> Column:
    for raw, name in XML_NAMES:
        col = F.replace(col, F.lit(raw), F.lit(name))
    return col


def feed_rows(articles: DataFrame, site: str) -> DataFrame:
    """Items of the published feed: newest 50 articles, those with a slug, as escaped fields."""
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    top = articles.where("published").select("id", "slug", "title", "content", "published_at", "category").orderBy(*order).limit(FEED_SIZE)
    date = F.date_format(F.to_utc_timestamp("published_at", F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return top.where("slug <> ''").select(
        "id",
        escape_xml(F.col("title")).alias("title"),
        escape_xml(F.concat(F.lit(f"{site}/articles/"), "slug")).alias("link"),
        escape_xml(F.substring("content", 1, FEED_TEXT)).alias("description"),
        F.coalesce(date, F.lit("")).alias("pub_date"),
        escape_xml(or_empty(F.col("category"))).alias("category"),
    )


def feed_xml(rows: DataFrame) -> DataFrame:
    """One ``<item>`` text per feed row."""
    tags = [("title", "title"), ("link", "link"), ("description", "description"), ("pubDate", "pub_date"), ("category", "category")]
    parts = [F.concat(F.lit(f"<{t}>"), F.col(c), F.lit(f"</{t}>")) for t, c in tags]
    return rows.select("id", F.concat(F.lit("<item>"), *parts, F.lit("</item>")).alias("value"))


def sitemap_rows(articles: DataFrame, site: str, as_of: Column) -> DataFrame:
    """(loc, lastmod, changefreq, priority): home, section pages and the newest 5000 articles."""
    fixed = [("/", "hourly", "1.0")]
    fixed += [(f"/category/{s}/", "daily", "0.7") for s in CATEGORY_PAGES]
    fixed += [(f"/genre/{s}/", "daily", "0.6") for s in GENRE_PAGES]
    pages = F.array(*[
        F.struct(F.lit(site + p).alias("loc"), as_of.alias("lastmod"), F.lit(f).alias("changefreq"), F.lit(r).alias("priority"))
        for p, f, r in fixed
    ])
    one = articles.sparkSession.range(1).select(F.inline(pages))
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    top = articles.where("published").select("id", "slug", "published_at", "updated_at", "created_at").orderBy(*order).limit(SITEMAP_SIZE)
    rows = top.where("slug <> ''").select(
        F.concat(F.lit(f"{site}/articles/"), "slug", F.lit("/")).alias("loc"),
        F.coalesce("updated_at", "published_at", "created_at").alias("lastmod"),
        F.lit("daily").alias("changefreq"), F.lit("0.8").alias("priority"),
    )
    return one.unionByName(rows)


def redirect_rows(articles: DataFrame) -> DataFrame:
    """Redirects from id to slug for the published articles of the sitemap."""
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    top = articles.where("published").select("id", "slug", "published_at").orderBy(*order).limit(SITEMAP_SIZE)
    return top.where("slug <> ''").select(
        F.concat(F.lit("/articles/"), "id", F.lit("/")).alias("source"),
        F.concat(F.lit("/articles/"), "slug", F.lit("/")).alias("target"), F.lit(301).alias("status"),
    )
