"""Feed collection: feed heads to new raw articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.dates import parse_published
from newsflow.functions.joins import first_per_key
from newsflow.functions.text import or_empty, strip
from newsflow.operators import extract, ingest
from newsflow.sources.feeds import head_per_source


def collect_feed(items: DataFrame, pages: DataFrame, existing: DataFrame, run_id: str) -> DataFrame:
    """New raw articles of feed items (source_id, pos, url, feed_title, pub_date).

    Only the pages of items that are new are read for their title, text and media.
    """
    heads = head_per_source(items).where(or_empty(F.col("url")) != "")
    fresh = ingest.insert_if_absent(heads, existing, order=("source_id", "pos"))
    # a page may be stored in several versions: the latest is read
    wanted = first_per_key(pages.join(fresh.select("url"), "url", "left_semi"), ["url"], [F.col("page_id").desc()])
    parts = (
        wanted.select("page_id", "url").join(extract.page_titles(wanted), "page_id")
        .join(extract.page_text(wanted).select("page_id", "text"), "page_id").join(extract.page_media(wanted), "page_id")
    )
    title = strip(or_empty(F.col("feed_title")))
    out = fresh.join(parts, "url", "left").select(
        "source_id", "url",
        F.coalesce(F.when((title != "") & ~extract.is_url_like(title), title), F.col("title"), extract.title_from_url(F.col("url")), F.lit("제목 없음")).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"), "image_url", "embed_url",
        parse_published(F.col("pub_date")).alias("published_at"), F.lit("rss").alias("origin"), F.col("url").alias("source_url"),
    )
    return ingest.stamp_cohort(out, run_id).drop("source_url")
