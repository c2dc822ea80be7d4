"""Registered queries: whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.entities import index
from newsflow.functions.html import scan_pages
from newsflow.plans import collect, crawl, grouping, suggest
from newsflow.sources import driver_tables as dt


def _input(s, d):
    got = suggest.suggest_input(dt.raw_articles(s, d), dt.rss_sources(s, d), dt.dictionary(s, d), 120)
    return got.batches.select("id", "partition", "batch", "feed_name")


def _outcome(s, d):
    ra = dt.raw_articles(s, d)
    outputs = dt.model_outputs(s, d).withColumn("run_id", F.substring("output_id", 1, 10))
    rules = dt.dictionary(s, d).where("role = 'supporting'").select(F.col("canonical").alias("pattern"), F.lit(True).alias("enabled"))
    got = suggest.suggest_outcome(
        outputs, ra, index(s, d), dt.dictionary(s, d), dt.proposals(s, d), dt.articles(s, d), dt.clusters(s, d), rules,
        F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return got.filtered.select("group_id", "rank", "score", "drop_reason", F.array_join("article_ids", ",").alias("ids"))


def _extended(s, d):
    out = grouping.extended_groups(dt.raw_articles(s, d), dt.dictionary(s, d))
    return out.select("pos", "component", "entity", F.array_join("article_ids", ",").alias("article_ids"), F.round("weight_sum", 4).alias("weight_sum"))


def _collect(s, d):
    n = F.col("doc_id")
    ra = dt.raw_articles(s, d)
    pages = dt.rich_pages(s, d)
    items = pages.join(ra.select(F.col("id").alias("page_id"), "source_name", "title", "doc_id", "fetched_at"), "page_id").select(
        F.col("source_name").alias("source_id"), n.alias("pos"), "url", F.when(n % 2 == 0, F.col("title")).otherwise(F.col("url")).alias("feed_title"),
        F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pub_date"))
    stored = items.where(n % 7 == 0).select("url")
    return collect.collect_feed(items, pages, stored, "run-1").select("url", "title", F.length("content").alias("n_chars"), "published_at", "ingestion_source")


def _crawl(s, d):
    pages = dt.harvest_pages(s, d).withColumn("crawl_mode", F.lit("page"))
    html = pages.select("page_id", F.col("page_url").alias("url"), F.concat(F.lit("<p>"), F.regexp_replace("markdown", "[<>&]", " "), F.lit("</p>")).alias("html"))
    out = crawl.harvest(
        dt.harvest_outputs(s, d), pages, scan_pages(html, only=["meta", "images", "ld_values", "ld_events"]), dt.dictionary(s, d), dt.raw_articles(s, d).select("url"),
        F.lit("2024-01-20").cast("date"), ["src0", "src4"])
    return out.select("id", "decision", "path", "candidate_key", "article_url", "image_url", "date_reason", "is_new")


QUERIES: dict[str, Query] = {
    "run_suggest_input": _input,
    "run_suggest_outcome": _outcome,
    "run_extended_grouping": _extended,
    "run_collect": _collect,
    "run_crawl": _crawl,
}
ORACLE: dict[str, str] = {}
