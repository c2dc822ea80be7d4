"""How a query and its SQL form are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsflow.sources import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]

_VIEWS = {
    "ra": dt.RAW_ARTICLES_SQL, "rss_sources": dt.RSS_SOURCES_SQL, "links": dt.LINKS_SQL,
    "clusters": dt.CLUSTERS_SQL, "articles": dt.ARTICLES_SQL, "proposals": dt.PROPOSALS_SQL,
    "labels_v": dt.LABELS_SQL, "dict": dt.DICTIONARY_SQL, "event_log": dt.EVENT_LOG_SQL,
    "page_views": dt.PAGE_VIEWS_SQL,
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """SQL text: the named views as CTEs, then ``body`` (more CTEs, then a SELECT)."""
    ctes = [_VIEWS[v].strip() for v in views.split()]
    head = "WITH " + ("RECURSIVE " if recursive else "")
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return head + ",\n".join(ctes) + glue + body if ctes else body
