"""Correspondent crawl: model answers about pages to gated articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.lineage import arrow_rows, cut
from newsflow.operators import entities as ent
from newsflow.operators import extract, gate, ingest

TEXT_ROWS = 256  # page texts sent to Python at once


def harvest(
    outputs: DataFrame, pages: DataFrame, scanned: DataFrame, surfaces: DataFrame, existing: DataFrame, today: Column,
    news_sources: list[str],
) -> DataFrame:
    """Items with their dates, bindings, gate decisions, keys and addresses.

    ``pages``: page_id, page_url, source, markdown, crawl_mode; ``outputs``: page_id,
    base_url, response; ``scanned`` from the page scan.  ``is_new`` marks accepted items
    whose address is not stored yet.  A page is parsed once.
    """
    # every step with Python is computed here
    with arrow_rows(pages.sparkSession, TEXT_ROWS):
        # answers, pages and bound items are read several times below: each is computed once
        pages, scanned = cut(pages), cut(scanned.select("page_id", "url", "meta", "images", "ld_values", "ld_events"))
        items = cut(gate.parse_items(outputs).where("status = 'ok'"))
        texts = pages.select("page_id", F.col("page_url").alias("url"), F.col("markdown").alias("text"))
        body = scanned.select("page_id", "ld_events").join(texts, "page_id")
        dated = gate.resolve_event_date(items, cut(extract.page_date_evidence(body)))
        dated = dated.withColumn("event_date", F.col("resolved_date").cast("string"))
        fresh = gate.drop_stale(dated.join(pages.select("page_id", "source", "page_url", "crawl_mode"), "page_id"), news_sources, today)
        bound = cut(gate.ground_evidence(gate.bind_items(cut(fresh), pages)).withColumn("id", F.concat_ws(":", "page_id", "item_no")))
        hay = bound.select("id", F.col("headline_en").alias("title"), F.concat_ws(" ", F.array_join("entities_en", " "), "source_text").alias("content"))
        verdict = gate.entity_gate(ent.entity_index(hay, surfaces), ["id"])
        sole = bound.groupBy("page_id").agg((F.count("*") == 1).alias("page_date_confident"))
        gated = gate.unified_gate(bound.join(verdict, "id", "left").join(sole, "page_id"))
        addressed = gate.item_image(gate.item_url(gate.candidate_key(gated)), extract.page_photo(scanned))
        addressed = cut(addressed)
    accepted = addressed.where("decision = 'accepted'").select(F.col("article_url").alias("url"), "id")
    new = ingest.insert_if_absent(accepted, existing, "url", ("id",)).select("id", F.lit(True).alias("is_new"))
    return addressed.join(new, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
