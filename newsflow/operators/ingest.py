"""Ingest: insert-if-absent, outcomes, cohort stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.joins import first_per_key
from newsflow.functions.text import strip


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "url", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; the first occurrence of a key by ``order`` wins.

    Known keys are removed first, so that only candidates are ranked.
    """
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    return first_per_key(fresh, [key], [F.col(c).asc() for c in order])


def ingest_outcomes(items: DataFrame, existing: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``items`` (source, pos, url) with ``outcome``.

    no_link, url_exists (stored before, or earlier in this run), unique_conflict and failed
    for the given failures (url, conflict), else inserted.  One source is finished before the next.
    """
    known = existing.select("url").distinct().withColumn("_known", F.lit(True))
    fails = (failed if failed is not None else items.select("url", F.lit(False).alias("conflict")).limit(0))
    fails = fails.groupBy("url").agg(F.max("conflict").alias("_conflict"))
    first = items.where("url <> ''").groupBy("url").agg(F.min(F.struct("source", "pos")).alias("_first"))
    j = items.join(known, "url", "left").join(fails, "url", "left").join(first, "url", "left")
    is_first = (F.col("_first.pos") == F.col("pos")) & F.col("_first.source").eqNullSafe(F.col("source"))
    outcome = (
        F.when(F.coalesce(F.col("url") == "", F.lit(True)), "no_link").when(F.col("_known"), "url_exists")
        .when(F.col("_conflict"), "unique_conflict").when(F.col("_conflict").isNotNull(), "failed")
        .when(is_first, "inserted").otherwise("url_exists")
    )
    return j.withColumn("outcome", outcome).drop("_known", "_conflict", "_first")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counters per source and in total (source ``all``)."""
    kinds = ("inserted", "url_exists", "unique_conflict", "no_link", "failed")
    aggs = [F.count("*").alias("seen")] + [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    out = outcomes.rollup("source").agg(*aggs, F.grouping("source").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("source")).alias("source"), "seen", *kinds)


def ingestion_source(origin: Column, source_id: Column, source_url: Column) -> Column:
    """rss:<id>, direct_url, or correspondent:<digest of the trimmed lower-case URL>."""
    url = F.regexp_replace(F.lower(strip(source_url)), "/+$", "")
    return (
        F.when(origin == "rss", F.concat(F.lit("rss:"), source_id.cast("string")))
        .when(origin == "url", F.lit("direct_url"))
        .when(origin == "correspondent", F.concat(F.lit("correspondent:"), F.substring(F.sha2(url, 256), 1, 24)))
    )


def stamp_cohort(df: DataFrame, run_id: str, source_url: str = "source_url") -> DataFrame:
    """``df`` with one run id and the key of its ingestion source."""
    return df.withColumn("ingestion_run_id", F.lit(run_id)).withColumn(
        "ingestion_source", ingestion_source(F.col("origin"), F.col("source_id"), F.col(source_url))
    )
