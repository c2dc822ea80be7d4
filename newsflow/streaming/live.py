"""Streaming jobs over event logs, arriving items and page views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from newsflow.operators.ingest import insert_if_absent
from newsflow.operators.serving import article_slug


def live_stage_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per tumbling window, pipeline, stage and reason; rows later than ``delay`` are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "pipeline", "stage", F.coalesce("reason", F.lit("none")).alias("reason"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pipeline", "stage", "reason", "n")
    )


def stream_new_items(items: DataFrame, delay: str = "1 day", key: str = "url", ts: str = "ts") -> DataFrame:
    """Arriving items, each key once within the watermark."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def insert_new_items(
    stream: DataFrame, existing: Callable[[], DataFrame], path: str, checkpoint: str, key: str = "url", ts: str = "ts"
) -> StreamingQuery:
    """Append items whose key neither the table nor an earlier batch holds.

    The watermark bounds the state; the anti join against what is stored keeps the result
    exact beyond it.  A batch owns one folder, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = existing().select(key)
        if batch_id > 0:
            stored = spark.read.parquet(path)
            known = known.unionByName(stored.where(F.col("batch") < batch_id).select(key))
        insert_if_absent(batch, known, key, (ts,)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_views(page_views: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Views per article slug over the last 30 days, sliding by a day."""
    return (
        page_views.select("ts", article_slug(F.col("path")).alias("slug")).where("slug IS NOT NULL")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "30 days", "1 day").alias("w"), "slug").agg(F.count("*").alias("views_30d"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "slug", "views_30d")
    )


def upsert_views(current: DataFrame, closed: DataFrame) -> DataFrame:
    """View counts with those of the newest closed window of each slug put in."""
    newest = closed.groupBy("slug").agg(F.max_by(F.struct("views_30d", "window_end"), "window_end").alias("x"))
    return current.join(newest, "slug", "full_outer").select(
        "slug", F.coalesce("x.views_30d", "views_30d").alias("views_30d"), F.coalesce("x.window_end", "updated_at").alias("updated_at")
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the closed rows of a stream to a table, working off what has arrived."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
