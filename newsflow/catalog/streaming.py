"""Registered queries: streaming jobs, run over the tables as arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.ingest import FEED_SQL, _stored
from newsflow.functions.lineage import ensure_checkpoint_dir
from newsflow.sources import driver_tables as dt
from newsflow.streaming import live


def _scratch(spark) -> str:
    """A new folder for one run in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/stream-{uuid.uuid4().hex}"


def _arriving(spark, sf_dir, name):
    """The table as arriving files; the pattern takes one file and a folder of part files alike."""
    path = f"{sf_dir}/{name}.parque"
    return spark.readStream.schema(spark.read.parquet(f"{path}t").schema).parquet(f"{path}[t]")


def _run(spark, stream):
    base = _scratch(spark)
    q = live.write_stream(stream, f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stage_counts(s, d):
    e = _arriving(s, d, "events")
    n = F.col("event_id")
    events = e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(F.array(F.lit("collect"), F.lit("suggest"), F.lit("correspondent")), (F.floor(n / 500) % 3 + 1).cast("int")).alias("pipeline"),
        F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("code_"), (n % 4).cast("string"))).alias("reason"),
    )
    return _run(s, live.live_stage_counts(events, "6 hours", "1 hour"))


def _views(s, d):
    e = _arriving(s, d, "events")
    u = F.col("user_id")
    path = F.when(F.col("event_id") % 10 == 0, "/").otherwise(F.concat(F.lit("/articles/src"), (u % 20).cast("string"), F.lit("-"), u.cast("string")))
    return _run(s, live.stream_views(e.select(F.col("ts").cast("timestamp").alias("ts"), path.alias("path"))))


def _items(s, d):
    docs = _arriving(s, d, "documents")
    n = F.col("doc_id")
    url = F.when(n % 23 == 22, "").otherwise(F.concat(F.lit("https://f.example.com/"), F.floor(n / 3).cast("long").cast("string")))
    items = docs.select(url.alias("url"), dt.at(n * 60).alias("ts")).where("url <> ''")
    base = _scratch(s)
    q = live.insert_new_items(live.stream_new_items(items), lambda: _stored(s, d), f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return s.read.parquet(f"{base}/out").select("url")


QUERIES: dict[str, Query] = {
    "stream_stage_counts": _stage_counts,
    "stream_new_items": _items,
    "stream_views": _views,
}

ORACLE: dict[str, str] = {
    "stream_stage_counts": sql("event_log", """
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, * FROM event_log)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, pipeline, stage, coalesce(reason, 'none') AS reason, count(*) AS n FROM w
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM event_log) GROUP BY ALL"""),
    "stream_new_items": "WITH " + FEED_SQL.strip() + "\nSELECT DISTINCT url FROM feed WHERE url <> '' AND url NOT IN (SELECT url FROM stored)",
    "stream_views": sql("page_views", """
v AS (SELECT ts, regexp_extract(path, '^/articles/([^/]+)/?$', 1) AS slug FROM page_views),
k AS (SELECT unnest(range(30)) AS k),
x AS (SELECT date_trunc('day', ts) - to_days(k::INT) AS window_start, slug FROM v, k WHERE slug <> '')
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, slug, count(*) AS views_30d FROM x
WHERE window_start + INTERVAL 30 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM v WHERE slug <> '') GROUP BY ALL"""),
}
