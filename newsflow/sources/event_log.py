"""Pipeline event logs and content-addressed raw texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "ts timestamp, run_id string, pipeline string, stage string, reason string, source string, "
    "item_url string, title string, detail string"
)
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the whole stored precision


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of a folder of JSON lines; ``detail`` stays JSON text.

    The folder may be partitioned by pipeline and date, which then prune the scan.
    """
    return spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "false").option("timestampFormat", STAMP).json(path)


def write_event_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per pipeline and day.

    Events of a hot pipeline stay spread over tasks: nothing is shuffled for the layout.
    """
    out = events.withColumn("date", F.to_date("ts"))
    out.write.mode("append").partitionBy("pipeline", "date").option("timestampFormat", STAMP).json(path)


def store_raw(df: DataFrame, text_col: str, suffix: str = "txt") -> DataFrame:
    """(run_id, digest, text, path): each distinct text of a run once, named by its SHA-256."""
    rows = df.select("run_id", F.sha2(F.col(text_col), 256).alias("digest"), F.col(text_col).alias("text"))
    out = rows.where("text IS NOT NULL").groupBy("run_id", "digest").agg(F.first("text").alias("text"))
    return out.withColumn("path", F.concat_ws("/", F.lit("raw"), "run_id", F.concat(F.col("digest"), F.lit("." + suffix))))
