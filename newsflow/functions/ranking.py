"""Exact ranks and percentiles that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.joins import salted_join

BUCKETS = 1024


def bucketed_rank(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], rank: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """Position of every row inside its ``keys`` in a total ``order``.

    ``bucket`` is a coarse ascending key that agrees with the order (such as the hour).
    Buckets are counted with partial aggregates; only rows of one bucket are sorted
    together, and their position is the count of the earlier buckets plus their own.
    With ``only`` (rows of ``keys`` and ``_bucket``) other buckets are counted but not sorted.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    if only is not None:
        rows = rows.join(only.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inner))
    return ranked.join(offsets, [*keys, "_bucket"]).withColumn(rank, F.col("_offset") + F.col("_r")).drop("_bucket", "_offset", "_r")


def lower_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(keys, p50, p90, ...): the value at index floor((n - 1) * f) of the sorted values.

    Equal values are counted together, the value range is cut into buckets, and only the
    bucket that holds the wanted index is ordered.
    """
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    span = vals.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / BUCKETS).otherwise(1.0)
    bucketed = salted_join(vals, span, list(keys), ["_v"]).withColumn(
        "_b", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BUCKETS - 1))
    )
    sums = bucketed.groupBy(*keys, "_b", "_n").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
    wanted = F.array(*[
        F.struct(F.lit(f).alias("_f"), (F.floor((F.col("_n") - 1) * f) + 1).alias("_k")) for f in fractions
    ])
    targets = sums.select(*keys, "_b", "_off", "_bc", F.explode(wanted).alias("_w")).where(
        (F.col("_w._k") > F.col("_off")) & (F.col("_w._k") <= F.col("_off") + F.col("_bc"))
    ).select(*keys, "_b", "_off", "_w._f", "_w._k")
    near = bucketed.select(*keys, "_b", "_v", "_c").join(targets, [*keys, "_b"])
    upto = Window.partitionBy(*keys, "_f").orderBy("_v")
    hit = near.withColumn("_cum", F.col("_off") + F.sum("_c").over(upto)).where(
        (F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k"))
    )
    return hit.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_f") == f, F.col("_v"))).alias(f"p{round(f * 100)}") for f in fractions]
    )


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """``a / b`` to four places, 0 when ``b`` is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, digits))
