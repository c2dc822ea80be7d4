"""Joins and ranks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    ``small`` has few rows per key and is repeated once per salt; a row of ``big`` picks
    its salt from ``spread_by``.  The result is that of the plain join.  When ``small``
    turns out to fit a broadcast, Spark's own size check still picks that.
    ``how``: inner, left, left_semi or left_anti (seen from ``big``).
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a hot key
    sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    """The first ``n`` rows of every key with their position in ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order: Sequence[Column], n: int, rank: str = "pos") -> DataFrame:
    """The first ``n`` rows overall, with their 1-based position.

    The top-k runs per task first; only ``n`` rows meet in the one task that numbers them.
    """
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
