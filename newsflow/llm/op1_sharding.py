"""Uniform shuffle into shards of exact sizes (operator 1): a hypergeometric communication matrix.

Rows lie in logical source blocks of about ``ROWS_PER_BLOCK`` rows (by a hash of their key columns, so
the layout of files and lost executors change nothing).  How many rows each block sends to each
shard is drawn from the multivariate hypergeometric law of a uniform shuffle: first for groups of
blocks (about the square root of their number, on the driver), then in parallel inside each group.
Every block permutes its rows and deals them out by its row of the matrix; every shard
permutes what it received.  Shard sizes differ by one row at most.

Defined cases: null columns take part in the hash as nulls; rows that are equal in all key columns
share a block and are interchangeable; an empty table gives an empty result; any further columns are carried
along, and ``shard`` and ``slot`` replace input columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.lineage import cut
from newsflow.llm import tables

SHARDS = 24
ROWS_PER_BLOCK = 512
SEED = 20240501


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; exact for numbers of any size.

    The probabilities are laid out over twelve standard deviations around the mean.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(total - 1, 1))
    a, b = max(lo, int(mean - 12 * sd) - 12), min(hi, int(mean + 12 * sd) + 12)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def split(rng: np.random.Generator, room: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """A matrix of draws: row i has ``sizes[i]`` rows spread over the columns, column j sums to ``room[j]``."""
    left = [int(x) for x in room]
    out = np.zeros((len(sizes), len(left)), np.int64)
    for i, n in enumerate(sizes):
        n, rest = int(n), sum(left)
        for j, r in enumerate(left):
            rest -= r
            x = hypergeometric(rng, r, rest, n)
            out[i, j], left[j], n = x, r - x, n - x
    return out


def _matrix(blocks: DataFrame, n_blocks: int, room: np.ndarray, seed: int) -> DataFrame:
    """(block, ends): the running totals of the matrix row of each block."""
    groups = math.isqrt(n_blocks - 1) + 1
    grouped = blocks.withColumn("grp", F.pmod("block", F.lit(groups)))
    coarse = {r.grp: r.n for r in grouped.groupBy("grp").agg(F.sum("n").alias("n")).collect()}  # sqrt of the blocks
    ids = sorted(coarse)
    drawn = split(np.random.default_rng([seed, 0]), room, [coarse[g] for g in ids])
    rows = dict(zip(ids, drawn, strict=True))

    def fine(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        m = split(np.random.default_rng([seed, 1, int(key[0])]), rows[key[0]], part["n"].to_list())
        return pd.DataFrame({"block": part["block"], "ends": list(np.cumsum(m, axis=1))})

    return grouped.groupBy("grp").applyInPandas(fine, "block long, ends array<long>")


def shuffle_into_shards(
    rows: DataFrame, by: Sequence[str], n_shards: int = SHARDS, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, … within the shard)."""
    rows = cut(rows.drop("shard", "slot"))
    names = rows.columns
    n = rows.count()
    if n == 0:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    key = [F.col(f"`{c}`") for c in by]
    n_blocks = -(-n // rows_per_block)
    placed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*key).alias("key"),
        F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n_blocks)).alias("block"),
        F.xxhash64(F.lit(seed + 1), *key).alias("order1"), F.xxhash64(F.lit(seed + 2), *key).alias("order2"),
    )
    base, more = divmod(n, n_shards)
    room = np.array([base + (j < more) for j in range(n_shards)])
    matrix = _matrix(placed.groupBy("block").agg(F.count("*").alias("n")), n_blocks, room, seed)
    # permute inside the block, deal out by the matrix
    local = placed.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("order1", "key")) - 1)
    dealt = cut(local.join(matrix, "block").select(
        "row", "key", "order2", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"),
    ))
    # permute inside the shard: random parts of about a block's size, then an order inside each
    parts = -(-n // (n_shards * rows_per_block))
    dealt = dealt.withColumn("part", F.pmod(F.col("order2"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed + 3), "order2"), "key"))
    ranked = dealt.withColumn("nth", nth).join(offset, ["shard", "part"])
    return ranked.select("row.*", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.only(tables.read(spark, sf_dir, "documents"), ("doc_id", "doc_id", "long"), ("text", "text", "string"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
