"""Connected components by alternating star contraction.

Each round points every neighbour at the smallest node it knows (Kiveris et al., 2014).
A hub is never gathered: minima are partial aggregates, and the join that sends a minimum
back to the hub's edges is salted.  Rounds are cut with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.joins import salted_join
from newsflow.functions.lineage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        salted_join(both.where("b > a"), low, ["a"], ["b"])
        .where("b <> m").select(F.col("m").alias("a"), "b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # edges are kept as a < b, so b's smaller neighbours are its edges
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    links = salted_join(edges, low, ["b"], ["a"]).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    roots = low.select(F.col("m").alias("a"), "b")
    return links.unionByName(roots).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an undirected edge table.

    ``component`` is the smallest id of the component.
    """
    now = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    known = mark(now)
    while True:
        before, now = now, cut(_small_star(_large_star(now)))
        last, known = known, mark(now)
        # equal marks only suggest that the round changed nothing; the sets themselves decide
        if known == last and now.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    leaves = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)
