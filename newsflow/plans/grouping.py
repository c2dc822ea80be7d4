"""Extended grouping: every eligible article, without a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsflow.functions.lineage import cut
from newsflow.operators import entities as ent
from newsflow.operators import pool, stories
from newsflow.operators.components import components


def extended_groups(ra: DataFrame, surfaces: DataFrame, top: int = stories.TOP_GROUPS) -> DataFrame:
    """Top groups of articles about one story among all eligible articles."""
    rows = ra.where(pool.is_eligible())
    # the index and the edges are read several times below: each is computed once
    index = cut(ent.entity_index(rows, surfaces))
    edges = cut(stories.pair_edges(stories.entity_members(index), index, rows))
    trimmed = stories.trim_components(components(edges), edges)
    return stories.label_components(trimmed, index, surfaces, top)
