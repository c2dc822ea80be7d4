"""The suggest run: pool to model input, model output to saved proposals.

Two lazy plans with the model call between them; the model itself is outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.lineage import cut, store
from newsflow.operators import entities as ent
from newsflow.operators import lifecycle, pool, stories


@dataclass
class SuggestInput:
    pool: DataFrame
    index: DataFrame
    partition: DataFrame
    batches: DataFrame


def suggest_input(
    ra: DataFrame, sources: DataFrame, surfaces: DataFrame, limit: int, preferred: str | None = None,
    policy: str = "cohort_fair_v1",
) -> SuggestInput:
    """Pick the pool on narrow columns, read the wide ones for it, match, select, batch.

    The pool, its articles and their entities are a few hundred rows; each is computed once.
    """
    chosen = cut(pool.select_pool(ra, pool.clamp_limit(limit), preferred, policy))
    wide = cut(stories.attach_source(pool.hydrate(chosen, ra), sources))
    index = cut(ent.entity_index(wide, surfaces))
    rows = ent.select_quota(ent.partition_articles(wide, index), ["pool_pos"])
    return SuggestInput(chosen, index, rows, ent.assign_batches(rows.where("selected"), ["pool_pos"]))


@dataclass
class SuggestOutcome:
    normalized: DataFrame
    merged: DataFrame
    ranked: DataFrame
    filtered: DataFrame
    ledger: DataFrame


def suggest_outcome(
    outputs: DataFrame, articles_in: DataFrame, index: DataFrame, surfaces: DataFrame, proposals: DataFrame,
    articles: DataFrame, clusters: DataFrame, rules: DataFrame, as_of: Column,
) -> SuggestOutcome:
    """Parse answers (run_id, output_id, response), keep singletons, normalise, merge, rank, filter."""
    parsed = stories.parse_proposals(outputs).join(outputs.select("output_id", "run_id"), "output_id")
    groups = parsed.where("is_singleton").select(
        "run_id", F.concat_ws("-", "output_id", F.lpad(F.col("proposal_no").cast("string"), 6, "0")).alias("group_id"),
        F.lit(0).cast("long").alias("pos"),  # the id alone gives the order: answers, then their proposals
        "topic", "keywords", "article_ids", "reason", "common_entities", "cohesion_score",
    )
    # the ledger reads the checked proposals again
    normalized = store(stories.normalize_proposals(groups, stories.article_features(articles_in, index)))
    merged = stories.merge_groups(normalized.where("drop_reason IS NULL"))
    ranked = stories.rank_groups(merged, surfaces, as_of)
    filtered = stories.filter_known(ranked, proposals, articles, clusters, rules)
    return SuggestOutcome(normalized, merged, ranked, filtered, stories.drop_ledger(normalized, merged, ranked, filtered))


def finish_run(
    ra: DataFrame, chosen: DataFrame, saved: DataFrame, failed_ids: DataFrame, all_failed: bool, ts: Column
) -> DataFrame:
    """New snapshot of the raw articles: saved members suggested, evaluated ids checked."""
    members = saved.select(F.explode("article_ids").alias("id"))
    out = lifecycle.mark(ra, members, ts, "suggested")
    done = pool.completion(chosen.select("id"), failed_ids, all_failed).where("outcome = 'checked'")
    return lifecycle.mark(out, done.select("id"), ts)
