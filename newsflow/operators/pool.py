"""Candidate pool selection: fair scheduling of articles as ordered queries.

A pool is a small set of article ids (60 to 200) picked from a table of any size.  All
per-group picks are ``row_number() <= k`` filters, which Spark limits before the shuffle;
what meets in one task is never more than a few times the requested pool.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.joins import top_rows

META = [
    "id", "source_id", "origin", "published_at", "fetched_at",
    "suggestion_last_checked_at", "ingestion_run_id", "ingestion_source",
]
WIDE = ["id", "title", "content", "url", "source_id", "published_at", "event_date", "facts"]

# --- fixed values: shares, over-fetch and the ten queues with their weights ---
COHORT_RATIO = 0.7
OVERFETCH = 3
MIN_QUEUE = 12
LIMIT_MIN, LIMIT_MAX, LIMIT_STEP = 60, 200, 20
RUN_ID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
QUEUES = [
    ("rss", True, False, 4),
    ("rss", True, True, 4),
    ("correspondent", True, False, 3),
    ("correspondent", True, True, 3),
    ("rss", False, False, 1),
    ("rss", False, True, 1),
    ("correspondent", False, False, 1),
    ("correspondent", False, True, 1),
    ("legacy", False, False, 1),
    ("legacy", False, True, 1),
]
# --- end of fixed values ---


def clamp_limit(requested: int) -> int:
    """60 to 200, rounded up to a multiple of 20."""
    bounded = min(LIMIT_MAX, max(LIMIT_MIN, requested))
    return math.ceil(bounded / LIMIT_STEP) * LIMIT_STEP


def is_eligible() -> Column:
    state = F.col("suggestion_state")
    return state.isNull() | (state == "new")


def source_key() -> Column:
    """Feed rows by feed id, everything else by its ingestion source."""
    return F.when(
        (F.col("origin") == "rss") & F.col("source_id").isNotNull(),
        F.concat(F.lit("rss:"), F.col("source_id").cast("string")),
    ).otherwise(
        F.coalesce(
            "ingestion_source",
            F.concat(F.coalesce("origin", F.lit("legacy")), F.lit(":unknown")),
        )
    )


def pool_order() -> list[Column]:
    """Unchecked first, newest dated first, undated last, id as the last key."""
    return [
        F.col("suggestion_last_checked_at").asc_nulls_first(),
        F.col("published_at").desc_nulls_last(),
        F.col("fetched_at").desc(),
        F.col("id").asc(),
    ]


def queue_origin() -> Column:
    return F.when(F.col("origin").isin("rss", "correspondent"), F.col("origin")).otherwise(
        F.lit("legacy")
    )


def pool_legacy(ra: DataFrame, n: int) -> DataFrame:
    """Newest first with undated rows in front, as the old policy had it."""
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    return top_rows(ra.where(is_eligible()).select(*META), order, n, "pool_pos")


def _newest_run(when: Column) -> Column:
    """Run of the newest row that ``when`` holds for."""
    order = F.struct(-F.unix_micros("fetched_at"), F.col("id"))
    has_run = when & F.col("ingestion_run_id").isNotNull()
    return F.min_by("ingestion_run_id", F.when(has_run, order))


def pool_facts(ra: DataFrame, preferred: str | None = None) -> DataFrame:
    """One row, from one pass: run_id to favour, invalid_preferred, and the newest runs ``rss`` and ``correspondent``.

    A preferred run counts when it is a well-formed id that still has eligible rows.
    """
    pref = F.lit(preferred).cast("string")
    usable = F.coalesce(
        F.bool_or((F.col("ingestion_run_id") == pref) & pref.rlike(RUN_ID)), F.lit(False)
    )
    return ra.where(is_eligible()).agg(
        _newest_run(F.lit(True)).alias("_newest"), usable.alias("_usable"),
        *[_newest_run(F.col("origin") == o).alias(o) for o in ("rss", "correspondent")],
    ).select(
        F.when(F.col("_usable"), pref).otherwise(F.col("_newest")).alias("run_id"),
        (~F.col("_usable") & F.lit(bool(preferred))).alias("invalid_preferred"), "rss", "correspondent",
    )


def resolve_run(ra: DataFrame, preferred: str | None = None) -> DataFrame:
    """One row: the run to favour, and whether the preferred one was unusable."""
    return pool_facts(ra, preferred).select("run_id", "invalid_preferred")


def source_round_robin(
    df: DataFrame,
    order: list[Column] | None = None,
    by: tuple[str, ...] = (),
    keep: int | None = None,
    rank: str = "rr",
) -> DataFrame:
    """Position of every row when sources take turns.

    Unchecked rows come before checked ones; inside each, every source gives one row per
    turn, sources in order of their first row.  ``by`` splits the input into independent
    queues.  With ``keep`` only rows that can be among the first ``keep`` are ranked: the
    per-source limit is applied before the shuffle, so a hot source stays small.
    """
    order = order or pool_order()
    # struct comparison needs one direction, so the order is turned into a sortable key
    df = df.withColumn("_src", source_key()).withColumn(
        "_chk", F.col("suggestion_last_checked_at").isNotNull()
    )
    per_source = Window.partitionBy(*by, "_chk", "_src")
    ranked = df.withColumn("_turn", F.row_number().over(per_source.orderBy(*order)))
    if keep is not None:
        ranked = ranked.where(F.col("_turn") <= keep)
    # rows of the same turn follow the order of their sources' first rows
    heads = [F.first(c).over(per_source.orderBy("_turn")).alias(f"_h{i}")
             for i, c in enumerate(["suggestion_last_checked_at", "published_at", "fetched_at", "id"])]
    ranked = ranked.select("*", *heads)
    final = [
        F.col("_chk").asc(), F.col("_turn").asc(), F.col("_h0").asc_nulls_first(),
        F.col("_h1").desc_nulls_last(), F.col("_h2").desc(), F.col("_h3").asc(),
    ]
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    out = ranked.withColumn(rank, F.row_number().over(whole.orderBy(*final)))
    if keep is not None:
        out = out.where(F.col(rank) <= keep)
    return out.drop("_src", "_chk", "_turn", "_h0", "_h1", "_h2", "_h3")


COHORT = -1  # the lane of the favoured run; the fair queues are lanes 0 to 9


def lane_of(facts: DataFrame) -> Column:
    """Lane of a row: the favoured run's, or the fair queue it belongs to.

    The facts are one scalar (per origin the favoured run, then the newest), read at one place of the expression.
    """
    none = F.lit(None).cast("string")
    known = facts.select(F.map_from_arrays(
        F.array(*[F.lit(o) for o in ("rss", "correspondent", "legacy")]),
        F.array(F.array("run_id", "rss"), F.array("run_id", "correspondent"), F.array(F.col("run_id"), none)))).scalar()
    place = F.coalesce(F.array_position(F.element_at(known, queue_origin()), F.col("ingestion_run_id")), F.lit(0))
    # rows of the favoured run are in no queue: the cohort slice serves them
    number = {
        f"{o} {place} {str(no_date).lower()}": COHORT if place == 1 else i
        for i, (o, cohort, no_date, _) in enumerate(QUEUES) for place in ((1, 2) if cohort else (1, 0))}
    table = F.create_map(*[x for k, v in number.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(table, F.concat_ws(" ", queue_origin(), place.cast("string"), F.col("published_at").isNull().cast("string")))


def lanes(ra: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Rows that can be picked, with ``lane`` and position ``rn`` in it when its sources take turns.

    Every lane is cut to a fixed bound before the shuffle and, once the favoured run's
    share is known, to the places that are left; both cuts hold a few times ``limit`` rows.
    """
    share = math.ceil(limit * COHORT_RATIO)
    rows = ra.where(is_eligible()).select(*META, lane_of(facts).alias("lane"))
    per_lane = Window.partitionBy("lane").orderBy(*pool_order())
    rows = rows.withColumn("_fetch", F.row_number().over(per_lane)).where(F.col("_fetch") <= max(MIN_QUEUE, limit * OVERFETCH))
    in_run = F.count(F.when(F.col("lane") == COHORT, 1)).over(Window.partitionBy())
    left = limit - F.least(in_run, F.lit(share))
    bound = F.when(F.col("lane") == COHORT, share * OVERFETCH).otherwise(F.greatest(F.lit(MIN_QUEUE), left * OVERFETCH))
    rows = rows.withColumn("_bound", bound).where(F.col("_fetch") <= F.col("_bound")).drop("_fetch", "_bound")
    ranked = source_round_robin(rows, by=("lane",), rank="rn")
    return ranked.where((F.col("lane") != COHORT) | (F.col("rn") <= share))


def cohort_slice(ra: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """The favoured run's share of the pool, sources taking turns."""
    return lanes(ra, facts, limit).where(F.col("lane") == COHORT).drop("lane").withColumnRenamed("rn", "cohort_pos")


def fair_queues(ra: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Rows of the ten queues with ``queue``, ``weight`` and position ``rn`` in the queue."""
    return _weighted(lanes(ra, facts, limit).where(F.col("lane") != COHORT)).withColumnRenamed("lane", "queue")


def _weighted(rows: DataFrame, lane: str = "lane") -> DataFrame:
    weights = F.array(*[F.lit(q[3]) for q in QUEUES])
    return rows.withColumn("weight", F.try_element_at(weights, F.col(lane) + 1))


def weighted_round_robin(queues: DataFrame, limit: int, rank: str = "wrr") -> DataFrame:
    """Queues in turn, each giving ``weight`` rows per turn, cut to ``limit``."""
    turn = F.floor((F.col("rn") - 1) / F.col("weight"))
    return top_rows(
        queues.withColumn("_turn", turn),
        [F.col("_turn").asc(), F.col("queue").asc(), F.col("rn").asc()],
        limit,
        rank,
    ).drop("_turn")


def select_pool(
    ra: DataFrame,
    limit: int,
    preferred: str | None = None,
    policy: str = "cohort_fair_v1",
) -> DataFrame:
    """The pool: ids and metadata with ``pool_pos`` and ``part`` (cohort or remainder)."""
    if policy == "legacy_published_at":
        return pool_legacy(ra, limit).withColumn("part", F.lit("legacy"))
    in_run = F.col("lane") == COHORT
    rows = _weighted(lanes(ra, pool_facts(ra, preferred), limit))
    turn = F.when(in_run, F.lit(0)).otherwise(F.floor((F.col("rn") - 1) / F.col("weight")))
    order = [F.col("part").asc(), F.col("_turn").asc(), F.col("lane").asc(), F.col("rn").asc()]
    rows = rows.withColumn("part", F.when(in_run, "cohort").otherwise("remainder")).withColumn("_turn", turn)
    return top_rows(rows, order, limit, "pool_pos").select(*META, "part", "pool_pos")


def pool_diagnostics(pool: DataFrame) -> DataFrame:
    """Long report of a pool: (dimension, key, n)."""
    dims = F.array(
        F.struct(F.lit("origin").alias("dimension"), F.coalesce("origin", F.lit("legacy")).alias("key")),
        F.struct(F.lit("source").alias("dimension"), source_key().alias("key")),
        F.struct(
            F.lit("publication").alias("dimension"),
            F.when(F.col("published_at").isNull(), "null").otherwise("dated").alias("key"),
        ),
        F.struct(
            F.lit("checked").alias("dimension"),
            F.when(F.col("suggestion_last_checked_at").isNull(), "unchecked")
            .otherwise("rechecked").alias("key"),
        ),
        F.struct(F.lit("part").alias("dimension"), F.col("part").alias("key")),
    )
    return (
        pool.select(F.explode(dims).alias("d"))
        .groupBy("d.dimension", "d.key")
        .agg(F.count("*").alias("n"))
    )


def hydrate(pool: DataFrame, ra: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Wide columns for the chosen ids only.

    Of a selected pool Spark knows that it holds few rows, and sends its ids to the articles.
    """
    return ra.select(*(columns or WIDE)).join(pool.select("id", "pool_pos"), "id")


def completion(pool_ids: DataFrame, failed_ids: DataFrame, all_failed: bool) -> DataFrame:
    """Outcome per pool id: ``checked`` or ``retryable``."""
    ids = pool_ids.select("id").distinct()
    if all_failed:
        return ids.withColumn("outcome", F.lit("retryable"))
    failed = failed_ids.select("id").distinct().withColumn("_failed", F.lit(True))
    return ids.join(failed, "id", "left").select(
        "id", F.when(F.col("_failed"), "retryable").otherwise("checked").alias("outcome")
    )


# --- audit policies -------------------------------------------------------------------

AUDIT_POLICIES = ("A", "B", "C", "D_original", "D_equal")


def production_order() -> list[Column]:
    """Undated first, newest first, then last fetched, then id."""
    return [
        F.col("published_at").desc_nulls_first(), F.col("fetched_at").desc(), F.col("id").asc(),
    ]


def _fair(df: DataFrame, by: tuple[str, ...], keep: int, rank: str) -> DataFrame:
    """Sources take turns in name order; rows seen before come last in their source."""
    order = [F.col("_seen").asc(), *production_order()]
    w = Window.partitionBy(*by, "source_name").orderBy(*order)
    turns = df.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= keep)
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    return (
        turns.withColumn(rank, F.row_number().over(whole.orderBy("_turn", "source_name")))
        .where(F.col(rank) <= keep)
        .drop("_turn")
    )


def audit_pool(
    candidates: DataFrame,
    cohort_ids: DataFrame,
    newest_ids: DataFrame,
    seen_ids: DataFrame,
    limit: int,
    policy: str,
) -> DataFrame:
    """Pool under one of the audited policies: ``id``, ``pool_pos``.

    A newest first; B the cohort first; C fair queues only; D_original the cohort's share
    then weighted queues; D_equal the same with six unweighted queues.  ``candidates``
    carry ``source_name``; ``cohort_ids``/``newest_ids``/``seen_ids`` are id tables.
    """
    if policy not in AUDIT_POLICIES:
        raise ValueError(f"unknown policy {policy}")

    def flag(name: str, ids: DataFrame, df: DataFrame) -> DataFrame:
        marks = ids.select("id").distinct().withColumn(name, F.lit(True))
        return df.join(marks, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    df = candidates.select(
        "id", "origin", "published_at", "fetched_at",
        F.coalesce(
            "source_name", F.concat(F.coalesce("origin", F.lit("unknown")), F.lit(":unknown"))
        ).alias("source_name"),
    )
    if policy == "A":
        return top_rows(df, production_order(), limit, "pool_pos").select("id", "pool_pos")
    df = flag("_seen", seen_ids, flag("_newest", newest_ids, flag("_cohort", cohort_ids, df)))
    if policy == "B":
        ranked = _fair(df, ("_cohort",), limit, "_p")
        return top_rows(ranked, [F.col("_cohort").desc(), F.col("_p").asc()], limit, "pool_pos").select(
            "id", "pool_pos"
        )
    share = math.ceil(limit * COHORT_RATIO)
    undated = F.col("published_at").isNull()
    if policy == "D_equal":
        origins = ["rss", "correspondent", "legacy"]
        queue = (F.array_position(F.array(*map(F.lit, origins)), queue_origin()) - 1) * 2 + (
            undated.cast("int")
        )
        weight = F.lit(1)
    else:
        queue = F.lit(None).cast("int")
        weight = F.element_at(F.array(*[F.lit(q[3]) for q in QUEUES]), F.col("queue") + 1)
        for i, (o, cohort, no_date, _) in reversed(list(enumerate(QUEUES))):
            queue = F.when(
                (queue_origin() == o) & (undated == F.lit(no_date))
                & (F.col("_newest") == F.lit(cohort)),
                F.lit(i),
            ).otherwise(queue)
    rest = df if policy == "C" else df.where(~F.col("_cohort"))
    rest = rest.withColumn("queue", queue).where(F.col("queue").isNotNull())
    rest = _fair(rest, ("queue",), limit, "rn").withColumn("weight", weight)
    picked = weighted_round_robin(rest, limit).select("id", F.lit(1).alias("_part"), F.col("wrr").alias("_p"))
    if policy != "C":
        first = _fair(df.where("_cohort"), (), share, "_p").select("id", F.lit(0).alias("_part"), "_p")
        picked = first.unionByName(picked)
    return top_rows(picked, [F.col("_part").asc(), F.col("_p").asc()], limit, "pool_pos").select(
        "id", "pool_pos"
    )
