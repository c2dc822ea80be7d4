"""Registered queries: candidate pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.operators import pool as p
from newsflow.sources import driver_tables as dt

LIMIT = 120
PREFERRED = "00000000-0000-4000-8000-000000000003"
ELIGIBLE = "(suggestion_state IS NULL OR suggestion_state = 'new')"
ORDER = ("suggestion_last_checked_at ASC NULLS FIRST, published_at DESC NULLS LAST, "
         "fetched_at DESC, id ASC")


def _rr_sql(source: str, by: str, out: str) -> str:
    """Round robin of ``source`` as CTEs ending in ``out`` with position rr."""
    part = f"{by}, " if by else ""
    whole = f"PARTITION BY {by}" if by else ""
    return f"""
{out}_a AS (
  SELECT *, suggestion_last_checked_at IS NOT NULL AS chk,
    row_number() OVER (ORDER BY {ORDER}) AS p FROM {source}
), {out}_b AS (
  SELECT *, row_number() OVER (PARTITION BY {part}chk, src_key ORDER BY p) AS turn,
    min(p) OVER (PARTITION BY {part}chk, src_key) AS head FROM {out}_a
), {out} AS (
  SELECT *, row_number() OVER ({whole} ORDER BY chk, turn, head) AS rr FROM {out}_b
)"""


def _pool_sql(limit: int, preferred: str | None) -> str:
    pref = f"'{preferred}'" if preferred else "NULL"
    share = -(-limit * 7 // 10)
    return f"""
elig AS (SELECT * FROM ra WHERE {ELIGIBLE}),
run AS (
  SELECT coalesce((SELECT {pref} WHERE EXISTS (SELECT 1 FROM elig WHERE ingestion_run_id = {pref})),
    (SELECT ingestion_run_id FROM elig WHERE ingestion_run_id IS NOT NULL
     ORDER BY fetched_at DESC, id LIMIT 1)) AS run_id
),
newest AS (
  SELECT origin, arg_min(ingestion_run_id, (-epoch_us(fetched_at), id)) AS run_id
  FROM elig WHERE origin IN ('rss', 'correspondent') AND ingestion_run_id IS NOT NULL GROUP BY origin
),
c0 AS (
  SELECT * FROM elig WHERE ingestion_run_id = (SELECT run_id FROM run) ORDER BY {ORDER} LIMIT {share * 3}
),
{_rr_sql('c0', '', 'c1')},
cohort AS (SELECT * FROM c1 WHERE rr <= {share}),
places AS (SELECT {limit} - count(*) AS n FROM cohort),
q0 AS (
  SELECT e.*, CASE WHEN e.origin IN ('rss', 'correspondent') THEN e.origin ELSE 'legacy' END AS qo,
    coalesce(e.ingestion_run_id = n.run_id, false) AS fresh
  FROM elig e LEFT JOIN newest n ON n.origin = e.origin
  WHERE e.ingestion_run_id IS NULL OR e.ingestion_run_id <> coalesce((SELECT run_id FROM run), '')
),
q1 AS (
  SELECT *, CASE WHEN qo = 'rss' AND fresh THEN 0 WHEN qo = 'correspondent' AND fresh THEN 2
      WHEN qo = 'rss' THEN 4 WHEN qo = 'correspondent' THEN 6 ELSE 8 END
      + CASE WHEN published_at IS NULL THEN 1 ELSE 0 END AS queue FROM q0
),
q2 AS (
  SELECT * FROM q1 QUALIFY row_number() OVER (PARTITION BY queue ORDER BY {ORDER})
    <= greatest(12, 3 * (SELECT n FROM places))
),
{_rr_sql('q2', 'queue', 'q3')},
fair AS (SELECT *, CASE WHEN queue < 2 THEN 4 WHEN queue < 4 THEN 3 ELSE 1 END AS weight FROM q3),
wrr AS (
  SELECT *, row_number() OVER (ORDER BY (rr - 1) // weight, queue, rr) AS w FROM fair
),
pool AS (
  SELECT *, row_number() OVER (ORDER BY part, pp) AS pool_pos FROM (
    SELECT id, source_id, origin, published_at, fetched_at, suggestion_last_checked_at,
      ingestion_run_id, ingestion_source, src_key, 'cohort' AS part, rr AS pp FROM cohort
    UNION ALL
    SELECT id, source_id, origin, published_at, fetched_at, suggestion_last_checked_at,
      ingestion_run_id, ingestion_source, src_key, 'remainder' AS part, w AS pp FROM wrr)
  QUALIFY row_number() OVER (ORDER BY part, pp) <= {limit}
)"""


def _ra(spark, sf_dir):
    return dt.raw_articles(spark, sf_dir)


def _pool(spark, sf_dir, preferred=None):
    return p.select_pool(_ra(spark, sf_dir), LIMIT, preferred)


def _resolve(spark, sf_dir):
    ra = _ra(spark, sf_dir)
    cases = [None, PREFERRED, "00000000-0000-4000-8000-999999999999", "not-a-run"]
    out = None
    for c in cases:
        one = p.resolve_run(ra, c).withColumn("preferred", F.lit(c or "none"))
        out = one if out is None else out.unionByName(one)
    return out


def _cohort(spark, sf_dir):
    ra = _ra(spark, sf_dir)
    return p.cohort_slice(ra, p.pool_facts(ra), LIMIT).select("id", "cohort_pos")


def _queues(spark, sf_dir):
    ra = _ra(spark, sf_dir)
    return p.fair_queues(ra, p.pool_facts(ra), LIMIT)


def _hydrate(spark, sf_dir):
    out = p.hydrate(_pool(spark, sf_dir), _ra(spark, sf_dir))
    return out.select("pool_pos", "id", "title", F.length("content").alias("n_chars"), "url", "event_date")


def _completion(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    failed = pool.where("origin = 'correspondent'").select("id")
    return p.completion(pool.select("id"), failed, False)


def _round_robin(spark, sf_dir):
    rows = _ra(spark, sf_dir).where(p.is_eligible())
    return p.source_round_robin(rows, keep=LIMIT).select("id", "rr")


def audit_inputs(spark, sf_dir):
    """Candidates, cohort of the newest run, newest ids per origin, ids seen before."""
    ra = _ra(spark, sf_dir)
    cand = ra.where(p.is_eligible())
    facts = p.pool_facts(ra).select(F.struct("run_id", "rss", "correspondent")).scalar()
    known = cand.select("id", "origin", "ingestion_run_id", facts.alias("f"))
    cohort = known.where(F.col("ingestion_run_id") == F.col("f.run_id")).select("id")
    newest = known.where(
        F.col("ingestion_run_id") == F.when(F.col("origin") == "rss", F.col("f.rss")).when(F.col("origin") == "correspondent", F.col("f.correspondent"))
    ).select("id")
    seen = cand.where("suggestion_last_checked_at IS NOT NULL").select("id")
    return cand, cohort, newest, seen


def _policies(spark, sf_dir):
    cand, cohort, newest, seen = audit_inputs(spark, sf_dir)
    out = None
    for name in p.AUDIT_POLICIES:
        one = p.audit_pool(cand, cohort, newest, seen, LIMIT, name).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


PROD = "published_at DESC NULLS FIRST, fetched_at DESC, id"


def audit_sql(limit: int) -> str:
    """CTEs ending in ``audit(policy, id, pool_pos)``."""
    share = -(-limit * 7 // 10)
    first = f"""
ap AS (
  SELECT e.*, e.ingestion_run_id IS NOT NULL AND e.ingestion_run_id = (SELECT run_id FROM run) AS is_cohort,
    coalesce(e.ingestion_run_id = n.run_id, false) AS is_new,
    e.suggestion_last_checked_at IS NOT NULL AS seen,
    CASE WHEN e.origin IN ('rss', 'correspondent') THEN e.origin ELSE 'legacy' END AS ao
  FROM elig e LEFT JOIN newest n ON n.origin = e.origin
),
aq AS (
  SELECT *, CASE WHEN ao = 'rss' AND is_new THEN 0 WHEN ao = 'correspondent' AND is_new THEN 2
      WHEN ao = 'rss' THEN 4 WHEN ao = 'correspondent' THEN 6 ELSE 8 END
      + (published_at IS NULL)::INT AS q10,
    CASE ao WHEN 'rss' THEN 0 WHEN 'correspondent' THEN 2 ELSE 4 END + (published_at IS NULL)::INT AS q6
  FROM ap
),"""

    def fair(name: str, source: str, by: str) -> str:
        part = f"{by}, " if by else ""
        whole = f"PARTITION BY {by}" if by else ""
        return f"""
{name}_t AS (
  SELECT *, row_number() OVER (PARTITION BY {part}source_name ORDER BY seen, {PROD}) AS turn FROM {source}
),
{name} AS (SELECT *, row_number() OVER ({whole} ORDER BY turn, source_name) AS r FROM {name}_t),"""

    return first + (
        fair("f_b", "aq", "is_cohort") + fair("f_first", "(SELECT * FROM aq WHERE is_cohort)", "")
        + fair("f_c", "aq", "q10") + fair("f_d", "(SELECT * FROM aq WHERE NOT is_cohort)", "q10")
        + fair("f_e", "(SELECT * FROM aq WHERE NOT is_cohort)", "q6")
    ) + f"""
parts AS (
  SELECT 'A' AS policy, id, 0 AS part, row_number() OVER (ORDER BY {PROD}) AS o FROM aq
  UNION ALL SELECT 'B', id, CASE WHEN is_cohort THEN 0 ELSE 1 END, r FROM f_b
  UNION ALL SELECT 'C', id, 0, row_number() OVER (ORDER BY (r - 1) // w, q10, r)
    FROM (SELECT *, CASE WHEN q10 < 2 THEN 4 WHEN q10 < 4 THEN 3 ELSE 1 END AS w FROM f_c)
  UNION ALL SELECT x.policy, id, 0, r FROM f_first, (VALUES ('D_original'), ('D_equal')) x(policy) WHERE r <= {share}
  UNION ALL SELECT 'D_original', id, 1, row_number() OVER (ORDER BY (r - 1) // w, q10, r)
    FROM (SELECT *, CASE WHEN q10 < 2 THEN 4 WHEN q10 < 4 THEN 3 ELSE 1 END AS w FROM f_d)
  UNION ALL SELECT 'D_equal', id, 1, row_number() OVER (ORDER BY r - 1, q6, r) FROM f_e
),
audit AS (
  SELECT policy, id, row_number() OVER (PARTITION BY policy ORDER BY part, o) AS pool_pos FROM parts
  QUALIFY row_number() OVER (PARTITION BY policy ORDER BY part, o) <= {limit}
)"""


def _diag(spark, sf_dir):
    return p.pool_diagnostics(_pool(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "pool_legacy": lambda s, d: p.pool_legacy(_ra(s, d), LIMIT).select("id", "pool_pos"),
    "pool_resolve_run": _resolve,
    "pool_round_robin": _round_robin,
    "pool_cohort_slice": _cohort,
    "pool_fair_queues": lambda s, d: _queues(s, d).select("id", "queue", "rn", "weight"),
    "pool_weighted_round_robin": lambda s, d: p.weighted_round_robin(_queues(s, d), LIMIT).select("id", "wrr"),
    "pool_select": lambda s, d: _pool(s, d, PREFERRED).select("id", "part", "pool_pos"),
    "pool_diagnostics": _diag,
    "pool_hydrate": _hydrate,
    "pool_completion": _completion,
    "pool_audit_policies": _policies,
}

_MAIN = _pool_sql(LIMIT, None)
ORACLE: dict[str, str] = {
    "pool_legacy": sql("ra", f"""
SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS pool_pos FROM ra WHERE {ELIGIBLE}
QUALIFY row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) <= {LIMIT}"""),
    "pool_resolve_run": sql("ra", f"""
elig AS (SELECT * FROM ra WHERE {ELIGIBLE} AND ingestion_run_id IS NOT NULL),
latest AS (SELECT ingestion_run_id AS run_id FROM elig ORDER BY fetched_at DESC, id LIMIT 1),
prefs(preferred) AS (VALUES ('none'), ('{PREFERRED}'), ('00000000-0000-4000-8000-999999999999'), ('not-a-run')),
hit AS (SELECT preferred, EXISTS (SELECT 1 FROM elig WHERE ingestion_run_id = preferred) AS ok FROM prefs)
SELECT CASE WHEN ok THEN preferred ELSE (SELECT run_id FROM latest) END AS run_id,
  preferred <> 'none' AND NOT ok AS invalid_preferred, preferred FROM hit"""),
    "pool_round_robin": sql("ra", f"""
elig AS (SELECT * FROM ra WHERE {ELIGIBLE}), {_rr_sql('elig', '', 'x')}
SELECT id, rr FROM x WHERE rr <= {LIMIT}"""),
    "pool_cohort_slice": sql("ra", _MAIN + "\nSELECT id, rr AS cohort_pos FROM cohort"),
    "pool_fair_queues": sql("ra", _MAIN + "\nSELECT id, queue, rr AS rn, weight FROM fair"),
    "pool_weighted_round_robin": sql("ra", _MAIN + f"\nSELECT id, w AS wrr FROM wrr WHERE w <= {LIMIT}"),
    "pool_select": sql("ra", _pool_sql(LIMIT, PREFERRED) + "\nSELECT id, part, pool_pos FROM pool"),
    "pool_diagnostics": sql("ra", _MAIN + """
SELECT 'origin' AS dimension, coalesce(origin, 'legacy') AS key, count(*) AS n FROM pool GROUP BY 2
UNION ALL SELECT 'source', src_key, count(*) FROM pool GROUP BY 2
UNION ALL SELECT 'publication', CASE WHEN published_at IS NULL THEN 'null' ELSE 'dated' END, count(*) FROM pool GROUP BY 2
UNION ALL SELECT 'checked', CASE WHEN suggestion_last_checked_at IS NULL THEN 'unchecked' ELSE 'rechecked' END, count(*) FROM pool GROUP BY 2
UNION ALL SELECT 'part', part, count(*) FROM pool GROUP BY 2"""),
    "pool_hydrate": sql("ra", _MAIN + """
SELECT pool_pos, ra.id, title, length(content) AS n_chars, url, event_date FROM pool JOIN ra USING (id)"""),
    "pool_completion": sql("ra", _MAIN + """
SELECT id, CASE WHEN origin = 'correspondent' THEN 'retryable' ELSE 'checked' END AS outcome FROM pool"""),
    "pool_audit_policies": sql("ra", _MAIN + "," + audit_sql(LIMIT) + "\nSELECT policy, id, pool_pos FROM audit"),
}
