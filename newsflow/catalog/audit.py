"""Registered queries: audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.entities import INDEX_SQL, QUOTA_SQL, index
from newsflow.catalog.pool import ELIGIBLE, _MAIN, audit_inputs, audit_sql
from newsflow.catalog.text_sql import hit, topic_evidence
from newsflow.functions.text import any_match, or_empty
from newsflow.operators import audit as a
from newsflow.operators import entities as ent
from newsflow.operators import pool as p
from newsflow.sources import driver_tables as dt

AT = "2024-01-01 12:00:00"
STAGES = {"collect": ["purchase", "signup"], "correspondent": ["purchase"]}
TRIGGERS = {"techno": r"\btechno\b", "synth": r"\bsynth\b", "dj": r"\bDJ\b"}


def at():
    return F.lit(AT).cast("timestamp")


def _rows(s, d):
    return a.evaluate(dt.raw_articles(s, d), index(s, d))


def _causes(s, d):
    """A cause for the articles of named feeds, by feed."""
    return dt.raw_articles(s, d).where("source_id IS NOT NULL").select(
        "id", F.when(F.col("source_id") < "src2", "missing_entity").when(F.col("source_id") < "src5", "alias_missing")
        .otherwise("extraction_failure").alias("cause"))


def _split(s, d):
    """Base dictionary and additions: entities by the first letter of their name."""
    full = dt.dictionary(s, d)
    return full.where("canonical >= 'e'"), full.where("canonical < 'e'")


def _counter(s, d, part):
    base, add = _split(s, d)
    return a.counterfactual(dt.raw_articles(s, d), base, base.unionByName(add), dt.labels(s, d))[part]


def _ablation(s, d):
    base, add = _split(s, d)
    return a.entity_ablation(dt.raw_articles(s, d), base, add, dt.labels(s, d), 2000)


def _policy(s, d):
    cand, cohort, newest, seen = audit_inputs(s, d)
    pools = None
    for name in p.AUDIT_POLICIES:
        for limit in (100, 120, 200):
            one = p.audit_pool(cand, cohort, newest, seen, limit, name)
            one = one.select(F.lit(name).alias("policy"), F.lit(limit).alias("pool_limit"), "id")
            pools = one if pools is None else pools.unionByName(one)
    return a.policy_metrics(pools, dt.raw_articles(s, d), cohort, dt.labels(s, d), seen, at())


def _first(s, d):
    """First time each article had a click event of the suggest pipeline."""
    key = F.lpad(F.regexp_extract("item_url", "/news/([0-9]+)", 1), 12, "0")
    return a.first_candidate(dt.event_log(s, d), "click", key)


def _cohorts(s, d):
    return a.cohorts_from_log(dt.event_log(s, d), dt.raw_articles(s, d), STAGES)


def _metrics(s, d, key):
    members = _cohorts(s, d).where("id IS NOT NULL").select(F.col(key).alias("key"), "id")
    ra = dt.raw_articles(s, d)
    top = p.pool_legacy(ra, 100).select("id")
    out = a.cohort_metrics(members, ra, _first(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp"), top)
    return out.withColumn("states", F.array_join(F.transform(F.map_entries("states"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ","))


def _displacement(s, d):
    ra = dt.raw_articles(s, d).where(p.is_eligible())
    run = p.resolve_run(dt.raw_articles(s, d))
    target = ra.where(F.col("ingestion_run_id") == run.select("run_id").scalar()).select("id")
    pool = p.pool_legacy(ra, 100)
    return a.displacement(ra, pool, target)


def _rule(s, d):
    text = F.concat(or_empty(F.col("title")), F.lit("\n"), F.substring(or_empty(F.col("content")), 1, 500))
    old = any_match(text, [r"\b(?:techno|synth|DJ)\b"])
    return a.rule_delta(dt.raw_articles(s, d), old, ent.has_topic_evidence(F.col("title"), F.col("content")))


def _resolve(s, d):
    ra = dt.raw_articles(s, d)
    batches = ra.select(F.coalesce("origin", F.lit("none")).alias("batch"), "id", "published_at", "fetched_at")
    labels = dt.labels(s, d)
    # positions are the document numbers of the labelled rows, for the feed batch
    positional = labels.select(F.lit("rss").alias("batch"), F.col("id").cast("int").alias("position"), "label").where("label <> 'relevant'")
    explicit = ra.select("id", F.lit("ambiguous").alias("label"))
    return a.resolve_labels(explicit, labels, batches, positional)


def _contract(s, d):
    ra = dt.raw_articles(s, d).select("id", "url", "title", "origin", "suggestion_state", F.col("source_id"))
    spec = {
        "required": ["id", "url", "title", "origin", "body"], "allowed": ["suggestion_state"], "nonblank": ["title", "origin"],
        "urls": ["url"], "enums": {"suggestion_state": ["new", "suggested", "used"]}, "identity": ["title"],
        "class_column": "origin", "class_counts": {"rss": 600, "correspondent": 1},
    }
    return a.check_contract(ra, spec)


def _dict_counts(s, d):
    e = dt.dictionary(s, d).select(F.col("role").alias("type"), F.when(F.length("canonical") > 10, "established").otherwise("open").alias("ko_status"), "canonical")
    return a.dictionary_counts(e.where("canonical >= 'e'"), e.where("canonical < 'e'"))


QUERIES: dict[str, Query] = {
    "audit_funnel": lambda s, d: a.funnel(_rows(s, d), "source_name"),
    "audit_confusion": lambda s, d: a.confusion(_rows(s, d), dt.labels(s, d)),
    "audit_fn_causes": lambda s, d: a.fn_causes(_rows(s, d), dt.labels(s, d), _causes(s, d)),
    "audit_counterfactual": lambda s, d: _counter(s, d, 0),
    "audit_newly_eligible": lambda s, d: _counter(s, d, 1),
    "audit_ablation": _ablation,
    "audit_policy_metrics": _policy,
    "audit_state_as_of": lambda s, d: a.state_as_of(dt.raw_articles(s, d), at()),
    "audit_first_candidate": _first,
    "audit_cohorts": _cohorts,
    "audit_latest_run": lambda s, d: a.latest_run_as_of(_cohorts(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp")),
    "audit_last_runs": lambda s, d: a.last_runs(_cohorts(s, d), 10).select("pipeline", "run_id", "recency"),
    "audit_cohort_metrics_run": lambda s, d: _metrics(s, d, "run_id"),
    "audit_cohort_metrics_path": lambda s, d: _metrics(s, d, "pipeline"),
    "audit_percentiles": lambda s, d: a.lower_percentiles(dt.event_log(s, d), ["pipeline"], "value", [0.5, 0.9]),
    "audit_displacement": _displacement,
    "audit_rule_delta": _rule,
    "audit_sanitize": lambda s, d: a.sanitize(dt.raw_articles(s, d), TRIGGERS).withColumn("triggers", F.array_join("triggers", ",")),
    "audit_resolve_labels": _resolve,
    "audit_run_funnel": lambda s, d: a.run_funnel([
        ("articles", dt.raw_articles(s, d)), ("eligible", dt.raw_articles(s, d).where(p.is_eligible())),
        ("selected", _rows(s, d).where("selected"))]),
    "audit_omissions": lambda s, d: a.omissions(dt.raw_articles(s, d), dt.labels(s, d)),
    "audit_contract": _contract,
    "audit_dictionary_counts": _dict_counts,
}


def _eval_sql(where: str, p: str) -> str:
    """Evaluation under the part of the dictionary that ``where`` keeps, as CTEs ending in ev_<p>."""
    return f"""
ix_{p} AS (SELECT * FROM idx WHERE {where}),
roles_{p} AS (SELECT id, count_if(role <> 'supporting') AS nq, count_if(role = 'supporting') AS ns FROM ix_{p} GROUP BY id),
parts_{p} AS (SELECT ra.*, CASE WHEN nq > 0 THEN 'qualifying' WHEN gate_path = 'dance_experience' THEN 'dance_experience'
  WHEN ns > 0 THEN 'supporting_only' ELSE 'not_matched' END AS partition FROM ra LEFT JOIN roles_{p} USING (id)),
lanes_{p} AS (SELECT id, partition, CASE WHEN partition IN ('qualifying', 'dance_experience') THEN partition
  WHEN partition = 'not_matched' AND {topic_evidence('title', 'content')} THEN 'evidence' END AS lane FROM parts_{p}),
ranked_{p} AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) AS rn FROM lanes_{p}),
caps_{p} AS (SELECT least(CAP, count_if(lane = 'qualifying')) AS q, count_if(lane = 'dance_experience') AS d FROM lanes_{p}),
ev_{p} AS (SELECT id, partition, lane IS NOT NULL AND rn <= CASE lane WHEN 'qualifying' THEN CAP WHEN 'dance_experience' THEN CAP - q
  ELSE least(CAP - q - least(d, CAP - q), CAP * 6 // 10) END AS selected FROM ranked_{p}, caps_{p})"""


def _conf(ev: str, pre: str) -> str:
    return f"""SELECT count_if(selected AND label = 'relevant') AS {pre}tp, count_if(selected AND label = 'irrelevant') AS {pre}fp,
  count_if(NOT selected AND label = 'relevant') AS {pre}fn, count_if(NOT selected AND label = 'irrelevant') AS {pre}tn,
  round(count_if(selected AND label = 'relevant') / nullif(count_if(selected AND label IN ('relevant', 'irrelevant')), 0), 4) AS {pre}precision,
  round(count_if(selected AND label = 'relevant') / nullif(count_if(label = 'relevant'), 0), 4) AS {pre}recall,
  count_if(partition = 'qualifying') AS {pre}qualifying, count_if(selected) AS {pre}eligible
FROM {ev} LEFT JOIN labels_v USING (id)"""


BOTH = (_eval_sql("canonical >= 'e'", "b") + "," + _eval_sql("true", "x"))
COHORT_SQL = """
runs AS (SELECT run_id, arg_min(pipeline, ts) AS pipeline, min(ts) AS started_at FROM event_log GROUP BY 1),
coh AS (
  SELECT DISTINCT r.run_id, r.pipeline, r.started_at, ra.id FROM runs r JOIN event_log e ON e.run_id = r.run_id JOIN ra ON ra.url = e.item_url
  WHERE (r.pipeline = 'collect' AND stage IN ('purchase', 'signup')) OR (r.pipeline = 'correspondent' AND stage = 'purchase')
),
cohorts AS (SELECT r.run_id, r.pipeline, r.started_at, coh.id FROM runs r LEFT JOIN coh USING (run_id) WHERE r.pipeline IN ('collect', 'correspondent'))"""
FIRST_SQL = """
first_seen AS (SELECT lpad(regexp_extract(item_url, '/news/([0-9]+)', 1), 12, '0') AS id, min(ts) AS first_at FROM event_log
  WHERE pipeline = 'suggest' AND stage = 'click' GROUP BY 1)"""


def _metrics_sql(key: str) -> str:
    pct = lambda v, f: f"list_sort(list({v}) FILTER ({v} IS NOT NULL))[1 + floor((count({v}) - 1) * {f})::INT]"
    return COHORT_SQL + "," + FIRST_SQL + f""",
top AS (SELECT id FROM ra WHERE {ELIGIBLE} ORDER BY published_at DESC NULLS FIRST, id LIMIT 100),
rows AS (
  SELECT DISTINCT {key} AS key, ra.id, published_at, event_date, coalesce(suggestion_state, 'null') AS state, length(content) AS chars, source_name AS source,
    first_at, (epoch_us(first_at) - epoch_us(fetched_at)) / 3600000000 AS latency,
    (epoch_us(coalesce(first_at, TIMESTAMP '2024-02-01')) - epoch_us(published_at)) / 3600000000 AS age, ra.id IN (SELECT id FROM top) AS is_top
  FROM coh JOIN ra USING (id) LEFT JOIN first_seen USING (id) WHERE pipeline <> 'suggest'
),
src AS (SELECT key, count(*) AS source_diversity, max(n) AS mx FROM (SELECT key, source, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT key, string_agg(state || ':' || n, ',' ORDER BY state) AS states FROM (SELECT key, state, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT key, count(*) AS collected, round(count_if(published_at IS NULL) / count(*), 4) AS undated_rate, round(count_if(event_date IS NULL) / count(*), 4) AS no_event_rate,
  min(chars) AS chars_min, {pct('chars', 0.5)}::DOUBLE AS chars_p50, {pct('chars', 0.9)}::DOUBLE AS chars_p90, max(chars) AS chars_max,
  count_if(is_top) AS in_top, round(count_if(is_top) / count(*), 4) AS in_top_rate, count(first_at) AS reached, round(count(first_at) / count(*), 4) AS reached_rate,
  count(*) - count(first_at) AS never_candidate, round({pct('latency', 0.5)}, 4) AS latency_p50, round({pct('latency', 0.9)}, 4) AS latency_p90,
  round({pct('age', 0.5)}, 4) AS age_p50, round({pct('age', 0.9)}, 4) AS age_p90 FROM rows GROUP BY 1)
SELECT m.*, states, source_diversity, round(mx / collected, 4) AS max_source_share FROM m JOIN src USING (key) JOIN st USING (key)"""


def _policy_sql() -> str:
    body = _MAIN
    pools = []
    for limit in (100, 120, 200):
        text = audit_sql(limit)
        for name in ("ap", "aq", "f_b", "f_first", "f_c", "f_d", "f_e", "parts", "audit"):
            for suf in ("_t", ""):
                import re
                text = re.sub(rf"\b{name}{suf}\b", f"{name}{suf}_{limit}", text)
        body += "," + text
        pools.append(f"SELECT policy, {limit} AS pool_limit, id FROM audit_{limit}")
    text = "(title || ' ' || substr(content, 1, 500))"
    return body + f""",
pools AS ({' UNION ALL '.join(pools)}),
target AS (SELECT id FROM elig WHERE ingestion_run_id = (SELECT run_id FROM run)),
j AS (SELECT pools.*, ra.origin, published_at, source_name, label, id IN (SELECT id FROM target) AS hit, suggestion_last_checked_at IS NOT NULL AS seen,
  coalesce(event_date < DATE '2024-01-01', false) AND {hit(text, [a.PREVIEW])} AND NOT {hit(text, [a.POST_EVENT])} AS stale
  FROM pools JOIN ra USING (id) LEFT JOIN labels_v USING (id)),
s AS (SELECT policy, pool_limit, count(*) AS source_diversity, max(n) AS mx FROM (SELECT policy, pool_limit, source_name, count(*) AS n FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT policy, pool_limit, count(*) AS selected, count_if(hit) AS target_selected, round(count_if(hit) / (SELECT count(*) FROM target), 4) AS target_coverage,
  round(count_if(hit AND label = 'relevant') / (SELECT count(*) FROM target JOIN labels_v USING (id) WHERE label = 'relevant'), 4) AS relevant_recall,
  count_if(hit AND label = 'irrelevant') AS irrelevant_included, count_if(origin = 'rss') AS n_rss, count_if(origin = 'correspondent') AS n_correspondent,
  count_if(origin = 'url') AS n_url, count_if(origin IS NULL) AS n_unknown, any_value(source_diversity) AS source_diversity,
  round(any_value(mx) / count(*), 4) AS max_source_share, round(count_if(published_at IS NULL) / count(*), 4) AS undated_share,
  count_if(NOT hit) AS backlog, count_if(stale) AS stale_preview_risk, count_if(seen) AS repeated
FROM j JOIN s USING (policy, pool_limit) GROUP BY 1, 2"""


EV = "(SELECT id, partition, selected, partition = 'not_matched' AND selected AS fallback FROM quota)"
CNT = """count(*) AS total, count_if(partition = 'qualifying') AS qualifying, count_if(partition = 'dance_experience') AS dance_experience,
  count_if(partition = 'supporting_only') AS supporting_only, count_if(partition = 'not_matched') AS not_matched, count_if(fallback) AS fallback, count_if(selected) AS eligible"""

ORACLE: dict[str, str] = {
    "audit_funnel": sql("ra dict", QUOTA_SQL + f"""
SELECT source_name AS key, {CNT} FROM {EV} JOIN ra USING (id) GROUP BY 1 UNION ALL SELECT 'all', {CNT} FROM {EV}"""),
    "audit_confusion": sql("ra dict labels_v", QUOTA_SQL + """,
c AS (SELECT count_if(selected AND label = 'relevant') AS tp, count_if(selected AND label = 'irrelevant') AS fp, count_if(NOT selected AND label = 'relevant') AS fn,
  count_if(NOT selected AND label = 'irrelevant') AS tn, count_if(label = 'ambiguous') AS ambiguous, count_if(label IS NULL) AS unlabelled FROM quota LEFT JOIN labels_v USING (id))
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM c"""),
    "audit_fn_causes": sql("ra dict labels_v", QUOTA_SQL + f""",
lost AS (SELECT q.id, CASE WHEN source_id IS NULL THEN 'other' WHEN source_id < 'src2' THEN 'missing_entity' WHEN source_id < 'src5' THEN 'alias_missing' ELSE 'extraction_failure' END AS cause
  FROM quota q JOIN labels_v USING (id) JOIN ra USING (id) WHERE NOT selected AND label = 'relevant'),
names AS (SELECT unnest({a.FN_CAUSES!r}) AS cause)
SELECT n.cause, count(l.id) OVER (PARTITION BY n.cause) AS n, l.id FROM names n LEFT JOIN lost l USING (cause)"""),
    "audit_counterfactual": sql("ra dict labels_v", INDEX_SQL + "," + BOTH.replace("CAP", "120") + f""",
b AS ({_conf('ev_b', 'base_')}), x AS ({_conf('ev_x', 'ext_')})
SELECT *, base_fn - ext_fn AS fn_reduction, ext_fp - base_fp AS fp_increase FROM b, x"""),
    "audit_newly_eligible": sql("ra dict labels_v", INDEX_SQL + "," + BOTH.replace("CAP", "120") + """,
fresh AS (SELECT id FROM ev_x WHERE selected EXCEPT SELECT id FROM ev_b WHERE selected)
SELECT fresh.id, i.canonical FROM fresh LEFT JOIN (SELECT * FROM idx WHERE canonical < 'e' AND role <> 'supporting') i USING (id)"""),
    "audit_ablation": sql("ra dict labels_v", INDEX_SQL + "," + _eval_sql("canonical >= 'e'", "b").replace("CAP", "2000") + """
SELECT canonical, i.id, label FROM idx i JOIN ev_b USING (id) LEFT JOIN labels_v USING (id)
WHERE canonical < 'e' AND i.role <> 'supporting' AND NOT selected AND partition <> 'qualifying'"""),
    "audit_policy_metrics": sql("ra labels_v", _policy_sql()),
    "audit_state_as_of": sql("ra", f"""
SELECT id, CASE WHEN fetched_at > TIMESTAMP '{AT}' THEN 'not_fetched' WHEN suggestion_last_checked_at <= TIMESTAMP '{AT}' OR suggestion_rejected_at <= TIMESTAMP '{AT}'
  OR suggestion_used_at <= TIMESTAMP '{AT}' THEN 'excluded' ELSE 'eligible' END AS state FROM ra"""),
    "audit_first_candidate": sql("event_log", FIRST_SQL + "\nSELECT id, first_at FROM first_seen"),
    "audit_cohorts": sql("ra event_log", COHORT_SQL + "\nSELECT run_id, pipeline, started_at, id FROM cohorts"),
    "audit_latest_run": sql("ra event_log", COHORT_SQL + "\nSELECT pipeline, arg_max(run_id, started_at) AS run_id FROM cohorts WHERE started_at <= TIMESTAMP '2024-01-15' GROUP BY 1"),
    "audit_last_runs": sql("ra event_log", COHORT_SQL + """
SELECT pipeline, run_id, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC) AS recency FROM (SELECT DISTINCT pipeline, run_id, started_at FROM cohorts)
QUALIFY recency <= 10"""),
    "audit_cohort_metrics_run": sql("ra event_log", _metrics_sql("run_id")),
    "audit_cohort_metrics_path": sql("ra event_log", _metrics_sql("pipeline")),
    "audit_percentiles": sql("event_log", """SELECT pipeline, list_sort(list(value))[1 + floor((count(*) - 1) * 0.5)::INT] AS p50,
  list_sort(list(value))[1 + floor((count(*) - 1) * 0.9)::INT] AS p90 FROM event_log GROUP BY 1"""),
    "audit_displacement": sql("ra", f"""
elig AS (SELECT * FROM ra WHERE {ELIGIBLE}),
r AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, fetched_at DESC, id) AS full_rank FROM elig),
pool AS (SELECT * FROM elig ORDER BY published_at DESC NULLS FIRST, id LIMIT 100),
run AS (SELECT ingestion_run_id FROM elig WHERE ingestion_run_id IS NOT NULL ORDER BY fetched_at DESC, id LIMIT 1)
SELECT id, full_rank, id IN (SELECT id FROM pool) AS in_pool, CASE WHEN id IN (SELECT id FROM pool) THEN NULL
  WHEN published_at IS NULL THEN 'null-published backlog tie/order displacement'
  ELSE (SELECT count_if(published_at IS NULL) FROM pool) || ' null-published rows precede dated article' END AS reason
FROM r WHERE ingestion_run_id = (SELECT ingestion_run_id FROM run)"""),
    "audit_rule_delta": sql("ra", f"""
e AS (SELECT id, {hit("(coalesce(title, '') || chr(10) || substr(content, 1, 500))", [chr(92) + 'b(?:techno|synth|DJ)' + chr(92) + 'b'])} AS o, {topic_evidence('title', 'content')} AS n FROM ra)
SELECT id, CASE WHEN n THEN 'added' ELSE 'removed' END AS change FROM e WHERE o <> n"""),
    "audit_sanitize": sql("ra", r"""
t AS (SELECT *, title || chr(10) || substr(content, 1, 500) AS txt FROM ra)
SELECT id, title, substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 800) AS excerpt, length(content) AS content_length, sha256(content) AS content_hash,
  array_to_string(list_filter([CASE WHEN regexp_matches(txt, '(?i)\btechno\b') THEN 'techno' END, CASE WHEN regexp_matches(txt, '(?i)\bsynth\b') THEN 'synth' END,
    CASE WHEN regexp_matches(txt, '(?i)\bDJ\b') THEN 'dj' END], lambda x: x IS NOT NULL), ',') AS triggers FROM t"""),
    "audit_resolve_labels": sql("ra labels_v", """
pos AS (SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, fetched_at, id) AS position FROM ra WHERE origin = 'rss'),
ex AS (SELECT id::INT AS position, label FROM labels_v WHERE label <> 'relevant')
SELECT ra.id, CASE WHEN ra.origin = 'rss' THEN coalesce(ex.label, 'relevant') ELSE coalesce(l.label, 'ambiguous') END AS label
FROM ra LEFT JOIN pos USING (id) LEFT JOIN ex USING (position) LEFT JOIN labels_v l ON l.id = ra.id"""),
    "audit_run_funnel": sql("ra dict", QUOTA_SQL + f"""
SELECT 0 AS step, 'articles' AS stage, count(*) AS n FROM ra UNION ALL SELECT 1, 'eligible', count(*) FROM ra WHERE {ELIGIBLE}
UNION ALL SELECT 2, 'selected', count_if(selected) FROM quota"""),
    "audit_omissions": sql("ra labels_v", "SELECT id FROM ra EXCEPT SELECT id FROM labels_v"),
    "audit_dictionary_counts": sql("ra dict", """
SELECT role AS type, count(*) AS n, count_if(length(canonical) > 10) AS n_established FROM dict GROUP BY 1
UNION ALL SELECT 'all', count(*), count_if(length(canonical) > 10) FROM dict"""),
}
