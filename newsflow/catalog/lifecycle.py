"""Registered queries: lifecycle transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.text_sql import clean_text as clean_sql
from newsflow.catalog.text_sql import hit
from newsflow.functions.text import BOILERPLATE, or_empty
from newsflow.operators import lifecycle as lc
from newsflow.operators.serving import genre_key
from newsflow.sources import driver_tables as dt

TS = "2024-02-01 00:00:00"


def ts():
    return F.lit(TS).cast("timestamp")


STATE = ["id", "suggestion_state", "suggestion_last_checked_at", "suggestion_used_at", "suggestion_rejected_at"]


def _state(df):
    return df.select(*STATE)


def _ids(s, d):
    """Articles without a slug: the ones the transitions are applied to."""
    return dt.articles(s, d).where("slug IS NULL OR category = 'News'").select("id")


def _reject_ids(s, d):
    return dt.proposals(s, d).where("status = 'approved'").select("id")


def _publish(s, d, part):
    out = lc.publish(dt.articles(s, d), _ids(s, d), dt.links(s, d), dt.raw_articles(s, d), ts())
    return out[0].select("id", "published", "published_at") if part == 0 else _state(out[1])


def _delete(s, d, part):
    images = dt.articles(s, d).select(
        F.concat(F.lit("img-"), "id").alias("id"), F.col("id").alias("generated_article_id"), F.lit("generated").alias("status"))
    out = lc.delete_drafts(dt.articles(s, d), _ids(s, d), dt.links(s, d), dt.raw_articles(s, d), images)
    if part == 0:
        return out[0].select("id")
    if part == 1:
        return _state(out[1])
    return out[part]


def _slug_rows(s, d):
    """New rows that compete for slugs: the first title words, some with a number behind."""
    words = F.regexp_extract(F.lower("title"), "([a-z]+)", 1)
    return dt.raw_articles(s, d).select(
        "id", F.concat(F.substring(words, 1, 3), F.when(F.col("doc_id") % 9 == 0, " -2").otherwise("")).alias("raw_slug"))


def _existing(s, d):
    """Slugs already taken: the three-letter beginnings of the second title word."""
    return dt.raw_articles(s, d).select(F.regexp_extract(F.lower("title"), "[a-z]+ ([a-z]{3})", 1).alias("slug")).where("slug <> ''")


def _names(s, d):
    return dt.dictionary(s, d).where("role = 'qualifying' AND match_type = 'strong'").select(
        F.col("canonical").alias("en"), F.concat(F.lit("한국 "), F.upper("canonical")).alias("ko"),
        F.array(F.concat(F.lit("x"), "canonical")).alias("avoid"))


def _display(s, d):
    text = F.lower(F.concat_ws("\n", or_empty(F.col("title")), or_empty(F.col("content"))))
    df = dt.raw_articles(s, d).select("id", text.alias("title"))
    return lc.apply_display_names(df, _names(s, d)).select("id", "title")


def _sources(s, d):
    out = lc.cluster_sources(dt.links(s, d), dt.raw_articles(s, d), dt.rss_sources(s, d))
    return out.select("cluster_id", F.size("sources").alias("n"), "error",
                      F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["id"], x["source_name"], F.length(x["text"]).cast("string"))), ",").alias("parts"))


def _snapshot(s, d):
    ra = dt.raw_articles(s, d)
    before = lc.snapshot_counts("raw_articles", ra, F.col("suggestion_state"))
    after = lc.snapshot_counts("raw_articles", lc.mark(ra, ra.where("origin = 'url'").select("id"), ts(), "suggested"), F.col("suggestion_state"))
    return lc.snapshot_diff(before, after)


QUERIES: dict[str, Query] = {
    "life_mark": lambda s, d: _state(lc.mark(dt.raw_articles(s, d), dt.raw_articles(s, d).where("origin = 'url'").select("id"), ts(), "suggested")),
    "life_publish": lambda s, d: _publish(s, d, 0),
    "life_publish_members": lambda s, d: _publish(s, d, 1),
    "life_unpublish": lambda s, d: lc.unpublish(dt.articles(s, d), _ids(s, d))[1],
    "life_delete": lambda s, d: _delete(s, d, 0),
    "life_delete_members": lambda s, d: _delete(s, d, 1),
    "life_delete_images": lambda s, d: _delete(s, d, 2),
    "life_delete_outcome": lambda s, d: _delete(s, d, 3),
    "life_reject": lambda s, d: _state(lc.reject(dt.proposals(s, d), _reject_ids(s, d), True, dt.raw_articles(s, d), ts())[1]),
    "life_reject_status": lambda s, d: lc.reject(dt.proposals(s, d), _reject_ids(s, d), False, dt.raw_articles(s, d), ts())[0].select("id", "status"),
    "life_purge": lambda s, d: _state(lc.purge_pending(dt.proposals(s, d), dt.raw_articles(s, d))[1]),
    "life_slugs": lambda s, d: lc.allocate_slugs(_slug_rows(s, d), _existing(s, d)),
    "life_slug_normalize": lambda s, d: dt.raw_articles(s, d).select("id", lc.normalize_slug(F.col("title")).alias("slug")),
    "life_validate": lambda s, d: lc.validate_articles(dt.raw_articles(s, d).withColumn(
        "title", F.concat(F.lit("한국어 제목 문장 열 글자"), F.repeat(F.lit("가"), (F.col("doc_id") % 300).cast("int")), "title"))
    ).select("id", "script_ratio", "quality_issue"),
    "life_taxonomy": lambda s, d: lc.normalize_taxonomy(dt.articles(s, d).withColumn(
        "category", F.when(F.col("category") == "Releases", " 릴리즈 ").otherwise(F.col("category")))).select("id", "category", "genre"),
    "life_display_names": _display,
    "life_attribution": lambda s, d: lc.attribute_single(dt.articles(s, d), dt.links(s, d), dt.raw_articles(s, d), dt.rss_sources(s, d)),
    "life_cluster_sources": _sources,
    "life_snapshot": _snapshot,
}

ST = "id, suggestion_state, suggestion_last_checked_at, suggestion_used_at, suggestion_rejected_at"
IDS = "ids AS (SELECT id FROM articles WHERE slug IS NULL OR category = 'News')"
MEM = "mem AS (SELECT raw_article_id FROM links WHERE cluster_id IN (SELECT cluster_id FROM articles WHERE id IN (SELECT id FROM {ids})))"
GONE = IDS + ", gone AS (SELECT id FROM articles WHERE NOT published AND id IN (SELECT id FROM ids))"

ORACLE: dict[str, str] = {
    "life_mark": sql("ra", f"""SELECT id, CASE WHEN origin = 'url' THEN 'suggested' ELSE suggestion_state END AS suggestion_state,
  CASE WHEN origin = 'url' THEN TIMESTAMP '{TS}' ELSE suggestion_last_checked_at END AS suggestion_last_checked_at, suggestion_used_at, suggestion_rejected_at FROM ra"""),
    "life_publish": sql("ra articles", f"""{IDS}
SELECT id, published OR id IN (SELECT id FROM ids) AS published,
  CASE WHEN id IN (SELECT id FROM ids) THEN TIMESTAMP '{TS}' ELSE published_at END AS published_at FROM articles"""),
    "life_publish_members": sql("ra articles links", f"""{IDS}, {MEM.format(ids='ids')}
SELECT id, CASE WHEN id IN (SELECT raw_article_id FROM mem) THEN 'used' ELSE suggestion_state END AS suggestion_state, suggestion_last_checked_at,
  CASE WHEN id IN (SELECT raw_article_id FROM mem) THEN TIMESTAMP '{TS}' ELSE suggestion_used_at END AS suggestion_used_at, suggestion_rejected_at FROM ra"""),
    "life_unpublish": sql("ra articles", f"""{IDS}
SELECT id, CASE WHEN published THEN 'unpublished' ELSE 'already_unpublished' END AS outcome FROM ids JOIN articles USING (id)"""),
    "life_delete": sql("ra articles", f"{GONE}\nSELECT id FROM articles WHERE id NOT IN (SELECT id FROM gone)"),
    "life_delete_members": sql("ra articles links", f"""{GONE}, {MEM.format(ids='gone')}
SELECT id, CASE WHEN id IN (SELECT raw_article_id FROM mem) THEN 'new' ELSE suggestion_state END AS suggestion_state, suggestion_last_checked_at,
  CASE WHEN id IN (SELECT raw_article_id FROM mem) THEN NULL ELSE suggestion_used_at END AS suggestion_used_at, suggestion_rejected_at FROM ra"""),
    "life_delete_images": sql("ra articles", f"""{GONE}
SELECT 'img-' || id AS id, CASE WHEN id IN (SELECT id FROM gone) THEN NULL ELSE id END AS generated_article_id,
  CASE WHEN id IN (SELECT id FROM gone) THEN 'analyzed' ELSE 'generated' END AS status FROM articles"""),
    "life_delete_outcome": sql("ra articles", f"""{IDS}
SELECT id, CASE WHEN published THEN 'refused_published' ELSE 'deleted' END AS outcome FROM ids JOIN articles USING (id)"""),
    "life_reject": sql("ra proposals", f"""m AS (SELECT unnest(article_ids) AS aid FROM proposals WHERE status = 'approved')
SELECT id, CASE WHEN id IN (SELECT aid FROM m) THEN 'ignored' ELSE suggestion_state END AS suggestion_state, suggestion_last_checked_at, suggestion_used_at,
  CASE WHEN id IN (SELECT aid FROM m) THEN TIMESTAMP '{TS}' ELSE suggestion_rejected_at END AS suggestion_rejected_at FROM ra"""),
    "life_reject_status": sql("ra proposals", "SELECT id, CASE status WHEN 'approved' THEN 'rejected' ELSE status END AS status FROM proposals"),
    "life_purge": sql("ra proposals", """m AS (SELECT unnest(article_ids) AS aid FROM proposals WHERE status = 'pending')
SELECT id, CASE WHEN id IN (SELECT aid FROM m) THEN 'new' ELSE suggestion_state END AS suggestion_state,
  CASE WHEN id IN (SELECT aid FROM m) THEN NULL ELSE suggestion_last_checked_at END AS suggestion_last_checked_at, suggestion_used_at, suggestion_rejected_at FROM ra"""),
    "life_slug_normalize": sql("ra", """
n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM ra)
SELECT id, regexp_replace(substr(s, 1, 50), '-+$', '') AS slug FROM n"""),
    "life_validate": sql("ra", f"""
t AS (SELECT id, '한국어 제목 문장 열 글자' || repeat('가', (doc_id % 300)::INT) || title AS title, content FROM ra),
c AS (SELECT *, title || chr(10) || content AS txt, length(regexp_replace(title || content, '[^가-힣]', '', 'g')) AS ko,
  length(regexp_replace(title || content, '[^A-Za-z]', '', 'g')) AS lat FROM t)
SELECT id, round(CASE WHEN ko + lat > 0 THEN ko / (ko + lat) ELSE 0 END, 4) AS script_ratio,
  CASE WHEN length(title) < 8 OR length(content) < 120 THEN 'too_short' WHEN CASE WHEN ko + lat > 0 THEN ko / (ko + lat) ELSE 0 END < 0.3 THEN 'low_script_ratio'
    WHEN {hit("txt", BOILERPLATE[:4])} THEN 'site_noise' END AS quality_issue FROM c"""),
    "life_taxonomy": sql("ra articles", """
SELECT id, CASE WHEN category = 'Releases' THEN '릴리즈' ELSE '뉴스' END AS category,
  CASE WHEN category = 'Releases' THEN CASE genre WHEN 'House' THEN 'house' WHEN 'Techno' THEN 'techno' ELSE 'edm' END ELSE 'edm' END AS genre FROM articles"""),
    "life_attribution": sql("ra articles links rss_sources", """
one AS (SELECT cluster_id, min(raw_article_id) AS rid FROM links GROUP BY 1 HAVING count(*) = 1)
SELECT a.id, coalesce(s.name, regexp_extract(r.url, '^https?://([^/]+)', 1)) AS source_label, split_part(r.url, '?', 1) AS source_url
FROM articles a JOIN one USING (cluster_id) JOIN ra r ON r.id = rid LEFT JOIN rss_sources s ON s.id = r.source_id"""),
    "life_cluster_sources": sql("ra links rss_sources", f"""
c AS (SELECT cluster_id, ra.id, coalesce(s.name, '알 수 없는 소스') AS sn, {clean_sql('content', 3000)} AS text
  FROM links JOIN ra ON ra.id = raw_article_id LEFT JOIN rss_sources s ON s.id = ra.source_id)
SELECT cluster_id, count_if(length(text) >= 80)::INT AS n, CASE WHEN count_if(length(text) >= 80) = 0 THEN 'no_usable_text' END AS error,
  coalesce(string_agg(id || ':' || sn || ':' || length(text), ',' ORDER BY id) FILTER (WHERE length(text) >= 80), '') AS parts FROM c GROUP BY 1"""),
    "life_snapshot": sql("ra", """
b AS (SELECT coalesce(suggestion_state, 'null') AS state, count(*) AS n FROM ra GROUP BY 1),
a AS (SELECT coalesce(CASE WHEN origin = 'url' THEN 'suggested' ELSE suggestion_state END, 'null') AS state, count(*) AS n FROM ra GROUP BY 1)
SELECT 'raw_articles' AS "table", coalesce(a.state, b.state) AS state, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after,
  coalesce(b.n, 0) = coalesce(a.n, 0) AS equal FROM a FULL OUTER JOIN b ON a.state = b.state"""),
}
