"""Registered queries: sources, serving and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.text_sql import q
from newsflow.functions.lineage import scratch_path
from newsflow.functions.text import strip
from newsflow.operators import serving as v
from newsflow.sources import driver_tables as dt
from newsflow.sources import dictionary, event_log, feeds

SITE = "https://site.example.com"


def as_of():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _t(s, d):
    return dt.articles(s, d), dt.links(s, d), dt.raw_articles(s, d)


def _latest(s, d):
    a, l, r = _t(s, d)
    out = None
    for name, kw in (("all", {}), ("release", {"category": "Releases"}), ("genre", {"genre": "edm", "limit": 20})):
        one = v.latest_articles(a, l, r, **kw).select(F.lit(name).alias("listing"), "pos", "id", "resolved_image")
        out = one if out is None else out.unionByName(one)
    return out


def views(s, d):
    """Current view counts: slugs of all articles with the count their id gives."""
    return dt.articles(s, d).where("slug IS NOT NULL").select(
        "slug", (F.col("doc_id") % 97).alias("views_30d"), F.col("created_at").alias("updated_at"))


def _popular(s, d):
    a, l, r = _t(s, d)
    latest = v.latest_articles(a, l, r).select("id", "slug", "pos")
    return v.popular_articles(views(s, d), a, latest, 10)


def _lookup(s, d):
    keys = dt.articles(s, d).select(F.coalesce("slug", "id").alias("key")).distinct()
    return v.lookup_articles(dt.articles(s, d), keys)


def _blocks(s, d):
    a = dt.articles(s, d).withColumn("content", F.concat(
        F.lit("![Cover]("), F.lit("https://md.example.com/"), F.col("doc_id").cast("string"), F.lit(".jpg)\n\n"),
        F.col("content"), F.lit("\n\n*From [The source](https://src.example.com/a) today*")))
    return v.content_blocks(a)


def _head(s, d):
    items = dt.raw_articles(s, d).where("source_id IS NOT NULL").select("source_id", "id", F.col("doc_id").alias("pos"))
    return feeds.head_per_source(items).select("source_id", "id")


def _tiers(s, d):
    src = dt.rss_sources(s, d).withColumn("name", F.regexp_replace("name", "^Source SRC1$", "Mixmag"))
    return v.apply_tiers(src).select("id", "name", "tier")


def _tier_counts(s, d):
    src = v.apply_tiers(dt.rss_sources(s, d))
    new = dt.raw_articles(s, d).select(
        F.concat(F.lit("https://"), F.coalesce("origin", F.lit("none")), F.lit(".example.com/feed")).alias("url"),
        F.coalesce("origin", F.lit("none")).alias("name"), F.lit("C").alias("tier")).distinct()
    return v.tier_counts(v.add_sources(src, new))


_LOGS: dict[tuple[str, str], str] = {}


def _log(s, d):
    """The events as the log gives them back; written once a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _LOGS:
        path = scratch_path(s, "event-log")
        event_log.write_event_log(dt.event_log(s, d).select(
            "ts", "run_id", "pipeline", "stage", "reason", "source", "item_url", F.lit(None).cast("string").alias("title"), "detail"), path)
        _LOGS[key] = path
    return event_log.read_event_log(s, _LOGS[key])


def _log_days(s, d):
    """Three days of the log; the folders of other days are not read."""
    days = _log(s, d).where("date BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
    return days.groupBy("pipeline", "date", "stage").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _surfaces(s, d):
    """Surfaces loaded from an entity table and its policy, with aliases, supporting roles and context rules."""
    known = dt.dictionary(s, d).select("canonical", "role", "weight").distinct()
    n = F.length("canonical")
    entities = known.select(
        n.alias("position"), F.col("canonical").alias("en"), F.array(F.concat(F.col("canonical"), F.lit(" Live")), F.lit("x")).alias("aliases_en"), "weight")
    rule = F.struct(F.array(F.lit("DJ")).alias("before"), F.array(F.lit("remix")).alias("after"), F.lit(5).cast("long").alias("max_gap_chars"))
    own = F.struct(
        F.col("role"), F.when(n % 7 == 0, F.create_map("canonical", rule)).otherwise(F.from_json(F.lit("{}"), "map<string," + dictionary.RULE + ">")).alias("contextual_surfaces"))
    ruled = known.where((F.col("role") == "supporting") | (n % 7 == 0)).select("canonical", own.alias("c"))
    policy = ruled.agg(F.map_from_entries(F.collect_list(F.struct("canonical", "c"))).alias("entities")).select(
        F.lit(dictionary.POLICY_VERSION).alias("version"), "entities")
    out = dictionary.load_surfaces(entities, policy)
    return out.select(
        "canonical", "role", "weight", "surface", "surface_pos", "match_type", F.array_join("before", ",").alias("before"),
        F.array_join("after", ",").alias("after"), "max_gap")


QUERIES: dict[str, Query] = {
    "source_store_raw": lambda s, d: event_log.store_raw(
        dt.raw_articles(s, d).select(F.col("source_name").alias("run_id"), "content"), "content"
    ).select("run_id", "digest", "path"),
    "source_head_per_feed": _head,
    "source_event_log": _log,
    "source_event_days": _log_days,
    "source_dictionary": _surfaces,
    "export_feed": lambda s, d: feeds.feed_rows(dt.articles(s, d), SITE),
    "export_sitemap": lambda s, d: feeds.sitemap_rows(dt.articles(s, d), SITE, as_of()),
    "export_redirects": lambda s, d: feeds.redirect_rows(dt.articles(s, d)),
    "serve_latest": _latest,
    "serve_image": lambda s, d: v.resolve_image(*_t(s, d)).select("id", "resolved_image"),
    "serve_popular": _popular,
    "serve_sync_views": lambda s, d: v.sync_views(dt.page_views(s, d), views(s, d), as_of()),
    "serve_taxonomy_match": lambda s, d: dt.articles(s, d).select(
        "id", v.category_key(F.col("category")).alias("category_key"), v.genre_key(F.col("genre")).alias("genre_key"),
        v.taxonomy_match(F.col("category"), "신보").alias("is_release")),
    "serve_taxonomy_params": lambda s, d: v.taxonomy_params(dt.articles(s, d)),
    "serve_search": lambda s, d: v.search_articles(dt.articles(s, d), "er th").select("id", "pos").withColumn("kind", F.lit("site")).unionByName(
        v.search_articles(dt.articles(s, d), "src1_", ("title", "slug"), None, 20).select("id", "pos").withColumn("kind", F.lit("wild"))).unionByName(
        v.search_articles(dt.articles(s, d), "SRC1", ("title", "slug"), False, 20).select("id", "pos").withColumn("kind", F.lit("draft"))),
    "serve_lookup": _lookup,
    "serve_related": lambda s, d: v.related_articles(dt.articles(s, d)),
    "serve_blocks": _blocks,
    "serve_meta_description": lambda s, d: dt.articles(s, d).select("id", v.meta_description(F.col("content")).alias("description")),
    "serve_discover": lambda s, d: v.discover_interviews(
        dt.raw_articles(s, d).withColumn("url", F.replace("url", F.lit("/news/1"), F.lit("/interview/1")))).select("id", "pos"),
    "serve_tiers": _tiers,
    "serve_tier_counts": _tier_counts,
}

SLUG = "trim(regexp_replace(replace(lower(trim(coalesce({c}, ''))), '&', ' and '), '[^a-z0-9가-힣]+', '-', 'g'), '-')"


def key_sql(col: str, aliases: dict) -> str:
    slug = SLUG.format(c=col)
    whens = " ".join(f"WHEN {slug} IN ({', '.join(q(v._slug_text(n)) for n in names)}) THEN '{k}'" for k, names in aliases.items())
    return f"CASE {whens} ELSE {slug} END"


CAT, GEN = key_sql("category", v.CATEGORY_ALIASES), key_sql("genre", v.GENRE_ALIASES)
LIST_SQL = f"""
newest AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS np FROM articles WHERE published
  QUALIFY row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) <= 200),
member AS (SELECT cluster_id, arg_min(image_url, ra.id) AS img FROM links JOIN ra ON ra.id = raw_article_id
  WHERE regexp_matches(image_url, '(?i)^https?://') AND NOT contains(lower(image_url), 'static.ra.co/images/') GROUP BY 1)"""

ORACLE: dict[str, str] = {
    "source_store_raw": sql("ra", "SELECT DISTINCT source_name AS run_id, sha256(content) AS digest, 'raw/' || source_name || '/' || sha256(content) || '.txt' AS path FROM ra"),
    "source_head_per_feed": sql("ra", "SELECT source_id, id FROM ra WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY doc_id) <= 10"),
    "source_event_log": sql("event_log", """
SELECT ts, run_id, pipeline, stage, reason, source, item_url, NULL AS title, detail, ts::DATE AS date FROM event_log"""),
    "source_event_days": sql("event_log", """
SELECT pipeline, ts::DATE AS date, stage, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM event_log
WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' GROUP BY ALL"""),
    "source_dictionary": sql("ra dict", """
known AS (SELECT DISTINCT canonical, role, weight FROM dict)
SELECT canonical, role, weight, canonical || ' live' AS surface, 1 AS surface_pos, 'strong' AS match_type, '' AS before, '' AS after, 12 AS max_gap FROM known
UNION ALL SELECT canonical, role, weight, canonical, 0, CASE WHEN length(canonical) % 7 = 0 THEN 'contextual' ELSE 'strong' END,
  CASE WHEN length(canonical) % 7 = 0 THEN 'dj' ELSE '' END, CASE WHEN length(canonical) % 7 = 0 THEN 'remix' ELSE '' END,
  CASE WHEN length(canonical) % 7 = 0 THEN 5 ELSE 12 END FROM known"""),
    "export_feed": sql("ra articles", f"""
top AS (SELECT * FROM articles WHERE published ORDER BY published_at DESC NULLS FIRST, id LIMIT 50),
e AS (SELECT id, title, '{SITE}/articles/' || slug AS link, substr(content, 1, 200) AS description, published_at, coalesce(category, '') AS category FROM top WHERE slug <> '')
SELECT id, {"".join("replace(" * 5)}title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS title, link,
  {"".join("replace(" * 5)}description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS description,
  coalesce(strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT'), '') AS pub_date, category FROM e"""),
    "export_sitemap": sql("ra articles", f"""
pages(p, changefreq, priority) AS (VALUES ('/', 'hourly', '1.0'), ('/category/festival/', 'daily', '0.7'), ('/category/release/', 'daily', '0.7'),
  ('/category/news/', 'daily', '0.7'), ('/category/interview/', 'daily', '0.7'), ('/genre/house/', 'daily', '0.6'), ('/genre/techno/', 'daily', '0.6'), ('/genre/edm/', 'daily', '0.6')),
top AS (SELECT * FROM articles WHERE published ORDER BY published_at DESC NULLS FIRST, id LIMIT 5000)
SELECT '{SITE}' || p AS loc, TIMESTAMP '2024-01-20' AS lastmod, changefreq, priority FROM pages
UNION ALL SELECT '{SITE}/articles/' || slug || '/', coalesce(updated_at, published_at, created_at), 'daily', '0.8' FROM top WHERE slug <> ''"""),
    "export_redirects": sql("ra articles", """
top AS (SELECT * FROM articles WHERE published ORDER BY published_at DESC NULLS FIRST, id LIMIT 5000)
SELECT '/articles/' || id || '/' AS source, '/articles/' || slug || '/' AS target, 301 AS status FROM top WHERE slug <> ''"""),
    "serve_latest": sql("ra articles links", LIST_SQL + f""",
pick AS (
  SELECT 'all' AS listing, row_number() OVER (ORDER BY np) AS pos, * FROM newest QUALIFY row_number() OVER (ORDER BY np) <= 50
  UNION ALL SELECT 'release', row_number() OVER (ORDER BY np), * FROM newest WHERE {CAT} = 'release' QUALIFY row_number() OVER (ORDER BY np) <= 50
  UNION ALL SELECT 'genre', row_number() OVER (ORDER BY np), * FROM newest WHERE {GEN} = 'edm' QUALIFY row_number() OVER (ORDER BY np) <= 20)
SELECT listing, pos, id, coalesce(image_url, img) AS resolved_image FROM pick LEFT JOIN member USING (cluster_id)"""),
    "serve_image": sql("ra articles links", LIST_SQL + r"""
SELECT id, coalesce(image_url, img, nullif(regexp_extract(content, '!\[([^\]]*)\]\((https?://[^)\s]+)\)', 2), '')) AS resolved_image
FROM articles LEFT JOIN member USING (cluster_id)"""),
    "serve_popular": sql("ra articles", """
views AS (SELECT slug, doc_id % 97 AS views FROM articles WHERE slug IS NOT NULL),
top AS (SELECT slug, row_number() OVER (ORDER BY views DESC, slug) AS v, views FROM views QUALIFY v <= 10),
hit AS (SELECT a.id, a.slug, v FROM top JOIN articles a USING (slug) WHERE a.published AND views > 0),
latest AS (SELECT id, slug, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS p FROM articles WHERE published
  QUALIFY row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) <= 50),
alls AS (SELECT id, slug, 0 AS part, v AS o FROM hit UNION ALL SELECT id, slug, 1, p FROM latest WHERE id NOT IN (SELECT id FROM hit))
SELECT id, slug, row_number() OVER (ORDER BY part, o) AS pos FROM alls QUALIFY row_number() OVER (ORDER BY part, o) <= 10"""),
    "serve_sync_views": sql("ra articles page_views", """
counts AS (SELECT path, count(*) AS n FROM page_views WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-20'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500),
fresh AS (SELECT regexp_extract(path, '^/articles/([^/]+)/?$', 1) AS slug, sum(n)::BIGINT AS n FROM counts GROUP BY 1 HAVING slug <> ''),
cur AS (SELECT slug, doc_id % 97 AS views, created_at FROM articles WHERE slug IS NOT NULL)
SELECT coalesce(c.slug, f.slug) AS slug, coalesce(n, views) AS views_30d,
  CASE WHEN n IS NOT NULL THEN TIMESTAMP '2024-01-20' ELSE created_at END AS updated_at FROM cur c FULL OUTER JOIN fresh f ON c.slug = f.slug"""),
    "serve_taxonomy_match": sql("ra articles", f"SELECT id, {CAT} AS category_key, {GEN} AS genre_key, {CAT} = 'release' AS is_release FROM articles"),
    "serve_taxonomy_params": sql("ra articles", f"""
SELECT DISTINCT 'category' AS kind, {SLUG.format(c='category')} AS slug FROM articles WHERE published AND slug IS NOT DISTINCT FROM slug AND {SLUG.format(c='category')} <> ''
UNION SELECT DISTINCT 'genre', {SLUG.format(c='genre')} FROM articles WHERE published AND {SLUG.format(c='genre')} <> ''"""),
    "serve_search": sql("ra articles", """
a AS (SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS pos, 'site' AS kind FROM articles
  WHERE published AND (contains(lower(title), 'er th') OR contains(lower(content), 'er th')) QUALIFY pos <= 30),
b AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS pos, 'wild' AS kind FROM articles
  WHERE contains(lower(title), 'src1_') OR contains(lower(slug), 'src1_') QUALIFY pos <= 20),
c AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS pos, 'draft' AS kind FROM articles
  WHERE NOT published AND (contains(lower(title), 'src1') OR coalesce(contains(lower(slug), 'src1'), false)) QUALIFY pos <= 20)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""),
    "serve_lookup": sql("ra articles", """
keys AS (SELECT DISTINCT coalesce(slug, id) AS key FROM articles)
SELECT key, (SELECT id FROM articles a WHERE a.slug = key AND published) AS id FROM keys"""),
    "serve_related": sql("ra articles links", LIST_SQL + f""",
top AS (SELECT id, {CAT} AS ck, row_number() OVER (PARTITION BY {CAT} ORDER BY np) AS r FROM newest QUALIFY r <= 10)
SELECT a.id, t.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY r) AS pos
FROM (SELECT id, {CAT} AS ck FROM articles WHERE published) a JOIN top t ON t.ck = a.ck AND t.id <> a.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY r) <= 3"""),
    "serve_meta_description": sql("ra articles", r"""
f AS (SELECT id, trim(regexp_replace(regexp_replace(content, '!\[[^\]]*\]\(https?://[^)\s]+\)', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM articles)
SELECT id, CASE WHEN t = '' THEN '한국어 EDM 뉴스 종합' WHEN length(t) <= 155 THEN t
  ELSE regexp_replace(substr(t, 1, 152), '\s+\S*$', '') || '...' END AS description FROM f"""),
    "serve_discover": sql("ra", f"""
m AS (SELECT *, replace(url, '/news/1', '/interview/1') AS u FROM ra WHERE suggestion_state IS NULL OR suggestion_state IN ('new', 'suggested'))
SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS pos FROM m
WHERE {" OR ".join(f"u ILIKE '%{w}%'" for w in v.INTERVIEW_URL)} OR {" OR ".join(f"title ILIKE '%{w}%'" for w in v.INTERVIEW_TITLE)}
  OR {" OR ".join(f"content ILIKE '%{w}%'" for w in v.INTERVIEW_CONTENT)} QUALIFY pos <= 100"""),
    "serve_tiers": sql("rss_sources", """
s AS (SELECT id, CASE WHEN name = 'Source SRC1' THEN 'Mixmag' ELSE name END AS name FROM rss_sources)
SELECT id, name, CASE WHEN name = 'Mixmag' THEN 'A' ELSE 'B' END AS tier FROM s"""),
    "serve_tier_counts": sql("ra rss_sources", """
SELECT 'B' AS tier, count(*) AS n FROM rss_sources UNION ALL SELECT 'C', count(DISTINCT coalesce(origin, 'none')) FROM ra"""),
}
