"""Registered queries: story grouping, scoring, merging and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.entities import INDEX_SQL, index
from newsflow.catalog.text_sql import is_category, normalize_text, snippet
from newsflow.functions.lineage import cut, store
from newsflow.functions.text import clean_text, is_low_signal, is_source_or_series, is_specific_entity, is_url_text
from newsflow.operators import stories as st
from newsflow.operators.components import components
from newsflow.sources import driver_tables as dt

AS_OF = "2024-01-02 00:00:00"


def _capped(s, d):
    ra, idx = dt.raw_articles(s, d), cut(index(s, d))
    return ra, idx, st.cap_entity_articles(idx, ra)


def _pair_edges(s, d):
    idx = cut(index(s, d))
    return st.pair_edges(st.entity_members(idx), idx, dt.raw_articles(s, d))


def _edges(s, d):
    ra, idx, cap = _capped(s, d)
    return idx, st.pair_edges(cap, idx, ra)


def _comp(s, d):
    idx, edges = _edges(s, d)
    edges = cut(edges)
    return idx, edges, components(edges)


def _trim(s, d):
    idx, edges, comp = _comp(s, d)
    return idx, st.trim_components(comp, edges)


def _label(s, d):
    idx, trimmed = _trim(s, d)
    out = st.label_components(trimmed, idx, dt.dictionary(s, d))
    return out.select("pos", "component", "entity", F.array_join("article_ids", ",").alias("article_ids"),
                      F.round("weight_sum", 4).alias("weight_sum"))


def _stored(s, d):
    p = dt.proposals(s, d)
    return p.select(F.col("id").alias("group_id"), "topic", "keywords", "article_ids",
                    F.col("keywords").alias("common_entities"), "status")


def _features(s, d):
    return st.article_features(dt.raw_articles(s, d), index(s, d))


def _stored_members(s, d):
    return st.with_members(_stored(s, d), _features(s, d))


def _cohesion(s, d):
    return st.cohesion(_stored_members(s, d)).select("group_id", "cohesion")


def _rank(s, d):
    g = st.cohesion(_stored_members(s, d)).withColumnRenamed("cohesion", "cohesion_score")
    out = st.rank_groups(g, dt.dictionary(s, d), F.lit(AS_OF).cast("timestamp"))
    return out.select("group_id", "rank", F.round("score", 4).alias("score"))


def _normalized(s, d):
    return st.normalize_proposals(dt.model_proposals(s, d), _features(s, d))


def _kept(s, d):
    return _normalized(s, d).where("drop_reason IS NULL")


def _merged(s, d):
    return st.merge_groups(_kept(s, d))


def _rules(s, d):
    return dt.dictionary(s, d).where("role = 'supporting'").select(
        F.col("canonical").alias("pattern"), F.lit(True).alias("enabled"))


def _filter(s, d):
    groups = _stored(s, d).withColumn("rank", F.col("group_id"))
    out = st.filter_known(groups, dt.proposals(s, d).where("status <> 'pending'"), dt.articles(s, d), dt.clusters(s, d), _rules(s, d))
    return out.select("group_id", "drop_reason")


def _ledger(s, d):
    norm = store(_normalized(s, d))
    merged = st.merge_groups(norm.where("drop_reason IS NULL"))
    ranked = st.rank_groups(merged, dt.dictionary(s, d), F.lit(AS_OF).cast("timestamp"))
    filtered = st.filter_known(ranked, dt.proposals(s, d), dt.articles(s, d), dt.clusters(s, d), _rules(s, d))
    return st.drop_ledger(norm, merged, ranked, filtered)


def _terms(s, d):
    g = dt.raw_articles(s, d).select(
        "id", F.explode(F.split("title", " ")).alias("term"))
    t = F.col("term")
    return g.select(
        "id", "term", is_url_text(t).alias("url"), is_source_or_series(t).alias("series"),
        is_low_signal(t).alias("low"), is_specific_entity(t).alias("specific"),
    ).groupBy("term").agg(*[F.max(c).alias(c) for c in ("url", "series", "low", "specific")])


def _clean_terms(s, d):
    out = st.clean_terms(dt.model_proposals(s, d))
    return out.select("group_id", F.array_join("keywords", "|").alias("keywords"),
                      F.array_join("common_entities", "|").alias("common_entities"))


def _cluster(s, d):
    ra = dt.raw_articles(s, d)
    a = st.build_cluster(ra, "k-or", "Techno", ["techno", "DJ (set)"])
    b = st.build_cluster(ra, "k-and", "Synth", ["synth", "album"], mode="and")
    c = st.build_cluster(ra, "k-ids", "Gate", ids=ra.where("facts.correspondent_gate.path = 'entity'").select("id"))
    return a.unionByName(b).unionByName(c).select("cluster_id", "topic", "raw_article_id")


def _hydrate(s, d):
    out = st.hydrate_proposals(dt.proposals(s, d), dt.raw_articles(s, d))
    return out.select(
        "group_id", F.array_join(F.transform("articles", lambda a: a["url"]), " ").alias("urls"),
        F.coalesce(F.array_join("common_entities", "|"), F.lit("")).alias("entities"), "cohesion_score")


QUERIES: dict[str, Query] = {
    "story_cap_entity": lambda s, d: _capped(s, d)[2],
    "story_pair_edges": _pair_edges,
    "story_components": lambda s, d: _comp(s, d)[2],
    "story_trim": lambda s, d: _trim(s, d)[1],
    "story_label": _label,
    "story_date_conflict": lambda s, d: st.date_conflict(_stored(s, d), dt.raw_articles(s, d)),
    "story_cohesion": _cohesion,
    "story_parse_proposals": lambda s, d: st.parse_proposals(dt.model_outputs(s, d)).select(
        "output_id", "parse", "proposal_no", "topic", F.element_at("article_ids", 1).alias("article_id"), "is_singleton"),
    "story_term_checks": _terms,
    "story_clean_terms": _clean_terms,
    "story_normalize": lambda s, d: _normalized(s, d).select(
        "group_id", F.array_join("common_entities", "|").alias("entities"), "cohesion_score", "drop_reason"),
    "story_terms": lambda s, d: st.story_terms(_kept(s, d)).select(
        "group_id", F.array_join(F.array_sort("terms"), "|").alias("terms")),
    "story_merge_pairs": lambda s, d: st.merge_pairs(_kept(s, d)),
    "story_merge_groups": lambda s, d: _merged(s, d).select(
        "run_id", F.array_join("merged_from", "+").alias("parts"), "topic", F.array_join("article_ids", ",").alias("ids"), "cohesion_score"),
    "story_rank": _rank,
    "story_filter_known": _filter,
    "story_topic_provenance": lambda s, d: st.topic_provenance(
        dt.proposals(s, d), dt.articles(s, d), dt.clusters(s, d)
    ).select("key", F.array_join("origins", "|").alias("origins")),
    "story_build_cluster": _cluster,
    "story_attach_source": lambda s, d: st.attach_source(dt.raw_articles(s, d), dt.rss_sources(s, d)).select("id", "feed_name"),
    "story_hydrate_proposals": _hydrate,
    "story_drop_ledger": _ledger,
}

CAP_SQL = "WHERE entity_rank <= 15 "  # not part of story_pair_edges
EDGE_SQL = INDEX_SQL + r""",
capped AS (
  SELECT canonical, id, entity_rank FROM (
    SELECT canonical, id, row_number() OVER (PARTITION BY canonical ORDER BY published_at DESC NULLS LAST, id) AS entity_rank
    FROM idx JOIN ra USING (id) WHERE role = 'qualifying')
  WHERE entity_rank <= 15 QUALIFY count(*) OVER (PARTITION BY canonical) >= 2
),
ents AS (SELECT id, list(DISTINCT canonical) AS ents FROM idx WHERE role = 'qualifying' GROUP BY id),
words AS (
  SELECT id, published_at, event_date, list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
    lambda x: length(x) > 1 AND x NOT IN ('feat','ft','remix','ep','album','single','track','the','a','an','and','or','of','in','on','at','to','for','with')) AS words FROM ra
),
pairs AS (SELECT DISTINCT l.id AS a, r.id AS b FROM capped l JOIN capped r ON l.canonical = r.canonical AND l.id < r.id),
scored AS (
  SELECT a, b, CASE WHEN len(list_intersect(ea.ents, eb.ents)) >= 2 THEN 3 ELSE 1 END
      + CASE WHEN abs(epoch_us(wa.published_at) - epoch_us(wb.published_at)) <= 3 * 86400000000 THEN 3
             WHEN abs(epoch_us(wa.published_at) - epoch_us(wb.published_at)) <= 7 * 86400000000 THEN 1 ELSE 0 END
      + CASE WHEN list_has_any(wa.words, wb.words) THEN 2 ELSE 0 END AS score
  FROM pairs JOIN ents ea ON ea.id = a JOIN ents eb ON eb.id = b JOIN words wa ON wa.id = a JOIN words wb ON wb.id = b
  WHERE wa.event_date IS NULL OR wb.event_date IS NULL OR wa.event_date = wb.event_date
),
edges AS (SELECT * FROM scored WHERE score >= 3),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, root) AS (
  SELECT DISTINCT a, a FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.id
),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
degree AS (SELECT id, sum(score) AS degree FROM (SELECT a AS id, score FROM edges UNION ALL SELECT b, score FROM edges) GROUP BY id),
trimmed AS (
  SELECT component, id, degree::BIGINT AS degree FROM comp JOIN degree USING (id)
  QUALIFY row_number() OVER (PARTITION BY component ORDER BY degree DESC, id) <= 5
),
label AS (
  SELECT component, arg_min(canonical, (-n, canonical)) AS entity FROM (
    SELECT component, canonical, count(*) AS n FROM trimmed JOIN idx USING (id) WHERE role = 'qualifying' GROUP BY 1, 2) GROUP BY 1
),
labelled AS (
  SELECT t.component, any_value(entity) AS entity, string_agg(t.id, ',' ORDER BY t.id) AS article_ids,
    count(*) * any_value(weight) AS weight_sum
  FROM trimmed t JOIN label USING (component) JOIN dict ON canonical = entity GROUP BY t.component
)"""

COHESION_SQL = f"""
texts AS (SELECT id, {normalize_text("title || ' ' || " + snippet('content'))} AS text, source_id, published_at FROM ra),
groups AS (SELECT id AS group_id, topic, keywords, article_ids, status FROM proposals),
ga AS (SELECT group_id, unnest(article_ids) AS id FROM groups),
ge AS (SELECT group_id, unnest(keywords) AS e FROM groups),
hits AS (
  SELECT ge.group_id, ge.e, count_if(contains(text, {normalize_text('ge.e')})) AS h
  FROM ge JOIN ga ON ga.group_id = ge.group_id JOIN texts ON texts.id = ga.id GROUP BY 1, 2
),
cats AS (SELECT group_id, bool_and({is_category('e')}) AS all_cat FROM ge GROUP BY 1),
coh AS (
  SELECT g.group_id, CASE WHEN len(article_ids) < 2 OR len(keywords) = 0 THEN 0 ELSE
    greatest(0, least(100, floor(sum(h) / (len(article_ids) * len(keywords)) * 80 + least(len(article_ids), 5) * 4
      - CASE WHEN any_value(all_cat) THEN 45 ELSE 0 END + 0.5))) END::INT AS cohesion
  FROM groups g LEFT JOIN hits USING (group_id) LEFT JOIN cats USING (group_id) GROUP BY g.group_id, article_ids, keywords
)"""

KNOWN_SQL = """
pub_keys AS (SELECT DISTINCT lower(trim(topic)) AS key FROM clusters WHERE id IN (SELECT cluster_id FROM articles WHERE published)),
"""

ORACLE: dict[str, str] = {
    "story_parse_proposals": sql("ra", """
b AS (SELECT lpad((doc_id // 20)::VARCHAR, 12, '0') AS output_id, doc_id // 20 AS n, id, title, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY id) - 1 AS p FROM ra)
SELECT output_id, CASE WHEN n % 3 = 0 THEN 'braces' ELSE 'whole' END AS parse, p::INT AS proposal_no, title AS topic, id AS article_id, true AS is_singleton
FROM b WHERE n % 17 <> 16
UNION ALL SELECT DISTINCT output_id, 'failed', NULL::INT, NULL, NULL, false FROM b WHERE n % 17 = 16"""),
    "story_cap_entity": sql("ra dict", EDGE_SQL + "\nSELECT canonical, id, entity_rank FROM capped", True),
    "story_pair_edges": sql("ra dict", EDGE_SQL.replace(CAP_SQL, "") + "\nSELECT a, b, score FROM edges", True),
    "story_components": sql("ra dict", EDGE_SQL + "\nSELECT id, component FROM comp", True),
    "story_trim": sql("ra dict", EDGE_SQL + "\nSELECT component, id, degree FROM trimmed", True),
    "story_label": sql("ra dict", EDGE_SQL + """
SELECT row_number() OVER (ORDER BY weight_sum DESC, component) AS pos, component, entity, article_ids, round(weight_sum, 4) AS weight_sum
FROM labelled QUALIFY row_number() OVER (ORDER BY weight_sum DESC, component) <= 30""", True),
    "story_date_conflict": sql("ra proposals", """
ids AS (SELECT id AS group_id, unnest(article_ids) AS aid FROM proposals)
SELECT group_id, count(DISTINCT event_date) AS n_dates, count(DISTINCT event_date) > 1 AS conflict
FROM ids LEFT JOIN ra ON ra.id = aid GROUP BY 1"""),
    "story_cohesion": sql("ra proposals", COHESION_SQL + "\nSELECT group_id, cohesion FROM coh"),
    "story_rank": sql("ra proposals dict", COHESION_SQL + f""",
w AS (SELECT group_id, max(coalesce(weight, 0)) AS w FROM ge LEFT JOIN dict ON dict.canonical = lower(e) AND role <> 'supporting' GROUP BY 1),
src AS (SELECT group_id, count(DISTINCT source_id) AS n_src, count(*) AS n,
    bool_or(coalesce(TIMESTAMP '{AS_OF}' - published_at <= INTERVAL 48 HOUR, false)) AS fresh FROM ga JOIN texts USING (id) GROUP BY 1),
s AS (SELECT group_id, cohesion + coalesce(w, 0) * 15 + least(n, 4) * 5 + n_src * 10 + CASE WHEN fresh THEN 5 ELSE 0 END AS score
  FROM coh LEFT JOIN w USING (group_id) JOIN src USING (group_id))
SELECT group_id, row_number() OVER (ORDER BY round(score, 6) DESC, group_id) AS rank, round(score, 4) AS score FROM s
QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, group_id) <= 30"""),
    "story_filter_known": sql("ra proposals articles clusters dict", """
taken AS (
  SELECT lower(trim(topic)) AS key FROM proposals WHERE status = 'rejected'
  UNION SELECT lower(trim(topic)) FROM clusters WHERE id IN (SELECT cluster_id FROM articles WHERE published)
),
g AS (
  SELECT id AS group_id, lower(trim(topic)) AS key,
    lower(topic || chr(10) || array_to_string(keywords, chr(10)) || chr(10) || array_to_string(keywords, chr(10))) AS text FROM proposals
),
f AS (
  SELECT *, key IN (SELECT key FROM taken) AS known,
    EXISTS (SELECT 1 FROM dict WHERE role = 'supporting' AND contains(text, canonical)) AS blocked FROM g
)
SELECT group_id, CASE WHEN known THEN 'duplicate_topic' WHEN blocked THEN 'blocklist'
  WHEN row_number() OVER (PARTITION BY key, known, blocked ORDER BY group_id) > 1 THEN 'duplicate_topic' END AS drop_reason FROM f"""),
    "story_topic_provenance": sql("ra proposals articles clusters", """
o AS (
  SELECT lower(trim(topic)) AS key, 'suggested_clusters:' || status AS origin FROM proposals WHERE status IN ('pending', 'rejected', 'published') AND topic <> ''
  UNION SELECT lower(trim(topic)), 'published_articles:article_clusters' FROM clusters
    WHERE id IN (SELECT cluster_id FROM articles WHERE published) AND topic <> ''
)
SELECT key, string_agg(origin, '|' ORDER BY origin) AS origins FROM o GROUP BY 1"""),
    "story_build_cluster": sql("ra", """
a AS (SELECT 'k-or' AS cluster_id, 'Techno' AS topic, id AS raw_article_id FROM ra
  WHERE title ILIKE '%techno%' OR content ILIKE '%techno%' OR title ILIKE '%DJ set%' OR content ILIKE '%DJ set%'
  ORDER BY published_at DESC NULLS FIRST, id LIMIT 20),
b AS (SELECT 'k-and' AS cluster_id, 'Synth' AS topic, id FROM ra
  WHERE (title ILIKE '%synth%' OR content ILIKE '%synth%') AND (title ILIKE '%album%' OR content ILIKE '%album%')
  ORDER BY published_at DESC NULLS FIRST, id LIMIT 20)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 'k-ids', 'Gate', id FROM ra WHERE gate_path = 'entity'"""),
    "story_attach_source": sql("ra rss_sources", "SELECT ra.id, s.name AS feed_name FROM ra LEFT JOIN rss_sources s ON s.id = ra.source_id"),
    "story_hydrate_proposals": sql("ra proposals", f"""
e AS (SELECT id AS group_id, article_ids, list_filter(keywords, lambda x: NOT {is_category('x')}) AS ents FROM proposals),
m AS (SELECT group_id, unnest(article_ids) AS id FROM e),
mm AS (SELECT group_id, m.id, url, {normalize_text("title || ' '")} AS text FROM m JOIN ra USING (id)),
h AS (SELECT x.group_id, count_if(contains(text, {normalize_text('x.e')})) AS h FROM (SELECT group_id, unnest(ents) AS e FROM e) x JOIN mm USING (group_id) GROUP BY 1)
SELECT e.group_id, (SELECT string_agg(url, ' ' ORDER BY id) FROM mm WHERE mm.group_id = e.group_id) AS urls,
  array_to_string(ents, '|') AS entities,
  CASE WHEN len(ents) > 0 THEN CASE WHEN len(article_ids) < 2 THEN 0 ELSE
    greatest(0, least(100, floor(h / (len(article_ids) * len(ents)) * 80 + least(len(article_ids), 5) * 4 + 0.5))) END END::INT AS cohesion_score
FROM e LEFT JOIN h USING (group_id)"""),
}
