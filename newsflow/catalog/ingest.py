"""Registered queries: ingest, page extraction, harvested items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import Query, sql
from newsflow.catalog.text_sql import clean_text as clean_sql
from newsflow.functions import dates, urls
from newsflow.functions.html import scan_pages
from newsflow.functions.lineage import cut
from newsflow.functions.text import clean_text, or_empty
from newsflow.operators import entities as ent
from newsflow.operators import extract as x
from newsflow.operators import gate as g
from newsflow.operators import ingest as i
from newsflow.sources import driver_tables as dt

TODAY = "2024-01-20"


def today():
    return F.lit(TODAY).cast("date")


def _feed(s, d):
    """Feed items: every document as an item of its source, some without a link, some repeated."""
    n = F.col("doc_id")
    url = F.when(n % 23 == 22, "").otherwise(F.concat(F.lit("https://f.example.com/"), F.floor(n / 3).cast("long").cast("string")))
    return dt.table(s, d, "documents").select(F.col("source"), n.alias("pos"), url.alias("url"))


FEED_SQL = """
feed AS (SELECT source, doc_id AS pos, CASE WHEN doc_id % 23 = 22 THEN '' ELSE 'https://f.example.com/' || (doc_id // 3) END AS url FROM documents),
stored AS (SELECT DISTINCT 'https://f.example.com/' || (page_id * 2) AS url FROM pages)"""


def _stored(s, d):
    return dt.table(s, d, "pages").select(F.concat(F.lit("https://f.example.com/"), (F.col("page_id") * 2).cast("string")).alias("url"))


def _insert(s, d):
    return i.insert_if_absent(_feed(s, d).where("url <> ''"), _stored(s, d)).select("url", "source", "pos")


def _outcomes(s, d):
    return i.ingest_outcomes(_feed(s, d), _stored(s, d))


def _stamp(s, d):
    ra = dt.raw_articles(s, d).select("id", "origin", "source_id", F.concat(F.lit(" "), F.upper("url"), F.lit("// ")).alias("source_url"))
    return i.stamp_cohort(ra, "run-1").select("id", "ingestion_run_id", "ingestion_source")


def _published(s, d):
    """Publication texts of five forms made from the fetch time."""
    n = F.col("doc_id")
    t = F.col("fetched_at")
    f = lambda p: F.date_format(t, p)
    text = (
        F.when(n % 5 == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n % 5 == 1, f("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(n % 5 == 2, f("yyyy-MM-dd HH:mm:ss")).when(n % 5 == 3, F.concat(f("yyyy-MM-dd"), F.lit(" (updated)")))
        .otherwise(F.concat(F.lit("19"), f("yy-MM-dd")))
    )
    return dt.raw_articles(s, d).select("id", dates.parse_published(text).alias("published_at"))


def _urls(s, d):
    u = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=x&page="), F.col("doc_id").cast("string"), F.lit("&fbclid=1#top"))
    return dt.raw_articles(s, d).withColumn("url", u).select(
        "id", urls.canonical_url(F.col("url")).alias("canonical"), urls.strip_url(F.col("url")).alias("bare"), urls.host_key(F.col("url")).alias("host"))


def _listing(s, d):
    """Listing texts of six forms, with and without a year."""
    n = F.col("doc_id")
    t = F.date_add(F.lit("2024-01-05").cast("date"), (n % 40).cast("int"))
    f = lambda p: F.date_format(t, p)
    text = (
        F.when(n % 6 == 0, f("yyyy/MM/dd")).when(n % 6 == 1, f("yyyy年M月d日")).when(n % 6 == 2, f("M月d日"))
        .when(n % 6 == 3, f("M/d")).when(n % 6 == 4, f("d MMMM yyyy")).otherwise(f("MMM d"))
    )
    return dt.raw_articles(s, d).select("id", dates.listing_date(F.concat(F.lit("Doors open "), text, F.lit(" late")), today()).alias("item_date"))


def _rich(s, d, *parts):
    return scan_pages(dt.rich_pages(s, d), only=parts)


def _links(s, d):
    return x.page_links(scan_pages(dt.pages(s, d), only=["links"]))


def _select(s, d):
    """Link choice on the pages' own links."""
    return x.select_links(_links(s, d), today())


def _select_dated(s, d):
    """Link choice on links with dates, one per document, addressed below a news collection."""
    rich = dt.raw_articles(s, d)
    n = F.col("doc_id")
    links = rich.select(
        F.floor(n / 20).cast("string").alias("page_id"), F.lit("https://l.example.com/news/").alias("page_url"), n.alias("pos"),
        F.concat(F.lit("/news/story-"), F.floor(n / 2).cast("string")).alias("href"),
        F.concat(F.lit("https://www.l.example.com/news/"), F.when(n % 9 == 8, "page/").otherwise("story-"), F.floor(n / 2).cast("string"), F.lit("?utm_x=1#a")).alias("absolute"),
        "title", F.col("title").alias("text"), F.lit("").alias("context"),
        F.when(n % 4 == 0, F.date_add(F.lit("2024-01-05").cast("date"), (n % 40).cast("int")).cast("string")).alias("structured_date"))
    return x.select_links(links, today())


def _items(s, d):
    return g.parse_items(dt.harvest_outputs(s, d))


def _good(s, d):
    return _items(s, d).where("status = 'ok'")


def _bound(s, d):
    return g.bind_items(_good(s, d), dt.harvest_pages(s, d))


def _evidence(s, d):
    p = dt.harvest_pages(s, d).select("page_id", F.col("page_url").alias("url"), F.col("markdown").alias("text"), F.expr("cast(array() as array<struct<url:string,start:string>>)").alias("ld_events"))
    return x.page_date_evidence(p)


def _gate_input(s, d):
    # read twice below
    b = cut(g.ground_evidence(_bound(s, d)).join(dt.harvest_pages(s, d).select("page_id", "page_url"), "page_id"))
    hay = b.select(F.concat_ws(":", "page_id", "item_no").alias("id"), F.col("headline_en").alias("title"), F.col("source_text").alias("content"))
    matches = ent.entity_index(hay, dt.dictionary(s, d))
    gate = g.entity_gate(matches, ["id"])
    b = b.withColumn("id", F.concat_ws(":", "page_id", "item_no")).join(gate, "id", "left")
    return b.withColumn("date_evidence", F.lit("body_full_date")).withColumn("page_date_confident", F.lit(False))


def _gate(s, d):
    return g.unified_gate(_gate_input(s, d)).select(
        "page_id", "item_no", "decision", "path", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing", ",").alias("missing"))


def _keys(s, d):
    return g.candidate_key(_bound(s, d))


def _item_url(s, d):
    return g.item_url(_keys(s, d).withColumn("crawl_mode", F.lit("page"))).select("page_id", "item_no", "candidate_key", "article_url")


def _image(s, d):
    items = dt.raw_articles(s, d).select(
        dt.cluster_of(F.col("doc_id")).alias("page_id"), "id", F.array("image_url").alias("image_urls"))
    photos = items.select("page_id", F.concat(F.lit("https://p.example.com/"), "page_id").alias("photo_url")).distinct()
    return g.item_image(items, photos).select("page_id", "id", "image_url")


def _summary(s, d):
    stage = F.expr("CASE stage WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'harvested' WHEN 'signup' THEN 'inserted' WHEN 'purchase' THEN 'dup' ELSE stage END")
    ev = dt.event_log(s, d).withColumn("stage", stage).withColumn("seconds", F.col("value")).withColumn(
        "fetch_mode", F.when(F.col("source") < "src15", "plain").when(F.col("event_id") % 2 == 0, "rendered").otherwise("plain"))
    return g.source_summary(ev)


def _stale(s, d):
    items = dt.raw_articles(s, d).select("id", F.col("source_name").alias("source"), F.col("event_date").cast("string").alias("event_date"))
    return g.drop_stale(items, ["src0", "src4", "src8"], F.lit("2024-02-20").cast("date")).select("id")


def _index_item(s, d):
    items = dt.raw_articles(s, d).select(
        dt.cluster_of(F.col("doc_id")).alias("page_id"), F.col("doc_id").alias("item_no"), F.col("title").alias("headline_en"), "id",
        F.lit("https://x.example.com/the-techno-night-of-synth").alias("page_url"))
    return g.pick_index_item(items).select("page_id", "id")


def _backfill(s, d):
    """Articles whose title is their URL, with pages from the page table by position."""
    ra = dt.raw_articles(s, d).withColumn("title", F.when(F.col("origin") == "url", F.col("url")).otherwise(F.col("title")))
    pages = dt.rich_pages(s, d).drop("url").join(ra.select(F.col("id").alias("page_id"), "url"), "page_id")
    return x.title_backfill(ra, pages, 100)


QUERIES: dict[str, Query] = {
    "ingest_insert_if_absent": _insert,
    "ingest_outcomes": lambda s, d: i.outcome_counts(_outcomes(s, d)),
    "ingest_stamp": _stamp,
    "ingest_published": _published,
    "ingest_urls": _urls,
    "page_titles": lambda s, d: x.page_titles(dt.pages(s, d)),
    "page_titles_rich": lambda s, d: x.page_titles(dt.rich_pages(s, d)),
    "page_text": lambda s, d: x.page_text(dt.pages(s, d)),
    "page_media": lambda s, d: x.page_media(dt.rich_pages(s, d)),
    "page_photo": lambda s, d: x.page_photo(_rich(s, d, "meta", "images", "ld_values")),
    "page_published": lambda s, d: x.page_published(_rich(s, d, "meta", "times", "ld_values")),
    "page_clean_text": lambda s, d: dt.raw_articles(s, d).select("id", clean_text(or_empty(F.col("content"))).alias("text")),
    "page_denoise": lambda s, d: dt.table(s, d, "documents").select("doc_id", x.denoise_lines(F.col("text")).alias("text")),
    "page_reflow": lambda s, d: x.reflow(dt.table(s, d, "conversations"), "text").select("conv_id", "turn", "title", "body"),
    "page_title_backfill": _backfill,
    "page_adequacy": lambda s, d: x.fetch_adequacy(scan_pages(dt.pages(s, d), x.JS_SIGNALS, ["text"])),
    "page_links": _links,
    "page_select_links": _select,
    "page_select_dated_links": _select_dated,
    "page_listing_date": _listing,
    "page_trim": lambda s, d: dt.raw_articles(s, d).select("id", x.trim_text(F.col("content"), [" the ", ". "], 500).alias("text")),
    "page_event_dates": lambda s, d: x.event_date_candidates(_rich(s, d, "text"), "text", "page_id"),
    "page_date_evidence": lambda s, d: x.page_date_evidence(_rich(s, d, "text", "ld_events")).select(
        "page_id", F.array_join(F.col("json_ld_dates").cast("array<string>"), ",").alias("ld"),
        F.array_join(F.col("body_dates").cast("array<string>"), ",").alias("body"), "url_date", "url_supported"),
    "item_parse": lambda s, d: _items(s, d).select("page_id", "item_no", "status", "headline_en", "news_type", "event_date", F.col("facts.venue").alias("venue"), F.col("facts.ticket_url").alias("ticket_url")),
    "item_bind": lambda s, d: _bound(s, d).select("page_id", "item_no", "source_text", "binding_reason", "binding_confident"),
    "item_pick_index": _index_item,
    "item_event_date": lambda s, d: g.resolve_event_date(_good(s, d), _evidence(s, d)).select("page_id", "item_no", "resolved_date", "date_reason", "date_evidence"),
    "item_ground": lambda s, d: g.ground_evidence(_bound(s, d)).select("page_id", "item_no", F.size(F.flatten(F.map_values("grounded"))).alias("n"), "had_ungrounded"),
    "item_is_event": lambda s, d: _good(s, d).select("page_id", "item_no", g.is_event().alias("is_event")),
    "item_gate": _gate,
    "item_url": _item_url,
    "item_stale": _stale,
    "item_image": _image,
    "source_summary": _summary,
}

PAGE_TITLE = r"""
raw AS (SELECT page_id::VARCHAR AS page_id, url, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS h,
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM raw),
ok AS (SELECT *, length(h) >= 8 AND NOT regexp_matches(lower(h), '^https?://|^www\.|\bhttps?\b|\bwww\b|\b[a-z0-9-]+\.(com|net|org|co|uk|de|fr|io|fm)\b') AS hok,
  length(t) >= 8 AND NOT regexp_matches(lower(t), '^https?://|^www\.|\bhttps?\b|\bwww\b|\b[a-z0-9-]+\.(com|net|org|co|uk|de|fr|io|fm)\b') AS tok FROM c)"""

# the visible part of a page and, as a function of markup, its text with line ends around blocks
VISIBLE = r"""
bare AS (SELECT page_id::VARCHAR AS page_id, url, lower(html) AS low, regexp_replace(regexp_replace(regexp_replace(replace(replace(html,
  '&copy;', '©'), '&middot;', '·'), '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
  '(?s)<[A-Za-z/!?][^>]*$', '') AS v FROM pages),
visible AS (SELECT page_id, url, low, regexp_replace(v, '>\s+<', '><', 'g') AS v FROM bare)"""


def _decoded(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _plain(e: str) -> str:
    lines = f"regexp_replace({e}, '(?i)</?(?:article|br|div|h1|h2|h3|h4|li|main|p|section)(?:[\\s/][^>]*)?>', chr(10), 'g')"
    return _decoded(f"regexp_replace({lines}, '</?[A-Za-z!?][^>]*>', '', 'g')")


PAGE_TEXT = f"trim(regexp_replace(regexp_replace({_plain('v')}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"

# the day that the made pages of documents state
RICH = """
rich AS (SELECT doc_id AS d, lpad(doc_id::VARCHAR, 12, '0') AS page_id, 'https://' || source || '.example.com' AS root, DATE '2024-01-01' + (doc_id % 45)::INT AS day FROM documents)"""

# the items of the made answers; an answer that is cut short has none
HARVEST = f"""
own AS (SELECT {dt.CLUSTER_OF_SQL} AS page_id, doc_id AS d, id, trim(CASE WHEN doc_id % 13 = 12 THEN '' ELSE coalesce(title, '') END, ' ' || chr(9) || chr(13)) AS head,
  source_name, event_date, url FROM ra),
page AS (SELECT page_id, min(d) % 17 = 0 AS broken, regexp_extract(min(url), '^https?://[^/]+', 0) AS root FROM own GROUP BY 1),
item AS (SELECT page_id, root, d, head, source_name, event_date, (row_number() OVER (PARTITION BY page_id ORDER BY id) - 1)::INT AS item_no
  FROM own JOIN page USING (page_id) WHERE NOT broken)"""

ORACLE: dict[str, str] = {
    "item_parse": sql("ra", HARVEST + """
SELECT page_id, item_no, CASE WHEN head = '' THEN 'headline_empty' ELSE 'ok' END AS status, head AS headline_en,
  CASE WHEN d % 3 = 0 THEN 'club_event' ELSE 'release' END AS news_type, event_date::VARCHAR AS event_date,
  CASE WHEN d % 3 = 0 THEN 'Hall ' || source_name END AS venue, CASE WHEN d % 2 = 0 THEN root || '/tickets' END AS ticket_url FROM item
UNION ALL SELECT page_id, NULL, 'no_array', '', 'other', NULL, NULL, NULL FROM page WHERE broken"""),
    "item_is_event": sql("ra", HARVEST + """
SELECT page_id, item_no, d % 3 = 0 OR d % 2 = 0 OR event_date IS NOT NULL AS is_event FROM item WHERE head <> ''"""),
    "page_photo": "WITH " + RICH.strip() + """
SELECT page_id, CASE WHEN d % 4 = 0 THEN root || '/media/' || d || '.jpg' WHEN d % 5 = 0 THEN 'https://ld.example.com/' || d || '.jpg' ELSE root || '/c.jpg' END AS photo_url FROM rich""",
    "page_published": "WITH " + RICH.strip() + """
SELECT page_id, CASE WHEN d % 5 = 0 THEN day + INTERVAL 9 HOUR WHEN d % 6 = 1 THEN day + INTERVAL 8 HOUR ELSE day + INTERVAL 1 HOUR END AS published_at FROM rich""",
    "page_adequacy": "WITH " + VISIBLE.strip() + f""",
t AS (SELECT page_id, low, length({PAGE_TEXT}) AS n FROM visible)
SELECT page_id, n AS n_chars, CASE WHEN n < {x.PLAIN_MIN} THEN 'too_short' WHEN n < {x.JS_MIN} AND ({" OR ".join(f"contains(low, '{w}')" for w in x.JS_SIGNALS)})
  THEN 'needs_script' ELSE 'ok' END AS adequacy FROM t""",
    "page_links": "WITH " + VISIBLE.strip() + f""",
parts AS (SELECT page_id, url, string_split(v, '</a>') AS p FROM visible),
one AS (SELECT page_id, url, p, unnest(range(1, len(p))) AS i FROM parts),
met AS (SELECT page_id, url, i, regexp_extract(p[i], '(?s)^.*<a\\s([^>]*)>(.*)$', ['a', 'inner']) AS m, {_plain("array_to_string(p[1:i], '')")} AS before FROM one),
link AS (SELECT page_id, url, i, {_decoded("regexp_extract(m.a, 'href=\"([^\"]*)\"', 1)")} AS href, trim({_decoded("m.inner")}, ' ' || chr(10)) AS text,
  list_filter(regexp_split_to_array(before, '\\s+'), lambda w: w <> '') AS words FROM met WHERE m.a <> '')
SELECT page_id, url AS page_url, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, href, regexp_extract(url, '^https?://[^/]+', 0) || href AS absolute, text,
  NULL AS title, array_to_string(words[greatest(len(words) - 19, 1):], ' ') AS context, NULL AS structured_date FROM link""",
    "ingest_insert_if_absent": "WITH " + FEED_SQL.strip() + ("""
SELECT url, arg_min(source, pos) AS source, min(pos) AS pos FROM feed WHERE url <> '' AND url NOT IN (SELECT url FROM stored) GROUP BY url"""),
    "ingest_outcomes": "WITH " + FEED_SQL.strip() + (""",
o AS (SELECT source, CASE WHEN url = '' THEN 'no_link' WHEN url IN (SELECT url FROM stored) THEN 'url_exists'
  WHEN row_number() OVER (PARTITION BY url ORDER BY source, pos) = 1 THEN 'inserted' ELSE 'url_exists' END AS outcome FROM feed)
SELECT coalesce(source, 'all') AS source, count(*) AS seen, count_if(outcome = 'inserted') AS inserted, count_if(outcome = 'url_exists') AS url_exists,
  0 AS unique_conflict, count_if(outcome = 'no_link') AS no_link, 0 AS failed FROM o GROUP BY ROLLUP (o.source)"""),
    "ingest_stamp": sql("ra", """
SELECT id, 'run-1' AS ingestion_run_id, CASE origin WHEN 'rss' THEN 'rss:' || source_id WHEN 'url' THEN 'direct_url'
  WHEN 'correspondent' THEN 'correspondent:' || substr(sha256(lower(url)), 1, 24) END AS ingestion_source FROM ra"""),
    "ingest_published": sql("ra", """
SELECT id, CASE WHEN doc_id % 5 < 3 THEN fetched_at WHEN doc_id % 5 = 3 THEN date_trunc('day', fetched_at)::TIMESTAMP END AS published_at FROM ra"""),
    "ingest_urls": sql("ra", """
SELECT id, split_part(url, '?', 1) || '?page=' || doc_id || '#top' AS canonical, split_part(url, '?', 1) AS bare, regexp_extract(url, '^https://([^/]+)', 1) AS host FROM ra"""),
    "page_titles": "WITH " + PAGE_TITLE.strip() + r"""
SELECT page_id, CASE WHEN hok THEN substr(h, 1, 220) WHEN tok THEN substr(t, 1, 220) END AS title FROM ok""",
    "page_listing_date": sql("ra", "SELECT id, DATE '2024-01-05' + (doc_id % 40)::INT AS item_date FROM ra"),
    "page_trim": sql("ra", """
SELECT id, substr(split_part(split_part(content, ' the ', 1), '. ', 1), 1, 500) AS text FROM ra"""),
    "item_pick_index": sql("ra", f"""
w AS (SELECT {dt.CLUSTER_OF_SQL} AS page_id, id, doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}')), ['the', 'techno', 'night', 'of', 'synth'])) AS o FROM ra)
SELECT page_id, id FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY o DESC, doc_id) = 1"""),
    "item_stale": sql("ra", """
SELECT id FROM ra WHERE NOT (source_name IN ('src0', 'src4', 'src8') AND coalesce(event_date < DATE '2024-02-20' - 30, false))"""),
    "item_image": sql("ra", f"""
m AS (SELECT {dt.CLUSTER_OF_SQL} AS page_id, id, image_url FROM ra)
SELECT page_id, id, CASE WHEN count(*) OVER (PARTITION BY page_id) > 1 THEN coalesce(image_url, 'https://p.example.com/' || page_id) ELSE 'https://p.example.com/' || page_id END AS image_url FROM m"""),
    "source_summary": sql("event_log", """
e AS (SELECT *, CASE WHEN source < 'src15' THEN 'plain' WHEN event_id % 2 = 0 THEN 'rendered' ELSE 'plain' END AS mode FROM event_log)
SELECT source, count_if(stage = 'view') AS fetched, count_if(stage = 'click') AS harvested, 0 AS gated_out, count_if(stage = 'signup') AS inserted, count_if(stage = 'purchase') AS dup,
  count_if(stage = 'error') AS errors, round(avg(value) FILTER (stage = 'view'), 4) AS mean_seconds, CASE WHEN min(mode) = max(mode) THEN min(mode) ELSE 'mixed' END AS fetch_mode
FROM e GROUP BY 1"""),
    "page_clean_text": sql("ra", f"SELECT id, {clean_sql('content', 10000)} AS text FROM ra"),
}
