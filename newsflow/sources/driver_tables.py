"""The news tables as views over the generated test tables.

Only integer arithmetic on ids is used, so that any SQL engine builds the same rows.
Every row of a base table appears in the views made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.lineage import cut

T0 = 1704067200  # 2024-01-01 00:00:00 UTC
ID_WIDTH = 12
CATEGORIES = ["News", "Releases", "Interviews", "Features"]
GENRES = ["House", "Techno", "Trance"]


ROW_KEYS = {"documents": "doc_id", "pages": "page_id", "events": "event_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, spread over the cores when it has fewer splits than there are cores.

    A table of many splits is read as it is, so large inputs are never shuffled here.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ROW_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, ROW_KEYS[name])
    return df


def padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), ID_WIDTH, "0")


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(T0) + seconds)


SUFFIXES = [" techno night", " synth album", " hip-hop DJ", " e-bike synth review", " DJ set"]


def title_suffix(d: Column) -> Column:
    """Field words on five of thirteen titles, so that the topic rules have something to find."""
    out = F.lit("")
    for i, s in enumerate(SUFFIXES):
        out = F.when(d % 13 == i, s).otherwise(out)
    return out


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw article per document."""
    d = F.col("doc_id")
    origin = (
        F.when(d % 20 <= 11, "rss").when(d % 20 <= 16, "correspondent").when(d % 20 == 17, "url")
    )
    fetched = d * 60
    run = F.concat(F.lit("00000000-0000-4000-8000-"), padded(F.floor(d / 100).cast("long")))
    gate = F.when(
        (origin == "correspondent") & (d % 2 == 0),
        F.struct(
            F.lit("accepted").alias("decision"),
            F.when(d % 4 == 0, "dance_experience").otherwise("entity").alias("path"),
            F.concat(F.lit("key-"), d.cast("string")).alias("candidate_key"),
        ),
    )
    return table(spark, sf_dir, "documents").select(
        padded(d).alias("id"),
        F.concat(F.substring(F.substring_index("text", "\n", 1), 1, 120), title_suffix(d)).alias("title"),
        F.col("text").alias("content"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/news/"), d.cast("string"),
            F.when(d % 5 == 0, "?utm_source=feed").otherwise(""),
        ).alias("url"),
        F.when(d % 3 == 0, F.concat(F.lit("https://img.example.com/"), d.cast("string"), F.lit(".jpg")))
        .when(d % 3 == 1, F.concat(F.lit("https://cdn.example.com/blocked/"), d.cast("string")))
        .alias("image_url"),
        F.when(origin == "rss", F.col("source")).alias("source_id"),
        origin.alias("origin"),
        F.when(d % 10 != 3, at(fetched - (d % 240) * 3600)).alias("published_at"),
        at(fetched).alias("fetched_at"),
        F.when(d % 4 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (d % 45).cast("int")))
        .alias("event_date"),
        F.when(d % 7 == 0, None).when(d % 7 <= 4, "new").when(d % 7 == 5, "suggested")
        .otherwise("used").alias("suggestion_state"),
        F.when(d % 3 == 0, at(fetched + 86400)).alias("suggestion_last_checked_at"),
        F.when(d % 7 == 6, at(fetched + 172800)).alias("suggestion_used_at"),
        F.when(d % 11 == 5, at(fetched + 129600)).alias("suggestion_rejected_at"),
        F.when(d % 9 != 8, run).alias("ingestion_run_id"),
        F.when(origin == "rss", F.concat(F.lit("rss:"), "source"))
        .when(origin == "correspondent", F.concat(F.lit("correspondent:"), "source"))
        .when(origin == "url", "direct_url").alias("ingestion_source"),
        F.struct(gate.alias("correspondent_gate")).alias("facts"),
        F.col("source").alias("source_name"),
        d.alias("doc_id"),
    )


RAW_ARTICLES_SQL = """
ra AS (
  SELECT lpad(d::VARCHAR, 12, '0') AS id,
    substr(split_part(text, chr(10), 1), 1, 120) || CASE d % 13 WHEN 0 THEN ' techno night'
      WHEN 1 THEN ' synth album' WHEN 2 THEN ' hip-hop DJ' WHEN 3 THEN ' e-bike synth review'
      WHEN 4 THEN ' DJ set' ELSE '' END AS title, text AS content,
    'https://' || source || '.example.com/news/' || d
      || CASE WHEN d % 5 = 0 THEN '?utm_source=feed' ELSE '' END AS url,
    CASE WHEN d % 3 = 0 THEN 'https://img.example.com/' || d || '.jpg'
         WHEN d % 3 = 1 THEN 'https://cdn.example.com/blocked/' || d END AS image_url,
    CASE WHEN origin = 'rss' THEN source END AS source_id, origin,
    CASE WHEN d % 10 <> 3 THEN make_timestamp((1704067200 + d * 60 - (d % 240) * 3600) * 1000000) END AS published_at,
    make_timestamp((1704067200 + d * 60) * 1000000) AS fetched_at,
    CASE WHEN d % 4 = 0 THEN DATE '2024-01-01' + (d % 45)::INTEGER END AS event_date,
    CASE WHEN d % 7 = 0 THEN NULL WHEN d % 7 <= 4 THEN 'new' WHEN d % 7 = 5 THEN 'suggested' ELSE 'used' END AS suggestion_state,
    CASE WHEN d % 3 = 0 THEN make_timestamp((1704067200 + d * 60 + 86400) * 1000000) END AS suggestion_last_checked_at,
    CASE WHEN d % 7 = 6 THEN make_timestamp((1704067200 + d * 60 + 172800) * 1000000) END AS suggestion_used_at,
    CASE WHEN d % 11 = 5 THEN make_timestamp((1704067200 + d * 60 + 129600) * 1000000) END AS suggestion_rejected_at,
    CASE WHEN d % 9 <> 8 THEN '00000000-0000-4000-8000-' || lpad((d // 100)::VARCHAR, 12, '0') END AS ingestion_run_id,
    CASE origin WHEN 'rss' THEN 'rss:' || source WHEN 'correspondent' THEN 'correspondent:' || source
         WHEN 'url' THEN 'direct_url' END AS ingestion_source,
    CASE WHEN origin = 'correspondent' AND d % 2 = 0
         THEN CASE WHEN d % 4 = 0 THEN 'dance_experience' ELSE 'entity' END END AS gate_path,
    source AS source_name, d AS doc_id,
    CASE WHEN origin = 'rss' THEN 'rss:' || source ELSE coalesce(
      CASE origin WHEN 'correspondent' THEN 'correspondent:' || source WHEN 'url' THEN 'direct_url' END,
      coalesce(origin, 'legacy') || ':unknown') END AS src_key
  FROM (SELECT doc_id AS d, text, source,
          CASE WHEN doc_id % 20 <= 11 THEN 'rss' WHEN doc_id % 20 <= 16 THEN 'correspondent'
               WHEN doc_id % 20 = 17 THEN 'url' END AS origin
        FROM documents)
)"""


def rss_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds: one per document source."""
    return (
        table(spark, sf_dir, "documents").select("source").distinct().select(
            F.col("source").alias("id"),
            F.concat(F.lit("Source "), F.upper("source")).alias("name"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"),
        )
    )


RSS_SOURCES_SQL = """
rss_sources AS (
  SELECT DISTINCT source AS id, 'Source ' || upper(source) AS name,
    'https://' || source || '.example.com/feed' AS url FROM documents
)"""


def cluster_of(d: Column) -> Column:
    """Every fifth document is a cluster of its own, the others form clusters of four."""
    return F.when(d % 5 == 4, F.concat(F.lit("s"), padded(d))).otherwise(
        F.concat(F.lit("c"), padded(F.floor(d / 5).cast("long")))
    )


CLUSTER_OF_SQL = (
    "CASE WHEN doc_id % 5 = 4 THEN 's' || lpad(doc_id::VARCHAR, 12, '0') "
    "ELSE 'c' || lpad((doc_id // 5)::VARCHAR, 12, '0') END"
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster membership of every raw article."""
    return table(spark, sf_dir, "documents").select(
        cluster_of(F.col("doc_id")).alias("cluster_id"), padded(F.col("doc_id")).alias("raw_article_id")
    )


LINKS_SQL = f"""
links AS (
  SELECT {CLUSTER_OF_SQL} AS cluster_id, lpad(doc_id::VARCHAR, 12, '0') AS raw_article_id FROM documents
)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the title of their lowest member as topic."""
    ra = raw_articles(spark, sf_dir)
    return ra.groupBy(cluster_of(F.col("doc_id")).alias("id")).agg(
        F.min_by("title", "id").alias("topic")
    )


CLUSTERS_SQL = f"""
clusters AS (
  SELECT {CLUSTER_OF_SQL} AS id, arg_min(title, ra.id) AS topic FROM ra GROUP BY 1
)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One written article per document."""
    d = F.col("doc_id")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (d % 4 + 1).cast("int"))
    genre = F.element_at(F.array(*[F.lit(g) for g in GENRES]), (d % 3 + 1).cast("int"))
    return raw_articles(spark, sf_dir).select(
        F.concat(F.lit("a"), "id").alias("id"),
        F.when(d % 11 != 0, F.concat("source_name", F.lit("-"), d.cast("string"))).alias("slug"),
        "title",
        "content",
        cluster_of(d).alias("cluster_id"),
        F.when(d % 4 == 1, F.concat(F.lit("https://own.example.com/"), d.cast("string"), F.lit(".png")))
        .alias("image_url"),
        (d % 3 != 0).alias("published"),
        F.when(d % 3 != 0, F.col("published_at")).alias("published_at"),
        F.col("fetched_at").alias("created_at"),
        F.when(d % 3 != 0, F.timestamp_seconds(F.unix_timestamp("fetched_at") + 3600)).alias("updated_at"),
        cat.alias("category"),
        F.when(d % 4 == 1, genre).alias("genre"),
        d.alias("doc_id"),
    )


ARTICLES_SQL = f"""
articles AS (
  SELECT 'a' || id AS id,
    CASE WHEN doc_id % 11 <> 0 THEN source_name || '-' || doc_id END AS slug, title, content,
    {CLUSTER_OF_SQL} AS cluster_id,
    CASE WHEN doc_id % 4 = 1 THEN 'https://own.example.com/' || doc_id || '.png' END AS image_url,
    doc_id % 3 <> 0 AS published,
    CASE WHEN doc_id % 3 <> 0 THEN published_at END AS published_at, fetched_at AS created_at,
    CASE WHEN doc_id % 3 <> 0 THEN fetched_at + INTERVAL 1 HOUR END AS updated_at,
    ['News', 'Releases', 'Interviews', 'Features'][doc_id % 4 + 1] AS category,
    CASE WHEN doc_id % 4 = 1 THEN ['House', 'Techno', 'Trance'][doc_id % 3 + 1] END AS genre, doc_id
  FROM ra
)"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored proposal per cluster."""
    d = F.col("doc_id")
    number = F.substring("id", 2, ID_WIDTH).cast("long")
    rows = raw_articles(spark, sf_dir).groupBy(cluster_of(d).alias("id")).agg(
        F.min_by("title", "id").alias("topic"),
        F.array_sort(F.collect_list("id")).alias("article_ids"),
    )
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("pending", "approved", "rejected", "published")]),
        (number % 4 + 1).cast("int"),
    )
    words = F.filter(F.split(F.lower("topic"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return rows.select(
        "id", "topic", F.slice(F.array_distinct(words), 1, 6).alias("keywords"), "article_ids",
        status.alias("status"), F.col("id").alias("cluster_id"),
        at(number * 300).alias("created_at"),
    )


PROPOSALS_SQL = f"""
proposals AS (
  SELECT id, topic,
    list_distinct_ordered AS keywords, article_ids,
    ['pending', 'approved', 'rejected', 'published'][substr(id, 2)::BIGINT % 4 + 1] AS status,
    id AS cluster_id, make_timestamp((1704067200 + substr(id, 2)::BIGINT * 300) * 1000000) AS created_at
  FROM (
    SELECT *, list_transform(list_filter(
        list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END),
        lambda x: x IS NOT NULL), lambda x: x)[1:6] AS list_distinct_ordered
    FROM (
      SELECT {CLUSTER_OF_SQL} AS id, arg_min(title, ra.id) AS topic, list(ra.id ORDER BY ra.id) AS article_ids,
        list_filter(string_split_regex(lower(arg_min(title, ra.id)), '[^a-z0-9]+'), lambda x: length(x) >= 4) AS w
      FROM ra GROUP BY 1
    )
  )
)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit labels: relevant, irrelevant or ambiguous for the labelled articles."""
    return table(spark, sf_dir, "labels").select(
        padded(F.col("doc_id")).alias("id"),
        F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "relevant")
        .otherwise("irrelevant").alias("label"),
    )


LABELS_SQL = """
labels_v AS (
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS id,
    CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS label
  FROM labels
)"""


_DICTIONARIES: dict[tuple[str, str], DataFrame] = {}


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface table of a data folder, derived once per session and kept on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DICTIONARIES:
        _DICTIONARIES[key] = cut(_derive_dictionary(spark, sf_dir))
    return _DICTIONARIES[key]


def _derive_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface table derived from the articles' own words.

    Long words and word pairs that two to four articles use become entities; the word
    length decides role and weight, and every seventh length needs a context word.
    """
    from newsflow.functions.text import haystack
    from newsflow.operators.entities import add_block_key

    hay = raw_articles(spark, sf_dir).select(haystack().alias("hay"))
    words = F.filter(F.regexp_extract_all("hay", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 9)
    pairs = F.regexp_extract_all("hay", F.lit("[a-z0-9]{5,} [a-z0-9]{5,}"), F.lit(0))
    tokens = hay.select(F.explode(F.array_distinct(F.concat(words, pairs))).alias("canonical"))
    n = F.length("canonical")
    kept = tokens.groupBy("canonical").agg(F.count("*").alias("df")).where("df BETWEEN 2 AND 4")
    contextual = n % 7 == 0
    none = F.array().cast("array<string>")
    words_near = F.array(F.lit("the"), F.lit("of"), F.lit("and"), F.lit("la"))
    return add_block_key(
        kept.select(
            "canonical",
            F.when(n % 5 == 0, "supporting").otherwise("qualifying").alias("role"),
            F.round(F.lit(0.5) + (n % 6) / 10, 1).alias("weight"),
            F.col("canonical").alias("surface"),
            F.lit(0).alias("surface_pos"),
            F.when(contextual, "contextual").otherwise("strong").alias("match_type"),
            F.when(contextual, words_near).otherwise(none).alias("before"),
            F.when(contextual, words_near).otherwise(none).alias("after"),
            F.lit(12).alias("max_gap"),
        )
    )


DICTIONARY_SQL = """
hay AS (
  SELECT id, lower(coalesce(title, '') || chr(10) || substr(coalesce(content, ''), 1, 500)) AS hay FROM ra
),
hay_words AS (
  SELECT DISTINCT id, unnest(list_concat(
    list_filter(regexp_extract_all(hay, '[a-z0-9]+'), lambda x: length(x) >= 9),
    regexp_extract_all(hay, '[a-z0-9]{5,} [a-z0-9]{5,}'))) AS canonical FROM hay
),
dict AS (
  SELECT canonical, CASE WHEN length(canonical) % 5 = 0 THEN 'supporting' ELSE 'qualifying' END AS role,
    round(0.5 + (length(canonical) % 6) / 10.0, 1) AS weight, canonical AS surface,
    CASE WHEN length(canonical) % 7 = 0 THEN 'contextual' ELSE 'strong' END AS match_type
  FROM hay_words GROUP BY canonical HAVING count(*) BETWEEN 2 AND 4
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline events: each event is a step on the article of its user."""
    e = F.col("event_id")
    pipeline = F.element_at(
        F.array(F.lit("collect"), F.lit("suggest"), F.lit("correspondent")),
        (F.floor(e / 500) % 3 + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("run-"), padded(F.floor(e / 500).cast("long"))).alias("run_id"),
        pipeline.alias("pipeline"),
        F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("code_"), (e % 4).cast("string"))).alias("reason"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        F.concat(
            F.lit("https://src"), (F.col("user_id") % 20).cast("string"),
            F.lit(".example.com/news/"), F.col("user_id").cast("string"),
            F.when(F.col("user_id") % 5 == 0, "?utm_source=feed").otherwise(""),
        ).alias("item_url"),
        F.col("props").alias("detail"),
        e.alias("event_id"),
        F.col("value").alias("value"),
    )


EVENT_LOG_SQL = """
event_log AS (
  SELECT ts, 'run-' || lpad((event_id // 500)::VARCHAR, 12, '0') AS run_id,
    ['collect', 'suggest', 'correspondent'][(event_id // 500) % 3 + 1] AS pipeline,
    event_type AS stage, CASE WHEN event_type = 'error' THEN 'code_' || (event_id % 4) END AS reason,
    'src' || (user_id % 20) AS source,
    'https://src' || (user_id % 20) || '.example.com/news/' || user_id
      || CASE WHEN user_id % 5 = 0 THEN '?utm_source=feed' ELSE '' END AS item_url,
    props AS detail, event_id, value
  FROM events
)"""


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views: one per event, every tenth on the front page."""
    u = F.col("user_id")
    path = F.when(F.col("event_id") % 10 == 0, "/").otherwise(
        F.concat(F.lit("/articles/src"), (u % 20).cast("string"), F.lit("-"), u.cast("string"),
                 F.when(F.col("event_id") % 2 == 0, "/").otherwise(""))
    )
    return table(spark, sf_dir, "events").select(path.alias("path"), F.col("ts").cast("timestamp").alias("ts"))


PAGE_VIEWS_SQL = """
page_views AS (
  SELECT CASE WHEN event_id % 10 = 0 THEN '/' ELSE '/articles/src' || (user_id % 20) || '-' || user_id
      || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END END AS path, ts
  FROM events
)"""


def model_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-article proposal per raw article, as a model would return them.

    Keywords are the longer title words and the quoted title; a run is a hundred articles.
    """
    words = F.filter(F.split("title", "[^A-Za-z0-9]+"), lambda w: F.length(w) >= 5)
    return raw_articles(spark, sf_dir).select(
        F.concat(F.lit("r"), padded(F.floor(F.col("doc_id") / 100).cast("long"))).alias("run_id"),
        F.concat(F.lit("p"), "id").alias("group_id"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Story '"), F.substring("title", 1, 40), F.lit("'")).alias("topic"),
        F.slice(words, 1, 6).alias("keywords"),
        F.array("id").alias("article_ids"),
        F.lit("same story").alias("reason"),
        F.slice(words, 1, 2).alias("common_entities"),
        F.lit(None).cast("double").alias("cohesion_score"),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as text: JSON with the proposals of one run and source.

    Every third answer has words around the JSON, every seventeenth is cut short.
    """
    ra = raw_articles(spark, sf_dir)
    batch = F.floor(F.col("doc_id") / 20).cast("long")
    one = F.struct(
        F.col("title").alias("topic"),
        F.slice(F.filter(F.split("title", "[^A-Za-z0-9]+"), lambda w: F.length(w) >= 5), 1, 6).alias("keywords"),
        F.array("id").alias("articleIds"),
        F.lit("r").alias("reason"),
        F.array(F.lit("X")).alias("commonEntities"),
    )
    rows = ra.groupBy(batch.alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("p")))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: x["p"]).alias("suggestions")))
    text = F.when(F.col("b") % 17 == 16, F.substring(body, 1, 80)).when(
        F.col("b") % 3 == 0, F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))
    ).otherwise(body)
    return rows.select(padded(F.col("b")).alias("output_id"), text.alias("response"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("string"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per document with meta tags, linked data, images and times around its text."""
    d = F.col("doc_id")
    n = d.cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (d % 45).cast("int")).cast("string")
    title = F.regexp_replace(F.substring_index("text", "\n", 1), "[<>&\"]", " ")
    html = F.concat(
        F.lit("<html><head>"),
        F.when(d % 3 == 0, F.concat(F.lit('<meta property="og:title" content="Cover '), title, F.lit('">'))).otherwise(""),
        F.when(d % 4 == 0, F.concat(F.lit('<meta property="og:image" content="/media/'), n, F.lit('.jpg">'))).otherwise(""),
        F.when(d % 6 == 1, F.concat(F.lit('<meta name="date" content="'), day, F.lit('T08:00:00Z">'))).otherwise(""),
        F.when(
            d % 5 == 0,
            F.concat(
                F.lit('<script type="application/ld+json">{"@type":"Event","url":"https://x.example.com/e","startDate":"'), day,
                F.lit('T20:00","image":"https://ld.example.com/'), n, F.lit('.jpg","datePublished":"'), day, F.lit(' 09:00:00"}</script>'),
            ),
        ).otherwise(""),
        F.lit("</head><body><h1>"), title, F.lit('</h1><time class="published" datetime="'), day, F.lit('T10:00:00+09:00"></time>'),
        F.lit('<img src="/logo.png"><img src="/a-300x250.jpg"><img srcset="/b.jpg 640w, /c.jpg 1280w" src="/b.jpg"><img src="/t.jpg" width="50" height="50">'),
        F.when(d % 7 == 0, F.lit('<iframe src="https://www.youtube.com/embed/abc123"></iframe>')).otherwise(""),
        F.lit("<article><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p><p>Show on "), day, F.lit("</p></article></body></html>"),
    )
    return table(spark, sf_dir, "documents").select(
        padded(d).alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/event/"),
                 F.when(d % 2 == 0, F.concat(F.replace(day, F.lit("-"), F.lit("/")), F.lit("/"))).otherwise(""), n).alias("url"),
        html.alias("html"),
    )


def harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page per cluster with one headed block per member article."""
    ra = raw_articles(spark, sf_dir)
    block = F.concat(F.lit("## "), "title", F.lit("\nDJ set from 22:00, tickets at the door, Hall "), "source_name", F.lit("\n"), "content")
    return ra.groupBy(cluster_of(F.col("doc_id")).alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("id", block.alias("b")))).alias("l"), F.min("source_name").alias("source"), F.min("url").alias("page_url"),
    ).select("page_id", "source", "page_url", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("markdown"))


def harvest_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers about the listing pages, some inside thinking blocks or fences, some broken."""
    ra = raw_articles(spark, sf_dir)
    d = F.col("doc_id")
    item = F.struct(
        F.when(d % 13 == 12, "").otherwise(F.col("title")).alias("headline_en"), F.lit("A summary").alias("summary_en"),
        F.array("source_name").alias("entities_en"),
        F.when(d % 3 == 0, "club_event").otherwise("release").alias("news_type"),
        F.col("event_date").cast("string").alias("event_date"), F.lit("preview").alias("doc_type"),
        F.struct(F.when(d % 3 == 0, F.concat(F.lit("Hall "), "source_name")).otherwise("TBA").alias("venue"),
                 F.when(d % 2 == 0, "/tickets").alias("ticket_url")).alias("facts"),
        F.array("image_url").alias("image_urls"), F.lit("en").alias("source_lang"), F.lit(0.8).alias("confidence"),
        F.struct(
            F.array(F.lit("DJ set from 22:00")).alias("dance_centrality"), F.array(F.lit("from 22:00")).alias("program_independence"),
            F.when(d % 2 == 0, F.array(F.lit("tickets at the door"))).otherwise(F.array(F.lit("no such quote here"))).alias("public_access"),
            F.when(d % 11 == 0, F.array(F.lit("Hall src"))).otherwise(F.array().cast("array<string>")).alias("private_or_restricted"),
        ).alias("experience_evidence"),
    )
    rows = ra.groupBy(cluster_of(d).alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("id", item.alias("i")))).alias("l"), F.min("url").alias("base_url"), F.min("doc_id").alias("n")
    )
    body = F.to_json(F.transform("l", lambda x: x["i"]))
    text = F.when(F.col("n") % 17 == 0, F.substring(body, 1, 60)).when(
        F.col("n") % 3 == 0, F.concat(F.lit("<think>[not this]</think>```json\n"), body, F.lit("\n```"))
    ).otherwise(body)
    return rows.select("page_id", "base_url", text.alias("response"))
