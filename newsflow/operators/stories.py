"""Story grouping: pair graph, group scores, proposal checks, merging, ranking.

A *group* is a row (group_id, topic, keywords, article_ids, common_entities,
cohesion_score, ...).  ``with_members`` joins its articles once; everything that needs
the articles' texts, dates or sources then works on the row itself, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.joins import salted_join, top_per_key, top_rows
from newsflow.functions.lineage import store
from newsflow.functions.text import (
    SP, is_category, is_low_signal, is_source_or_series, is_specific_entity, is_url_text,
    normalize_entity, normalize_text, or_empty, rx, snippet, strip, topic_key,
)
from newsflow.operators.components import components
from newsflow.operators.entities import contains_join, has_topic_evidence

# --- fixed values: scores, caps and word lists of the grouping rules ---
ENTITY_CAP = 15
COMPONENT_CAP = 5
TOP_GROUPS = 30
MIN_PAIR_SCORE = 3
MIN_COHESION = 20
MAX_MERGED_ARTICLES = 10
MAX_KEYWORDS = 6
MAX_ENTITIES = 5
PAIR_BLOCK = 500  # articles of an entity that are paired in one place
RECENT_SECONDS = 7 * 86400
FRESH_SECONDS = 48 * 3600
TITLE_SKIP = [
    "feat", "ft", "remix", "ep", "album", "single", "track",
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with",
]
GENERIC_TERMS = [
    "announce", "announced", "announcement", "artist", "artists", "event", "festival",
    "lineup", "music",
    "new", "official", "release", "released", "releases", "single", "album", "ep",
    "track", "tour", "show", "performance", "video", "interview", "premiere",
    "set", "sets", "stage", "stages",
    "공개", "발표", "발매", "릴리즈", "신곡", "싱글", "앨범", "행사", "페스티벌",
    "라인업", "공연", "영상", "인터뷰", "공식", "관련", "소식", "투어",
]
DEATH = r"\b(?:deaths?|died|fatalities|todesfällen|todesfaellen)\b|사망"
CUT_SHORT = (
    r"\b(?:ends?\s+early|ended\s+early|early\s+termination|abruptly\s+cancelled|vorzeitig\s+beendet)\b"
    r"|조기\s*종료"
)
QUOTES = "‘’“”\"'`"
# --- end of fixed values ---

def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


# --- pair graph -----------------------------------------------------------------------


def cap_entity_articles(index: DataFrame, ra: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """(canonical, id): the newest ``cap`` articles of each qualifying entity with two or more."""
    rows = index.where("role = 'qualifying'").select("id", "canonical")
    rows = rows.join(ra.select("id", "published_at"), "id")
    order = [F.col("published_at").desc_nulls_last(), F.col("id").asc()]
    top = top_per_key(rows, ["canonical"], order, cap, "entity_rank")
    n = F.count("*").over(Window.partitionBy("canonical"))
    return top.withColumn("_n", n).where("_n >= 2").select("canonical", "id", "entity_rank")


def entity_members(index: DataFrame) -> DataFrame:
    """(canonical, id): every article of each qualifying entity."""
    return index.where("role = 'qualifying'").select("canonical", "id")


def title_words(title: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(or_empty(title)), f"[^a-z0-9{SP}]", " "), f"[{SP}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_SKIP)))


def pair_edges(members: DataFrame, index: DataFrame, ra: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, score) for pairs of ``members`` (canonical, id) that share an entity and score three or more.

    A pair that shares several entities is built only under the first of them, so no
    de-duplication shuffle follows the join.  The articles of a large entity are dealt into blocks of about ``block``;
    every two blocks meet under a key of their own, so all pairs are built and no task holds more than two blocks of a key.
    """
    ents = index.where("role = 'qualifying'").groupBy("id").agg(F.collect_set("canonical").alias("ents"))
    caps = members.groupBy("id").agg(F.collect_set("canonical").alias("caps"))
    large = members.groupBy("canonical").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    nodes = (
        caps.join(ents, "id")
        .join(ra.select("id", "published_at", "event_date", title_words(F.col("title")).alias("words")), "id")
        .withColumn("canonical", F.explode("caps"))
    )
    facts = [c for c in nodes.columns if c != "canonical"]
    parts = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    dealt = nodes.join(large, "canonical", "left").select(
        "canonical", *facts, F.pmod(F.xxhash64("id"), parts).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"),
    )
    left = dealt.select("canonical", F.col("_own").alias("_l"), F.col("_other").alias("_r"), *[F.col(c).alias(f"l_{c}") for c in facts])
    right = dealt.select("canonical", F.col("_other").alias("_l"), F.col("_own").alias("_r"), *[F.col(c).alias(f"r_{c}") for c in facts])
    pairs = left.join(right, ["canonical", "_l", "_r"]).where("l_id < r_id").where(
        F.array_min(F.array_intersect("l_caps", "r_caps")) == F.col("canonical")
    )
    pairs = pairs.where("l_event_date IS NULL OR r_event_date IS NULL OR l_event_date = r_event_date")
    shared = F.size(F.array_intersect("l_ents", "r_ents"))
    gap = F.abs(F.unix_micros("l_published_at") - F.unix_micros("r_published_at"))
    day = 86400 * 1_000_000
    score = (
        F.when(shared >= 2, 3).when(shared == 1, 1).otherwise(0)
        + F.when(gap <= 3 * day, 3).when(gap <= 7 * day, 1).otherwise(0)
        + F.when(F.arrays_overlap("l_words", "r_words"), 2).otherwise(0)
    )
    return (
        pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), score.alias("score"))
        .where(F.col("score") >= MIN_PAIR_SCORE)
    )


def trim_components(comp: DataFrame, edges: DataFrame, cap: int = COMPONENT_CAP) -> DataFrame:
    """The ``cap`` nodes of each component with the highest weighted degree (ties: id)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "score")
    degree = ends.groupBy("id").agg(F.sum("score").alias("degree"))
    order = [F.col("degree").desc(), F.col("id").asc()]
    return top_per_key(comp.join(degree, "id"), ["component"], order, cap, "node_rank").select(
        "component", "id", "degree"
    )


def label_components(
    trimmed: DataFrame, index: DataFrame, surfaces: DataFrame, n: int = TOP_GROUPS
) -> DataFrame:
    """Top ``n`` groups by size times entity weight: (component, entity, article_ids, weight_sum).

    The label is the entity most members share, the smallest name on a tie.
    """
    weights = surfaces.groupBy("canonical").agg(F.max("weight").alias("weight"))
    named = trimmed.join(index.where("role = 'qualifying'").select("id", "canonical"), "id")
    counts = named.groupBy("component", "canonical").agg(F.count("*").alias("n"))
    label = counts.groupBy("component").agg(
        F.min_by("canonical", F.struct(-F.col("n"), F.col("canonical"))).alias("entity")
    )
    groups = trimmed.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("article_ids"))
    out = (
        groups.join(label, "component")
        .join(weights.withColumnRenamed("canonical", "entity"), "entity", "left")
        .withColumn("weight_sum", F.size("article_ids") * F.coalesce("weight", F.lit(1.0)))
    )
    order = [F.col("weight_sum").desc(), F.col("component").asc()]
    return top_rows(out, order, n, "pos").select("pos", "component", "entity", "article_ids", "weight_sum")


# --- groups and their members ---------------------------------------------------------


def story_term(col: Column) -> Column:
    """Normal form of a keyword or text for story comparison."""
    out = F.regexp_replace(F.lower(col), rx(DEATH), " fatality ")
    out = F.regexp_replace(out, rx(CUT_SHORT), " early termination ")
    out = F.regexp_replace(out, f"[{QUOTES}]", " ")
    out = F.regexp_replace(out, "[^a-z0-9가-힣]+", " ")
    out = F.regexp_replace(out, rx(r"\b(?:19|20)\d{2}\b"), " ")
    tokens = F.filter(F.split(out, " +"), lambda t: (F.length(t) > 1) & ~t.isin(GENERIC_TERMS))
    return F.array_join(tokens, " ")


def article_features(ra: DataFrame, index: DataFrame) -> DataFrame:
    """What the group rules need of an article: (id, m) with one struct per article."""
    ents = index.where("role = 'qualifying'").groupBy("id").agg(
        F.array_sort(F.collect_set("canonical")).alias("ents")
    )
    raw = F.concat(or_empty(F.col("title")), F.lit(" "), snippet(F.col("content")))
    source = F.col("source_name") if "source_name" in ra.columns else F.lit(None).cast("string")
    # the cleaned text is made in its own step, so that it is made once
    staged = ra.join(ents, "id", "left").select(
        "id", "source_id", "published_at", "event_date", "ents", raw.alias("_raw"), source.alias("_source"),
        has_topic_evidence(F.col("title"), F.col("content")).alias("_evidence"),
    )
    return staged.select(
        "id",
        F.struct(
            F.col("id"),
            normalize_text(F.col("_raw")).alias("text"),
            story_term(F.col("_raw")).alias("story"),
            story_term(or_empty(F.col("_source"))).alias("source"),
            F.col("source_id").cast("string").alias("source_id"),
            "published_at",
            "event_date",
            F.coalesce("ents", F.array().cast("array<string>")).alias("ents"),
            F.col("_evidence").alias("evidence"),
        ).alias("m"),
    )


def with_members(groups: DataFrame, features: DataFrame) -> DataFrame:
    """``groups`` with ``members``: the known articles of ``article_ids`` in order.

    An article that many groups name is spread by group, so its join does not pile up.
    """
    ids = groups.select("group_id", F.posexplode("article_ids").alias("_i", "id"))
    needed = features.join(ids.select("id").distinct(), "id", "left_semi")
    rows = salted_join(ids, needed, ["id"], ["group_id"], salts=4)
    lists = rows.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i"), F.col("m")))).alias("_l")
    )
    return groups.join(lists, "group_id", "left").withColumn(
        "members", F.coalesce(F.transform("_l", lambda x: x["m"]), F.expr("array()"))
    ).drop("_l")


def known_dates(members: Column) -> Column:
    dates = F.transform(members, lambda m: m["event_date"])
    return F.array_distinct(F.filter(dates, lambda d: d.isNotNull()))


def date_conflict(groups: DataFrame, ra: DataFrame) -> DataFrame:
    """(group_id, n_dates, conflict): more than one known event date among the members."""
    ids = groups.select("group_id", F.explode_outer("article_ids").alias("id"))
    dates = ra.where("event_date IS NOT NULL").select("id", "event_date")
    return (
        ids.join(dates, "id", "left").groupBy("group_id")
        .agg(F.count_distinct("event_date").alias("n_dates"))
        .withColumn("conflict", F.col("n_dates") > 1)
    )


def cohesion_of(n_ids: Column, entities: Column, texts: Column) -> Column:
    """Cohesion 0 to 100: mean share of members that contain each entity, plus a size bonus."""
    names = F.transform(entities, normalize_text)
    hits = F.reduce(
        names, F.lit(0),
        lambda acc, e: acc + F.size(F.filter(texts, lambda t: F.contains(t, e))),
    )
    share = hits / (n_ids * F.size(entities))
    penalty = F.when(F.forall(entities, is_category), 45).otherwise(0)
    score = round_half_up(share * 80 + F.least(n_ids, F.lit(5)) * 4 - penalty)
    return F.when((n_ids < 2) | (F.size(entities) == 0), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), score))
    ).cast("int")


def cohesion(groups: DataFrame) -> DataFrame:
    """``groups`` (with members) with their computed ``cohesion``."""
    texts = F.transform("members", lambda m: m["text"])
    return groups.withColumn(
        "cohesion", cohesion_of(F.size("article_ids"), F.col("common_entities"), texts)
    )


# --- proposals ------------------------------------------------------------------------

PROPOSAL_SCHEMA = (
    "struct<suggestions:array<struct<topic:string,keywords:array<string>,articleIds:array<string>,"
    "reason:string,commonEntities:array<string>,cohesionScore:double>>>"
)


def parse_proposals(outputs: DataFrame, text: str = "response", key: str = "output_id") -> DataFrame:
    """Proposals in model answers: one row per proposal, or one row saying why there is none.

    The whole answer is read as JSON, else its outermost braces.  ``parse``: whole,
    braces or failed; ``is_singleton`` marks proposals with exactly one article.
    """
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parse = (
        F.when(F.try_parse_json(F.col(text)).isNotNull(), "whole")
        .when((inner != "") & F.try_parse_json(inner).isNotNull(), "braces")
        .otherwise("failed")
    )
    rows = outputs.withColumn("parse", parse).withColumn(
        "_p",
        F.when(F.col("parse") == "whole", F.from_json(text, PROPOSAL_SCHEMA)).when(
            F.col("parse") == "braces", F.from_json(inner, PROPOSAL_SCHEMA)
        ),
    )
    return rows.select(
        key, "parse", F.posexplode_outer("_p.suggestions").alias("proposal_no", "s")
    ).select(
        key, "parse", "proposal_no",
        F.col("s.topic").alias("topic"),
        F.col("s.keywords").alias("keywords"),
        F.col("s.articleIds").alias("article_ids"),
        F.col("s.reason").alias("reason"),
        F.col("s.commonEntities").alias("common_entities"),
        F.col("s.cohesionScore").alias("cohesion_score"),
        F.coalesce(F.size("s.articleIds") == 1, F.lit(False)).alias("is_singleton"),
    )


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def clean_keywords(col: Column) -> Column:
    """Story keywords: no category, URL, source or low-signal text; six at most, once each."""
    ok = F.filter(
        F.transform(col, lambda k: strip(or_empty(k))),
        lambda k: (k != "") & ~is_category(k) & ~is_url_text(k) & ~is_source_or_series(k) & ~is_low_signal(k),
    )
    return F.array_distinct(F.slice(ok, 1, MAX_KEYWORDS))


def clean_entities(col: Column) -> Column:
    """Specific entity names, five at most, once each."""
    ok = F.filter(F.transform(col, lambda e: normalize_entity(or_empty(e))), is_specific_entity)
    return F.array_distinct(F.slice(ok, 1, MAX_ENTITIES))


def clean_terms(df: DataFrame) -> DataFrame:
    """``keywords`` and ``common_entities`` after hygiene."""
    return df.withColumn("keywords", clean_keywords(_strings("keywords"))).withColumn(
        "common_entities", clean_entities(_strings("common_entities"))
    )


def normalize_proposals(props: DataFrame, features: DataFrame) -> DataFrame:
    """Checked proposals with ``drop_reason`` (null when kept).

    Entities become those that every member has; an unknown article, a date conflict, a
    weak or ungrounded group drops the proposal.  Input: group_id, topic, keywords,
    article_ids, reason, common_entities, cohesion_score.
    """
    ids = F.array_distinct(
        F.filter(F.transform(_strings("article_ids"), lambda i: strip(or_empty(i))), lambda i: i != "")
    )
    g = clean_terms(props).withColumn("article_ids", ids).withColumn("topic", strip(or_empty(F.col("topic"))))
    g = with_members(g, features)
    n = F.size("article_ids")
    lowered = F.transform("members", lambda m: F.transform(m["ents"], lambda e: F.lower(e)))
    shared = F.filter(
        F.when(F.size("members") > 0, F.col("members")[0]["ents"]).otherwise(
            F.array().cast("array<string>")
        ),
        lambda e: F.forall(lowered, lambda names: F.array_contains(names, F.lower(e))),
    )
    g = g.withColumnRenamed("common_entities", "_raw").withColumn(
        "common_entities", F.slice(shared, 1, MAX_ENTITIES)
    )
    texts = F.transform("members", lambda m: m["text"])
    computed = cohesion_of(
        n,
        F.when(F.size("common_entities") > 0, F.col("common_entities")).otherwise(F.col("keywords")),
        texts,
    )
    g = g.withColumn(
        "cohesion_score",
        F.when(F.col("cohesion_score").isNotNull(), round_half_up(F.col("cohesion_score")).cast("int"))
        .when(n == 1, 0).otherwise(computed),
    )
    g = g.withColumn("_only", F.when((n == 1) & (F.size("members") == 1), F.col("members")[0]))
    evidence_names = F.concat("keywords", "_raw")

    def grounded(v: Column) -> Column:
        norm = normalize_text(v)
        tokens = F.filter(F.split(norm, " "), lambda t: F.length(t) >= 3)
        text = F.col("_only.text")
        return (norm != "") & ~is_category(norm) & (
            F.contains(text, norm)
            | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(text, t)))
        )

    has_entity = F.size("_only.ents") > 0
    is_grounded = F.exists(evidence_names, grounded) | (
        has_entity & (F.size(evidence_names) > 0)
        & F.forall(evidence_names, lambda v: ~v.rlike("(?i)[a-z]"))
    )
    eligible = (n > 1) | (
        F.col("_only").isNotNull() & is_grounded & (has_entity | F.col("_only.evidence"))
    )
    t = F.col("topic")
    reason = (
        F.when(F.size("members") < n, "article_not_edm_eligible")
        .when(F.size(known_dates(F.col("members"))) > 1, "event_date_conflict")
        .when(
            (t == "") | is_url_text(t) | is_source_or_series(t) | is_low_signal(t) | (n < 1)
            | ((n > 1) & (F.col("cohesion_score") < MIN_COHESION))
            | ~F.coalesce(eligible, F.lit(False))
            | ((F.size("keywords") == 0) & (F.size("common_entities") == 0)),
            "normalization_failed",
        )
    )
    return g.withColumn("drop_reason", reason).drop("_raw", "_only")


# --- story terms and merging ----------------------------------------------------------


def quoted_parts(topic: Column) -> Column:
    return F.regexp_extract_all(topic, F.lit(f"[{QUOTES}]([^{QUOTES}]+)[{QUOTES}]"), F.lit(1))


def all_terms(keywords: Column, topic: Column) -> Column:
    """Normal forms of keywords and quoted topic parts, before entity names are removed."""
    norm = F.transform(F.concat(keywords, quoted_parts(topic)), story_term)
    return F.array_distinct(
        F.filter(norm, lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_TERMS))
    )


def grounded_terms(keywords: Column, topic: Column, entities: Column, members: Column, n_ids: Column) -> Column:
    """Story terms that every member text supports and no member's source name contains."""
    names = F.transform(entities, lambda e: F.lower(strip(e)))
    phrases = F.filter(all_terms(keywords, topic), lambda t: ~F.array_contains(names, t))
    tokens = F.flatten(
        F.transform(phrases, lambda p: F.filter(F.split(p, " "), lambda t: (F.length(t) >= 5) & ~t.isin(GENERIC_TERMS)))
    )
    terms = F.array_distinct(F.concat(phrases, tokens))

    def supported(t: Column) -> Column:
        words = F.split(t, " ")
        return F.forall(
            members,
            lambda m: ~((m["source"] != "") & F.contains(m["source"], t))
            & (
                F.contains(m["story"], t)
                | F.forall(words, lambda w: F.contains(m["story"], w))
            ),
        )

    kept = F.filter(terms, lambda t: ~is_source_or_series(t) & supported(t))
    return F.when(F.size(members) == n_ids, kept).otherwise(F.array().cast("array<string>"))


def story_terms(groups: DataFrame) -> DataFrame:
    """``groups`` (with members) with their grounded ``terms``."""
    return groups.withColumn(
        "terms",
        grounded_terms(
            F.col("keywords"), F.col("topic"), F.col("common_entities"), F.col("members"), F.size("article_ids")
        ),
    )


def _related(a: Column, b: Column) -> Column:
    return (a == b) | (
        (F.least(F.length(a), F.length(b)) >= 5) & (F.contains(a, b) | F.contains(b, a))
    )


def story_overlap(left: Column, right: Column) -> Column:
    """2 for a shared phrase, 1 for a shared or contained term, else 0."""
    same = F.array_intersect(left, right)
    return (
        F.when(F.exists(same, lambda t: F.contains(t, F.lit(" "))), 2)
        .when(F.exists(left, lambda a: F.exists(right, lambda b: _related(a, b))), 1)
        .otherwise(0)
    )


def _entity_keys(col: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(col, lambda e: F.lower(strip(e))), lambda e: e != ""))


def _blocked(groups: DataFrame) -> DataFrame:
    """Groups with the columns that pair scores need."""
    return story_terms(groups).select(
        "*",
        _entity_keys(F.col("common_entities")).alias("_ek"),
        known_dates(F.col("members")).alias("_dates"),
        F.array_max(F.transform("members", lambda m: m["published_at"])).alias("_latest"),
    )


def _pair_keys(groups: DataFrame, probe: bool) -> DataFrame:
    """(group_id, _key): join keys of mergeable pairs as hashes with the run, one row each; the score settles who shares one.

    Pairs merge on an entity and a term in common, or on a phrase.  Terms in common are
    equal or one contains the other with five or more characters, in which case the
    longer has the shorter's first five characters: the probe side gives only those,
    the index side all runs of five.
    """
    grams = F.flatten(
        F.transform(
            "terms",
            lambda t: F.when(F.length(t) < 5, F.array(t)).otherwise(
                F.array(F.substring(t, 1, 5)) if probe else F.transform(
                    F.sequence(F.lit(1), F.length(t) - 4), lambda i: F.substring(t, i, F.lit(5))
                )
            ),
        )
    )
    pairs = F.flatten(
        F.transform("_ek", lambda e: F.transform(F.array_distinct(grams), lambda g: F.concat(F.lit("e\u0001"), e, F.lit("\u0001"), g)))
    )
    phrases = F.transform(
        F.filter("terms", lambda t: F.contains(t, F.lit(" "))), lambda t: F.concat(F.lit("p\u0001"), t)
    )
    hashes = F.transform(F.concat(pairs, phrases), lambda k: F.xxhash64(F.col("run_id"), k))
    return groups.select("group_id", F.explode(F.array_distinct(hashes)).alias("_key"))


_PAIR_COLS = ["run_id", "group_id", "pos", "terms", "_ek", "_dates", "_latest"]


def merge_pairs(groups: DataFrame) -> DataFrame:
    """(run_id, left_id, right_id, score) of the mergeable pairs; left comes first in order.

    ``groups`` need run_id, pos and members; only groups of one run are compared.
    """
    b = store(_blocked(groups))
    return _score_pairs(_meet(b, b), b, b)


def _meet(probe: DataFrame, index: DataFrame) -> DataFrame:
    """(x_group_id, y_group_id) of the groups that share a key; only hashes and ids travel.

    The hint keeps the join from a broadcast, as Spark cannot know how many keys a group has; AQE splits a hot key.
    """
    left = _pair_keys(probe, True).withColumnRenamed("group_id", "x_group_id")
    right = _pair_keys(index, False).withColumnRenamed("group_id", "y_group_id")
    met = left.join(right.hint("merge"), "_key").where("x_group_id <> y_group_id")
    return met.select("x_group_id", "y_group_id").distinct()


def _score_pairs(ids: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Scores of the pairs ``ids`` of groups ``xs`` and ``ys`` that are mergeable."""
    side = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in _PAIR_COLS])
    joined = ids.join(side(xs, "x"), "x_group_id").join(side(ys, "y"), "y_group_id").where("x_run_id = y_run_id")
    ents = F.size(F.array_intersect("x__ek", "y__ek"))
    story = story_overlap(F.col("x_terms"), F.col("y_terms"))
    near = F.abs(F.unix_micros("x__latest") - F.unix_micros("y__latest")) <= RECENT_SECONDS * 1_000_000
    first = F.struct("x_pos", "x_group_id") < F.struct("y_pos", "y_group_id")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return (
        joined.where(F.size(F.array_distinct(F.concat("x__dates", "y__dates"))) <= 1)
        .withColumn("_e", ents).withColumn("_s", story)
        .where(
            ((F.col("_e") >= 1) & (F.col("_s") >= 1))
            | ((F.col("_e") == 0) & (F.col("_s") >= 2) & F.coalesce(near, F.lit(False)))
        )
        .select(
            F.col("x_run_id").alias("run_id"),
            pick("x_group_id", "y_group_id").alias("left_id"), pick("y_group_id", "x_group_id").alias("right_id"),
            pick("x_pos", "y_pos").alias("left_pos"), pick("y_pos", "x_pos").alias("right_pos"),
            (F.col("_e") * 2 + F.col("_s")).alias("score"),
        )
        .distinct()
    )


_GROUP_COLS = [
    "run_id", "group_id", "pos", "topic", "keywords", "article_ids", "reason", "common_entities",
    "cohesion_score", "members", "merged_from",
]


def _distinct_by_lower(values: Column) -> Column:
    v = F.filter(F.transform(values, strip), lambda x: x != "")
    low = F.transform(v, lambda x: F.lower(x))
    return F.filter(v, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def _merged(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One merged group per pair row (left_id, right_id, new_pos)."""
    l = groups.select(*[F.col(c).alias(f"l_{c}") for c in groups.columns])
    r = groups.select(*[F.col(c).alias(f"r_{c}") for c in groups.columns])
    p = pairs.join(l, F.col("left_id") == F.col("l_group_id")).join(r, F.col("right_id") == F.col("r_group_id"))
    larger = F.size("r_article_ids") > F.size("l_article_ids")
    ids = F.array_distinct(F.concat("l_article_ids", "r_article_ids"))
    own = F.struct(
        F.when(larger, F.col("r_topic")).otherwise(F.col("l_topic")).alias("topic"),
        F.when(larger, F.col("r_reason")).otherwise(F.col("l_reason")).alias("reason"),
    )
    # over the cap, the articles of the more cohesive side are kept; equal ones keep their order
    weight = F.transform(
        ids,
        lambda a, i: F.struct(
            (-F.greatest(
                F.when(F.array_contains("l_article_ids", a), F.col("l_cohesion_score")),
                F.when(F.array_contains("r_article_ids", a), F.col("r_cohesion_score")),
            )).alias("w"),
            i.alias("i"), a.alias("a"),
        ),
    )
    trimmed = F.transform(F.slice(F.array_sort(weight), 1, MAX_MERGED_ARTICLES), lambda x: x["a"])
    ids = F.when(F.size(ids) <= MAX_MERGED_ARTICLES, ids).otherwise(trimmed)
    right_keys = F.transform("r_common_entities", lambda e: F.lower(strip(e)))
    ents = F.slice(
        F.filter("l_common_entities", lambda e: F.array_contains(right_keys, F.lower(strip(e)))), 1, MAX_ENTITIES
    )
    anchors = F.exists("l_terms", lambda a: F.exists("r_terms", lambda b: _related(a, b)))
    p = p.select(
        "left_id", "right_id", F.col("l_run_id").alias("run_id"),
        F.concat_ws("+", "l_group_id", "r_group_id").alias("group_id"),
        F.col("new_pos").alias("pos"),
        own["topic"].alias("topic"), own["reason"].alias("reason"),
        F.slice(_distinct_by_lower(F.concat("l_keywords", "r_keywords")), 1, MAX_KEYWORDS).alias("keywords"),
        ids.alias("article_ids"), ents.alias("common_entities"),
        F.array_distinct(F.concat("l_members", "r_members")).alias("_all"),
        anchors.alias("_anchor"),
        F.concat("l_merged_from", "r_merged_from").alias("merged_from"),
    )
    p = p.withColumn(
        "members",
        F.filter(F.transform("article_ids", lambda a: F.filter("_all", lambda m: m["id"] == a)[0]), lambda m: m.isNotNull()),
    )
    texts = F.transform("members", lambda m: m["text"])
    by_entity = cohesion_of(F.size("article_ids"), F.col("common_entities"), texts)
    by_story = F.when(
        F.col("_anchor"), F.least(F.lit(100), 80 + F.least(F.size("article_ids"), F.lit(5)) * 4)
    ).otherwise(0)
    return p.withColumn("cohesion_score", F.greatest(by_entity, by_story).cast("int")).drop("_all", "_anchor")


def _scored(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs whose merged group is cohesive enough."""
    trial = _merged(pairs.withColumn("new_pos", F.lit(0)), terms).where(F.col("cohesion_score") >= MIN_COHESION)
    return pairs.join(trial.select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")


def _rivals(pairs: DataFrame) -> DataFrame:
    """The pairs that no other pair of one of their groups comes before: each is the best of both."""
    order = F.struct((-F.col("score")).alias("s"), "left_pos", "left_id", "right_pos", "right_id")
    best = pairs.select(F.explode(F.array("left_id", "right_id")).alias("g"), order.alias("o")).groupBy("g").agg(F.min("o").alias("o"))
    side = lambda n: best.select(F.col("g").alias(f"{n}_id"), F.col("o").alias(f"_{n}"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.where((F.col("_left") == order) & (F.col("_right") == order)).drop("_left", "_right")


def merge_groups(groups: DataFrame) -> DataFrame:
    """Merge until no pair of groups is mergeable; in every round all mutually best pairs merge at once.

    Pairs are ordered by score, then by the positions of their groups.  A pair that comes before every other pair
    of its two groups merges; these pairs share no group.  The position of a merged group lies behind all of earlier
    rounds, in the order of first parts.  Only new groups are compared again.  ``groups``: run_id, group_id, pos (order in the run, below
    2^44) and the columns of a group with members.  The result carries ``merged_from``, the ids of its parts.
    """
    empty = F.array().cast("array<string>")
    g = groups.select(
        "run_id", "group_id", F.col("pos").cast("long").alias("pos"), "topic",
        F.coalesce("keywords", empty).alias("keywords"), "article_ids", "reason",
        F.coalesce("common_entities", empty).alias("common_entities"),
        F.coalesce("cohesion_score", F.lit(0)).cast("int").alias("cohesion_score"), "members",
        F.array("group_id").alias("merged_from"),
    )
    active = store(_blocked(g).withColumn("first_pos", F.col("pos")))
    pairs = store(_scored(_score_pairs(_meet(active, active), active, active), active))
    done, step = [], 0
    while True:
        best = store(_rivals(pairs))
        if best.isEmpty():
            return reduce(DataFrame.unionByName, done, active.select(*_GROUP_COLS))
        step += 1
        firsts = active.select(F.col("group_id").alias("g"), "first_pos")
        new_pos = F.lit(step * (1 << 44)) + F.col("first_pos")
        best = (
            best.join(firsts.select(F.col("g").alias("left_id"), F.col("first_pos").alias("_l")), "left_id")
            .join(firsts.select(F.col("g").alias("right_id"), F.col("first_pos").alias("_r")), "right_id")
            .withColumn("first_pos", F.least("_l", "_r")).drop("_l", "_r").withColumn("new_pos", new_pos))
        new = _blocked(_merged(best, active).withColumn("first_pos", F.col("pos") - step * (1 << 44)).select(*_GROUP_COLS, "first_pos"))
        new = store(new)
        used = best.select(F.explode(F.array("left_id", "right_id")).alias("group_id"))
        rest = active.join(used, "group_id", "left_anti")
        # a run with pairs has a mutually best one, so a run without a new group is done
        open_runs = new.select("run_id").distinct()
        done.append(store(rest.join(open_runs, "run_id", "left_anti").select(*_GROUP_COLS)))
        active = store(rest.join(open_runs, "run_id", "left_semi").unionByName(new))
        back = _meet(active, new).select(F.col("y_group_id").alias("x_group_id"), F.col("x_group_id").alias("y_group_id"))
        fresh = _score_pairs(_meet(new, active).unionByName(back).distinct(), new, active)
        gone = used.select(F.col("group_id").alias("g"))
        kept = pairs.join(gone, pairs.left_id == gone.g, "left_anti").join(gone, F.col("right_id") == gone.g, "left_anti")
        pairs = store(kept.unionByName(_scored(fresh, active).select(*kept.columns)))


# --- ranking and known topics ---------------------------------------------------------


def rank_groups(groups: DataFrame, surfaces: DataFrame, as_of: Column, n: int = TOP_GROUPS) -> DataFrame:
    """Top ``n`` groups (with members) by score, with ``score`` and ``rank``."""
    weights = surfaces.where("role <> 'supporting'").groupBy(F.lower("canonical").alias("e")).agg(
        F.max("weight").alias("w")
    )
    ents = groups.select("group_id", F.explode(_strings("common_entities")).alias("e")).withColumn("e", F.lower("e"))
    best = salted_join(ents, weights, ["e"], ["group_id"], how="left").groupBy("group_id").agg(
        F.max(F.coalesce("w", F.lit(0.0))).alias("_w")
    )
    sources = F.size(F.array_distinct(F.filter(F.transform("members", lambda m: m["source_id"]), lambda s: s.isNotNull())))
    fresh = F.exists(
        "members",
        lambda m: F.coalesce((F.unix_micros(as_of) - F.unix_micros(m["published_at"])) <= FRESH_SECONDS * 1_000_000, F.lit(False)),
    )
    score = (
        F.coalesce("cohesion_score", F.lit(0)) + F.coalesce("_w", F.lit(0.0)) * 15
        + F.least(F.size("article_ids"), F.lit(4)) * 5 + sources * 10 + fresh.cast("int") * 5
    )
    scored = groups.join(best, "group_id", "left").withColumn("score", F.round(score, 6)).drop("_w")
    return top_rows(scored, [F.col("score").desc(), F.col("group_id").asc()], n, "rank")


def known_topics(proposals: DataFrame, articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Topic keys already taken by open or rejected proposals or by published clusters."""
    open_ = proposals.where("status IN ('pending', 'rejected') AND topic <> ''").select(topic_key(F.col("topic")).alias("key"))
    pub = articles.where("published AND cluster_id IS NOT NULL").select(F.col("cluster_id").alias("id")).distinct()
    done = clusters.where("topic <> ''").join(pub, "id", "left_semi").select(topic_key(F.col("topic")).alias("key"))
    return open_.unionByName(done).distinct()


def filter_known(
    groups: DataFrame, proposals: DataFrame, articles: DataFrame, clusters: DataFrame, rules: DataFrame,
    order: str = "rank",
) -> DataFrame:
    """``groups`` with ``drop_reason``: duplicate_topic, blocklist or null when kept.

    Among groups with one topic only the first that no rule blocks is kept.
    """
    key = topic_key(F.col("topic"))
    g = groups.withColumn("_key", key)
    known = known_topics(proposals, articles, clusters).withColumn("_known", F.lit(True))
    g = g.join(known.withColumnRenamed("key", "_key"), "_key", "left")
    searchable = F.lower(F.concat_ws("\n", "topic", F.array_join(_strings("keywords"), "\n"), F.array_join(_strings("common_entities"), "\n")))
    pats = rules.where("enabled").select(topic_key(F.col("pattern")).alias("pattern")).where("pattern <> ''").distinct()
    texts = groups.select("group_id", searchable.alias("text"))
    blocked = contains_join(texts, pats, ["group_id"]).select("group_id").distinct().withColumn("_blocked", F.lit(True))
    g = g.join(blocked, "group_id", "left")
    open_ = F.col("_known").isNull() & F.col("_blocked").isNull()
    first = g.where(open_).groupBy("_key").agg(F.min(F.struct(order, "group_id")).alias("_first"))
    return g.join(first, "_key", "left").withColumn(
        "drop_reason",
        F.when(F.col("_known"), "duplicate_topic").when(F.col("_blocked"), "blocklist")
        .when(F.col("_first.group_id") != F.col("group_id"), "duplicate_topic"),
    ).drop("_key", "_known", "_blocked", "_first")


def topic_provenance(proposals: DataFrame, articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, origins): where each taken topic comes from."""
    a = proposals.where("status IN ('pending', 'rejected', 'published') AND topic <> ''").select(
        topic_key(F.col("topic")).alias("key"), F.concat(F.lit("suggested_clusters:"), "status").alias("origin")
    )
    pub = articles.where("published AND cluster_id IS NOT NULL").select(F.col("cluster_id").alias("id")).distinct()
    b = clusters.where("topic <> ''").join(pub, "id", "left_semi").select(
        topic_key(F.col("topic")).alias("key"), F.lit("published_articles:article_clusters").alias("origin")
    )
    # at most four distinct origins exist, so the set per key is small
    return a.unionByName(b).groupBy("key").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def build_cluster(
    ra: DataFrame, cluster_id: str, topic: str, keywords: list[str] | None = None,
    ids: DataFrame | None = None, mode: str = "or", limit: int = 20,
) -> DataFrame:
    """Links of a new cluster: given ids, or the newest articles that match the keywords."""
    cols = [F.lit(cluster_id).alias("cluster_id"), F.lit(topic.strip()).alias("topic"),
            F.col("id").alias("raw_article_id"), "title", "url"]
    if ids is not None:
        return ra.join(ids.select("id").distinct(), "id", "left_semi").select(*cols)
    words = [" ".join(k.translate(str.maketrans("(),", "   ")).split()) for k in keywords or []]
    words = [w for w in words if w]
    if not topic.strip() or not words:
        raise ValueError("a topic and keywords or ids are needed")
    cond = None
    for w in words:
        one = F.col("title").ilike(f"%{w}%") | F.coalesce(F.col("content").ilike(f"%{w}%"), F.lit(False))
        cond = one if cond is None else (cond & one if mode == "and" else cond | one)
    order = [F.col("published_at").desc_nulls_first(), F.col("id").asc()]
    narrow = ra.where(cond).select("id", "title", "url", "published_at")
    return narrow.orderBy(*order).limit(limit).select(*cols)


def attach_source(ra: DataFrame, sources: DataFrame, default: str = "알 수 없는 소스") -> DataFrame:
    """``ra`` with ``feed_name``: null without a known feed, the default for a nameless one.

    The feed table is small and unique by id; Spark's own size check decides on a broadcast.
    """
    names = sources.select(F.col("id").cast("string").alias("source_id"), F.coalesce("name", F.lit(default)).alias("feed_name"))
    return ra.join(names, "source_id", "left")


def hydrate_proposals(proposals: DataFrame, ra: DataFrame) -> DataFrame:
    """Stored proposals with article references in order, entities and title cohesion."""
    ids = proposals.select(F.col("id").alias("group_id"), F.posexplode_outer("article_ids").alias("_i", "id"))
    refs = ra.select("id", "title", "url")
    rows = salted_join(ids, refs, ["id"], ["group_id"], salts=4).groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("_i", "id", "title", "url"))).alias("_l")
    )
    ents = F.filter(_strings("keywords"), lambda k: ~is_category(k))
    out = proposals.withColumnRenamed("id", "group_id").join(rows, "group_id", "left")
    out = out.withColumn(
        "articles",
        F.coalesce(F.transform("_l", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["url"].alias("url"))), F.expr("array()")),
    ).withColumn("_e", ents)
    texts = F.transform("articles", lambda a: normalize_text(F.concat(or_empty(a["title"]), F.lit(" "))))
    some = F.size("_e") > 0
    return out.select(
        "group_id", "topic", _strings("keywords").alias("keywords"), "article_ids", "status", "cluster_id", "created_at",
        F.when(some, F.col("_e")).alias("common_entities"), "articles",
        F.when(some, cohesion_of(F.size("article_ids"), F.col("_e"), texts)).alias("cohesion_score"),
    )


def drop_ledger(
    normalized: DataFrame, merged: DataFrame, ranked: DataFrame, filtered: DataFrame
) -> DataFrame:
    """One row per lost group: (group_id, stage, reason).

    ``normalized`` and ``filtered`` carry ``drop_reason``; a group that became part of
    another is merged away; a merged group below the rank cut hits the cap.
    """
    kept = normalized.where("drop_reason IS NULL").select("group_id")
    a = normalized.where("drop_reason IS NOT NULL").select("group_id", F.lit("normalize").alias("stage"), F.col("drop_reason").alias("reason"))
    b = kept.join(merged.select("group_id"), "group_id", "left_anti").select("group_id", F.lit("merge").alias("stage"), F.lit("merged_into_suggestion").alias("reason"))
    c = merged.select("group_id").join(ranked.select("group_id"), "group_id", "left_anti").select("group_id", F.lit("rank").alias("stage"), F.lit("rank_cap").alias("reason"))
    d = filtered.where("drop_reason IS NOT NULL").select("group_id", F.lit("filter").alias("stage"), F.col("drop_reason").alias("reason"))
    return a.unionByName(b).unionByName(c).unionByName(d)
