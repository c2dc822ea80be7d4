"""Lifecycle transitions: each takes snapshots and returns new ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.joins import top_per_key
from newsflow.functions.lineage import cut
from newsflow.functions.text import BOILERPLATE, any_match, clean_text, or_empty, regex_quote, strip
from newsflow.functions.urls import host_key, strip_url
from newsflow.operators.entities import block_key, key_postings
from newsflow.operators.serving import genre_key

# --- fixed values: slug, category and quality rules ---
SLUG_CHARS = 50
LAST_SUFFIX = 98
CATEGORIES = ["페스티벌", "릴리즈", "뉴스"]
DEFAULT_CATEGORY, RELEASE, DEFAULT_GENRE = "뉴스", "릴리즈", "edm"
GENRES = ["house", "techno", "edm"]
MIN_TITLE, MIN_BODY, MIN_SCRIPT_RATIO = 8, 120, 0.3
UNKNOWN_SOURCE, UNTITLED, UNKNOWN_HOST = "알 수 없는 소스", "제목 없음", "원문 매체"
MIN_SOURCE_CHARS, SOURCE_CHARS = 80, 3000  # the default of cluster_sources; None there takes whole texts
# --- end of fixed values ---


def _flag(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    marks = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(marks.withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _set(df: DataFrame, **values: Column) -> DataFrame:
    for name, value in values.items():
        old = F.col(name)
        df = df.withColumn(name, F.when(F.col("_hit"), value).otherwise(old))
    return df.drop("_hit")


def mark(ra: DataFrame, ids: DataFrame, ts: Column, state: str | None = None) -> DataFrame:
    """Set the checked time of the ids, and their state when given."""
    hit = _flag(ra, ids)
    values = {"suggestion_last_checked_at": ts}
    if state is not None:
        values["suggestion_state"] = F.lit(state)
    return _set(hit, **values)


def _members(articles: DataFrame, ids: DataFrame, links: DataFrame) -> DataFrame:
    clusters = articles.join(ids.select("id").distinct(), "id", "left_semi").where("cluster_id IS NOT NULL")
    return links.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi").select("raw_article_id").distinct()


def publish(articles: DataFrame, ids: DataFrame, links: DataFrame, ra: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(articles, raw articles) after publishing ids: members of their clusters become used."""
    out = _set(_flag(articles, ids), published=F.lit(True), published_at=ts)
    raw = _set(_flag(ra, _members(articles, ids, links)), suggestion_state=F.lit("used"), suggestion_used_at=ts)
    return out, raw


def unpublish(articles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, outcome per id): unpublished, already_unpublished or not_found."""
    hit = _flag(articles, ids)
    outcome = ids.select("id").distinct().join(articles.select("id", "published"), "id", "left").select(
        "id",
        F.when(F.col("published").isNull(), "not_found").when(F.col("published"), "unpublished")
        .otherwise("already_unpublished").alias("outcome"),
    )
    return _set(hit, published=F.lit(False)), outcome


def delete_drafts(
    articles: DataFrame, ids: DataFrame, links: DataFrame, ra: DataFrame, image_sources: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(articles, raw articles, image sources, outcome) after deleting unpublished ids.

    Members return to new; image sources lose their link and are analysed again.
    """
    outcome = ids.select("id").distinct().join(articles.select("id", "published"), "id", "left").select(
        "id",
        F.when(F.col("published").isNull(), "not_found").when(F.col("published"), "refused_published")
        .otherwise("deleted").alias("outcome"),
    )
    gone = outcome.where("outcome = 'deleted'").select("id")
    raw = _set(
        _flag(ra, _members(articles, gone, links)),
        suggestion_state=F.lit("new"), suggestion_used_at=F.lit(None).cast("timestamp"),
    )
    images = None
    if image_sources is not None:
        images = _set(
            _flag(image_sources, gone, "generated_article_id"),
            status=F.lit("analyzed"), generated_article_id=F.lit(None).cast("string"),
        )
    return articles.join(gone, "id", "left_anti"), raw, images, outcome


def reject(props: DataFrame, ids: DataFrame, hide: bool, ra: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(proposals, raw articles): proposals rejected, members ignored when ``hide``."""
    out = _set(_flag(props, ids), status=F.lit("rejected"))
    if not hide:
        return out, ra
    members = props.join(ids.select("id").distinct(), "id", "left_semi").select(F.explode("article_ids").alias("id"))
    return out, _set(_flag(ra, members), suggestion_state=F.lit("ignored"), suggestion_rejected_at=ts)


def ignore(ra: DataFrame, ids: DataFrame) -> DataFrame:
    """Single articles taken out of the pool."""
    return _set(_flag(ra, ids), suggestion_state=F.lit("ignored"))


def purge_pending(props: DataFrame, ra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, raw articles): pending ones deleted, their members new and unchecked."""
    members = props.where("status = 'pending'").select(F.explode("article_ids").alias("id"))
    raw = _set(
        _flag(ra, members), suggestion_state=F.lit("new"), suggestion_last_checked_at=F.lit(None).cast("timestamp")
    )
    return props.where("NOT (status <=> 'pending')"), raw


def normalize_slug(col: Column) -> Column:
    out = F.regexp_replace(F.lower(or_empty(col)), "[^a-z0-9-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(out, 1, SLUG_CHARS), "-+$", "")


def _assign_family(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slugs of one family of bases, in order."""
    taken = {s for t in pdf["taken"] for s in t}
    out = []
    for r in pdf.sort_values("id").itertuples():
        names = [r.base] + [f"{r.base}-{n}" for n in range(2, LAST_SUFFIX + 1)]
        slug = next((n for n in names if n not in taken), f"{r.base}-{r.id}")
        taken.add(slug)
        out.append((r.id, slug))
    return pd.DataFrame(out, columns=["id", "slug"])


def allocate_slugs(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, slug): first free of base, base-2 ... base-98 for every new row, in id order.

    A row beyond the last suffix gets its id as suffix.  Only the first 98 rows of a base
    can get a number, which bounds what one base contributes before any grouping.  Bases
    that are a suffix of each other are settled together, the others by rank alone.
    """
    base = normalize_slug(F.col("raw_slug"))
    rows = new.select("id", F.when(base == "", F.concat(F.lit("article-"), "id")).otherwise(base).alias("base"))
    top = top_per_key(rows, ["base"], [F.col("id").asc()], LAST_SUFFIX, "rank")
    over = rows.join(top.select("id"), "id", "left_anti").select("id", F.concat_ws("-", "base", "id").alias("slug"))
    bases = top.groupBy("base").agg(F.count("*").alias("n"))
    names = bases.select(
        "base",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.lit(LAST_SUFFIX)),
            lambda i: F.when(i == 1, F.col("base")).otherwise(F.concat_ws("-", "base", i.cast("string"))),
        )).alias("slug"),
    )
    used = names.join(existing.where("slug IS NOT NULL").select("slug").distinct(), "slug", "left_semi")
    used = used.groupBy("base").agg(F.collect_set("slug").alias("taken"))
    family = F.regexp_replace("base", "(-[0-9]{1,2})+$", "")
    info = bases.join(used, "base", "left").select(
        "base", F.coalesce("taken", F.array().cast("array<string>")).alias("taken"), family.alias("family")
    )
    shared = info.groupBy("family").agg(F.count("*").alias("bases"))
    info = info.join(shared, "family")
    placed = top.join(info, "base")
    options = F.transform(
        F.sequence(F.lit(1), F.lit(LAST_SUFFIX)),
        lambda i: F.when(i == 1, F.col("base")).otherwise(F.concat_ws("-", "base", i.cast("string"))),
    )
    alone = placed.where("bases = 1").select(
        "id",
        F.coalesce(F.get(F.array_except(options, "taken"), F.col("rank") - 1), F.concat_ws("-", "base", "id")).alias("slug"),
    )
    together = placed.where("bases > 1").groupBy("family").applyInPandas(_assign_family, "id string, slug string")
    return alone.unionByName(together).unionByName(over)


def validate_articles(df: DataFrame) -> DataFrame:
    """``df`` with ``quality_issue``: too_short, low_script_ratio, site_noise or null."""
    both = F.concat(or_empty(F.col("title")), F.lit("\n"), or_empty(F.col("content")))
    ko = F.length(F.regexp_replace(both, "[^가-힣]", ""))
    latin = F.length(F.regexp_replace(both, "[^A-Za-z]", ""))
    ratio = F.when(ko + latin > 0, ko / (ko + latin)).otherwise(F.lit(0.0))
    issue = (
        F.when((F.length(or_empty(F.col("title"))) < MIN_TITLE) | (F.length(or_empty(F.col("content"))) < MIN_BODY), "too_short")
        .when(ratio < MIN_SCRIPT_RATIO, "low_script_ratio")
        .when(any_match(both, BOILERPLATE[:4]), "site_noise")
    )
    return df.withColumn("script_ratio", F.round(ratio, 4)).withColumn("quality_issue", issue)


def normalize_taxonomy(df: DataFrame) -> DataFrame:
    """Known category or the default; a genre only for releases."""
    cat = strip(or_empty(F.col("category")))
    cat = F.when(cat.isin(CATEGORIES), cat).otherwise(DEFAULT_CATEGORY)
    genre = genre_key(F.col("genre"))
    return df.withColumn("genre", F.when((cat == RELEASE) & genre.isin(GENRES), genre).otherwise(DEFAULT_GENRE)).withColumn("category", cat)


def display_names(dictionary: DataFrame) -> DataFrame:
    """(en, ko, avoid) of entities with an established local name."""
    return dictionary.where("ko_status = 'established'").where(strip(or_empty(F.col("ko"))) != "").select(
        "en", "ko", F.coalesce("ko_avoid", F.array().cast("array<string>")).alias("avoid")
    )


def _substitute(df: DataFrame, col: str, rules: DataFrame, bounded: bool) -> DataFrame:
    """Replace every ``src`` by ``dst`` in order of falling length.

    Only the rules whose key occurs in the text are applied to a row.
    """
    keyed = rules.distinct().withColumn("block_key", block_key(F.lower("src")))
    if bounded:
        keys = key_postings(df.select("id", F.lower(or_empty(F.col(col))).alias("hay")), keyed)
    else:
        # without boundaries a name can sit inside a longer word: key on its first characters
        from newsflow.operators.entities import gram_postings, gram_size

        keyed = rules.distinct().withColumn("_size", gram_size(F.col("src"))).where("_size IS NOT NULL").withColumn(
            "block_key", F.substring("src", F.lit(1), F.col("_size")))
        keys = gram_postings(df, col, keyed, ["id"]).withColumnRenamed("_gram", "block_key")
    # the keys are selective and a common word has few rules of its own, so the rules aren't repeated by salt
    per_row = keys.join(keyed, "block_key").groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct((-F.length("src")).alias("n"), "src", "dst"))).alias("_r")
    )
    edge = "[A-Za-z0-9]"

    def apply(acc: Column, r: Column) -> Column:
        pattern = regex_quote(r["src"])
        if bounded:
            pattern = F.concat(F.lit(f"(?<!{edge})"), pattern, F.lit(f"(?!{edge})"))
        safe = F.regexp_replace(r["dst"], r"([\\$])", r"\\$1")
        return F.when(F.contains(acc, r["src"]), F.regexp_replace(acc, pattern, safe)).otherwise(acc)

    joined = df.join(per_row, "id", "left")
    return joined.withColumn(
        col, F.when(F.col("_r").isNull(), F.col(col)).otherwise(F.reduce("_r", F.col(col), apply))
    ).drop("_r")


def apply_display_names(df: DataFrame, names: DataFrame, col: str = "title", bounded: bool = True) -> DataFrame:
    """Local names in a text column: longest name first, then disliked spellings corrected.

    Short all-capital or symbol names are skipped when ``bounded``; unbounded replacement
    takes every name as it is and corrects nothing.
    """
    letters = F.regexp_replace("en", "[^A-Za-z]", "")
    risky = (F.length("en") < 4) & ((letters == "") | (letters == F.upper(letters)))
    rules = names.where("en <> ko").select(F.col("en").alias("src"), F.col("ko").alias("dst"), risky.alias("risky"))
    if not bounded:
        return _substitute(df, col, rules.select("src", "dst"), False)
    # the texts are read twice by the second substitution: the first is done once
    mapped = cut(_substitute(df, col, rules.where("NOT risky").select("src", "dst"), True))
    fixes = names.select(F.explode("avoid").alias("src"), F.col("ko").alias("dst")).where("src <> '' AND src <> dst")
    return _substitute(mapped, col, fixes, True)


def attribute_single(articles: DataFrame, links: DataFrame, ra: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source_label, source_url) for articles whose cluster has exactly one source article.

    The label is the feed's name, else the host of the article's URL.
    """
    ones = links.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("raw_article_id").alias("raw_id")).where("n = 1")
    feed = sources.select(F.col("id").cast("string").alias("source_id"), strip(F.col("name")).alias("feed_name"))
    raw = ra.select(F.col("id").alias("raw_id"), "url", "source_id").join(feed, "source_id", "left")
    host = host_key(F.col("url"))
    label = F.coalesce(F.when(F.col("feed_name") != "", F.col("feed_name")), F.when(host != "", host), F.lit(UNKNOWN_HOST))
    return (
        articles.select("id", "cluster_id").join(ones, "cluster_id").join(raw, "raw_id")
        .select("id", label.alias("source_label"), strip_url(F.col("url")).alias("source_url"))
    )


def cluster_sources(
    links: DataFrame, ra: DataFrame, sources: DataFrame, max_chars: int | None = SOURCE_CHARS
) -> DataFrame:
    """(cluster_id, sources, error): cleaned texts of 80 or more characters per cluster.

    A text gives its first ``max_chars`` characters, or all of them with ``None``.

    A cluster's list is one article's input to write from, so it is a row; clusters of any
    number are spread over tasks and partial lists meet only at their own cluster.
    """
    feed = sources.select(F.col("id").cast("string").alias("source_id"), F.col("name").alias("feed_name"))
    rows = links.join(ra.withColumnRenamed("id", "raw_article_id"), "raw_article_id", "left").join(feed, "source_id", "left")
    text = clean_text(or_empty(F.col("content")), max_chars)
    one = F.struct(
        F.col("raw_article_id").alias("id"),
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(UNTITLED)).alias("title"),
        F.col("text"), F.col("url"), F.coalesce("feed_name", F.lit(UNKNOWN_SOURCE)).alias("source_name"), "published_at",
    )
    rows = rows.withColumn("text", text)
    out = rows.groupBy("cluster_id").agg(
        F.count_if(F.col("url").isNotNull()).alias("found"),
        F.array_sort(F.collect_list(F.when(F.length("text") >= MIN_SOURCE_CHARS, one))).alias("sources"),
    )
    return out.select(
        "cluster_id", "sources",
        F.when(F.col("found") == 0, "no_source_article").when(F.size("sources") == 0, "no_usable_text").alias("error"),
    )


def snapshot_counts(name: str, df: DataFrame, state: Column | None = None) -> DataFrame:
    """(table, state, n) of one snapshot."""
    s = F.lit("all") if state is None else F.coalesce(state.cast("string"), F.lit("null"))
    return df.groupBy(s.alias("state")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "state", "n")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of two snapshot reports side by side, with ``equal``."""
    b = before.withColumnRenamed("n", "n_before")
    a = after.withColumnRenamed("n", "n_after")
    out = b.join(a, ["table", "state"], "full_outer").na.fill(0, ["n_before", "n_after"])
    return out.withColumn("equal", F.col("n_before") == F.col("n_after"))
