"""Entity matching and eligibility.

Matching joins the words of each article's opening with the dictionary on one exact key
per surface, then verifies the surface in place.  A surface is bounded by characters
outside ``[a-z0-9]``, so every word inside it is a whole word of the article, and words
that follow each other in it do so in the article.  Its only word, or the longest two
words in a row, are therefore a complete key; a common word that many surfaces share
does not meet all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.joins import salted_join, top_per_key
from newsflow.functions.lineage import cut
from newsflow.functions.text import (
    SP, any_match, ascii_runs, haystack, or_empty, regex_quote, rx, rxi,
)

# --- fixed values: words that show a text is about the covered music field ---
TOPIC_PATTERNS = [
    r"\belectronic music\b",
    r"\bdance music\b",
    r"\bhouse music\b",
    r"\b(?:techno|trance|dubstep|drum and bass|drum & bass|dnb)\b",
    r"\belectronic(?:\s+music)?\s+producer\b",
    r"전자\s*음악|일렉트로닉\s*뮤직|하우스\s*뮤직|테크노|트랜스|덥스텝|드럼\s*앤드\s*베이스|디제이",
    r"電子音楽|エレクトロニック(?:・|\s*)ミュージック|ハウス(?:・|\s*)ミュージック|テクノ|トランス|ダブステップ|ドラム(?:・|\s*)アンド(?:・|\s*)ベース",
]
SYNTH_WORD = r"\b(?:synth|synthesizer|chiptune)\b"
DJ_WORD = r"\bDJ(?:s|ing)?\b"
HIP_HOP_TITLE = r"\b(?:hip[- ]?hop|r&b|rap|turntablist)\b"
# lower-case words of which every match of the patterns holds one
TOPIC_WORDS = [
    "electronic music", "dance music", "house music", "techno", "trance", "dubstep", "drum and bass", "drum & bass", "dnb",
    "producer", "전자", "일렉트로닉", "하우스", "테크노", "트랜스", "덥스텝", "드럼", "디제이",
    "電子音楽", "エレクトロニック", "ハウス", "テクノ", "トランス", "ダブステップ", "ドラム",
]
SYNTH_WORDS, DJ_WORDS = ["synth", "chiptune"], ["dj"]
VEHICLE_TITLE = r"\b(?:e-?bike|eMTB|electric (?:mountain )?bike|mountain bike|cycling)\b"
MAX_INPUT = 120
UNMATCHED_RATIO = 0.6
BATCH = 20
# --- end of fixed values ---

_PLAIN_GAP = rf"[{SP},.:;()'\"\[\]\-–—]"
_THE = r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"


def _neighbours(runs: Column) -> Column:
    """Every two runs in a row, with one space between."""
    after = F.slice(runs, 2, F.greatest(F.lit(0), F.size(runs) - 1))
    both = F.zip_with(runs, after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(both, lambda x: x.isNotNull())


def block_key(surface: Column) -> Column:
    """The longest two ``[a-z0-9]`` runs in a row, or the only one; without any, the first one or two characters that are not space."""
    runs = ascii_runs(surface)
    longest = F.reduce(
        F.when(F.size(runs) > 1, _neighbours(runs)).otherwise(runs), F.lit(""),
        lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc),
    )
    return F.when(longest != "", longest).otherwise(
        F.substring(F.regexp_extract(surface, f"[^{SP}]+", 0), 1, 2)
    )


def add_block_key(surfaces: DataFrame) -> DataFrame:
    return surfaces.withColumn("block_key", block_key(F.col("surface")))


def gram_keys(hay: Column) -> Column:
    """Every key that a surface without one could have."""
    others = F.regexp_extract_all(hay, F.lit(f"[^a-z0-9{SP}]+"), F.lit(0))
    grams = F.flatten(
        F.transform(
            others,
            lambda r: F.transform(
                F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2))
            ),
        )
    )
    singles = F.transform(grams, lambda g: F.substring(g, 1, 1))
    return F.array_distinct(F.concat(grams, singles))


def _bounded(pattern: Column) -> Column:
    return F.concat(F.lit("(?<![a-z0-9])"), pattern, F.lit("(?![a-z0-9])"))


def surface_found(hay: Column, surface: Column, key: Column) -> Column:
    """Surface present between ASCII boundaries; a one-word surface is its own proof.

    The plain substring test comes first: it settles most candidates without a regex.
    """
    return (F.length(surface) >= 2) & (
        ((surface == key) & surface.rlike("^[a-z0-9]+$"))
        | (F.contains(hay, surface) & F.regexp(hay, _bounded(regex_quote(surface))))
    )


def context_found(
    hay: Column, surface: Column, before: Column, after: Column, max_gap: Column
) -> Column:
    """Surface with a context word near it, only light punctuation or ``the`` between.

    The gap is at most ``max_gap`` characters; the look-ahead bounds its length and the
    lazy gap then reaches the nearest right-hand word.
    """
    s = _bounded(regex_quote(surface))

    def near(word: Column, left: Column, right: Column) -> Column:
        reach = F.concat(
            F.lit("(?s)"), left, F.lit("(?=.{0,"), max_gap.cast("string"), F.lit("}"), right,
            F.lit(f")(?:{_PLAIN_GAP}|{_THE})*?"), right,
        )
        return F.contains(hay, word) & F.regexp(hay, reach)

    return F.contains(hay, surface) & (
        F.exists(before, lambda c: near(c, _bounded(regex_quote(c)), s))
        | F.exists(after, lambda c: near(c, s, _bounded(regex_quote(c))))
    )


def _key_bounds(surfaces: DataFrame) -> Column:
    """What a key needs to be in the dictionary, as one value: the length of the shortest one-word key (``one``), of the
    shortest word in a key of two (``two``), null without such keys, and whether there are keys without a word (``other``)."""
    key = F.col("block_key")
    runs = F.split(key, " ")
    word = key.rlike("^[a-z0-9]")
    two = key.contains(" ")
    return surfaces.agg(F.struct(
        F.min(F.when(word & ~two, F.length(key))).alias("one"),
        F.min(F.when(word & two, F.least(F.length(runs[0]), F.length(runs[1])))).alias("two"),
        F.coalesce(F.bool_or(~word), F.lit(False)).alias("other"),
    ).alias("b")).scalar()


def key_postings(hay: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(id, block_key) of ``hay`` (id, hay): every key that one of ``surfaces`` could have there.

    Words shorter than any in a key of the dictionary are left out before the shuffle, and characters that are no words are
    only cut into keys where some surface has none: no surface is lost by either.
    """
    runs = hay.select("id", "hay", ascii_runs(F.col("hay")).alias("_runs"), _key_bounds(surfaces).alias("_b"))
    one, two = F.col("_b.one"), F.col("_b.two")
    after = F.slice("_runs", 2, F.greatest(F.lit(0), F.size("_runs") - 1))
    both = F.zip_with("_runs", after, lambda a, b: F.when(
        (F.length(a) >= two) & (F.length(b) >= two), F.concat(a, F.lit(" "), b)))
    none = F.array().cast("array<string>")
    keys = F.concat(
        F.filter("_runs", lambda w: F.length(w) >= one),
        F.filter(both, lambda x: x.isNotNull()),
        F.when(F.col("_b.other"), gram_keys(F.col("hay"))).otherwise(none),
    )
    return runs.select("id", F.explode(F.array_distinct(keys)).alias("block_key"))


def _candidates(hay: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Rows of ``hay`` (id, hay) with every surface whose key occurs in it.

    Postings (id, key) meet the dictionary without the text, which only joins the surfaces found, by id.  One plan for
    every size: Spark's own size check decides whether the dictionary is broadcast, and AQE splits the postings of a
    common word.
    """
    met = key_postings(hay, surfaces).join(surfaces, "block_key")
    return met.join(hay.select("id", "hay"), "id")


def match_strong(hay: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(id, canonical, role, surface, surface_pos) of every strong surface found."""
    return (
        _candidates(hay, surfaces.where("match_type = 'strong'"))
        .where(surface_found(F.col("hay"), F.col("surface"), F.col("block_key")))
        .select("id", "canonical", "role", "surface", "surface_pos")
    )


def match_contextual(hay: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The same for surfaces that need a context word."""
    return (
        _candidates(hay, surfaces.where("match_type = 'contextual'"))
        .where(
            context_found(
                F.col("hay"), F.col("surface"), F.col("before"), F.col("after"), F.col("max_gap")
            )
        )
        .select("id", "canonical", "role", "surface", "surface_pos")
    )


def entity_index(ra: DataFrame, surfaces: DataFrame) -> DataFrame:
    """One row per article and entity: (id, canonical, role, surface, match_type).

    Both kinds of surface are matched in one pass.  A strong surface is preferred, then
    the dictionary's order.
    """
    hay = ra.select("id", haystack().alias("hay"))
    strong = F.col("match_type") == "strong"
    found = F.when(
        strong, surface_found(F.col("hay"), F.col("surface"), F.col("block_key"))
    ).otherwise(
        context_found(F.col("hay"), F.col("surface"), F.col("before"), F.col("after"), F.col("max_gap"))
    )
    hits = _candidates(hay, surfaces).where(found)
    best = F.min_by(
        F.struct("surface", "match_type"),
        F.struct((~strong).alias("late"), F.col("surface_pos"), F.col("surface")),
    )
    return (
        hits.groupBy("id", "canonical", "role").agg(best.alias("b"))
        .select("id", "canonical", "role", "b.surface", "b.match_type")
    )


def entity_articles(index: DataFrame) -> DataFrame:
    """Number of articles per qualifying entity; the pairs themselves are the index."""
    return index.where("role = 'qualifying'").groupBy("canonical").agg(F.count("*").alias("n_articles"))


def _says_one(text: Column, words: list[str]) -> Column:
    """A word is in the lower-cased text, which the lambda names once: cheap, and settles most texts before any pattern."""
    def one(t: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(t, F.lit(w))
        return out

    return F.exists(F.array(F.lower(text)), one)


def has_topic_evidence(title: Column, content: Column) -> Column:
    """The opening names the music field, or a synth or DJ outside a misleading title."""
    text = F.concat(or_empty(title), F.lit("\n"), F.substring(or_empty(content), 1, 500))
    t = or_empty(title)
    return (
        (_says_one(text, TOPIC_WORDS) & any_match(text, TOPIC_PATTERNS))
        | (_says_one(text, SYNTH_WORDS) & text.rlike(rxi(SYNTH_WORD)) & ~t.rlike(rxi(VEHICLE_TITLE)))
        | (_says_one(text, DJ_WORDS) & text.rlike(rxi(DJ_WORD)) & ~t.rlike(rxi(HIP_HOP_TITLE)))
    )


def approval_path() -> Column:
    """Path of an accepted correspondent gate, else null."""
    gate = F.col("facts.correspondent_gate")
    return F.when(
        (gate["decision"] == "accepted") & gate["path"].isin("entity", "dance_experience"),
        gate["path"],
    )


def partition_articles(ra: DataFrame, index: DataFrame) -> DataFrame:
    """``ra`` with ``partition``: qualifying, dance_experience, supporting_only or not_matched.

    The quota reads the partitions twice, so what the index says of an article is computed once.
    """
    roles = cut(index.groupBy("id").agg(
        F.count_if(F.col("role") != "supporting").alias("n_qualifying"),
        F.count_if(F.col("role") == "supporting").alias("n_supporting"),
    ))
    part = (
        F.when(F.col("n_qualifying") > 0, "qualifying")
        .when(approval_path() == "dance_experience", "dance_experience")
        .when(F.col("n_supporting") > 0, "supporting_only")
        .otherwise("not_matched")
    )
    return ra.join(roles, "id", "left").withColumn("partition", part).drop("n_qualifying", "n_supporting")


def quota_columns(ra: DataFrame) -> DataFrame:
    """What partitions and quota need of ``ra``: the evidence instead of the texts, so that no text is shuffled."""
    narrow = [c for c in ra.columns if c not in ("title", "content")]
    return ra.select(*narrow, has_topic_evidence(F.col("title"), F.col("content")).alias("_evidence"))


def select_quota(
    parts: DataFrame,
    order: list[str],
    max_input: int = MAX_INPUT,
    ratio: float = UNMATCHED_RATIO,
) -> DataFrame:
    """Rows with ``selected`` and, for the others, ``skip_reason``.

    ``order`` names the columns the input is taken in, ascending.

    Qualifying rows fill the input first, then accepted experience rows, then unmatched
    rows with topic evidence up to their share.  The evidence is read from ``_evidence``
    where ``parts`` have it (``quota_columns``), else from title and content.
    """
    evidence = F.col("_evidence") if "_evidence" in parts.columns else has_topic_evidence(F.col("title"), F.col("content"))
    lane = (
        F.when(F.col("partition") == "qualifying", "qualifying")
        .when(F.col("partition") == "dance_experience", "dance_experience")
        .when((F.col("partition") == "not_matched") & evidence, "evidence")
    )
    rows = parts.withColumn("_lane", lane)
    keyed = rows.where(F.col("_lane").isNotNull())
    # three lanes of max_input rows at most, read three times below
    picks = cut(top_per_key(
        keyed.select(*dict.fromkeys(["id", "_lane", *order])),
        ["_lane"], [F.col(c).asc() for c in order], max_input, "_rn",
    ))
    n = picks.agg(
        F.count_if(F.col("_lane") == "qualifying").alias("q"),
        F.count_if(F.col("_lane") == "dance_experience").alias("d"),
    )
    q = n.select("q").scalar()
    d = n.select("d").scalar()
    d_max = F.lit(max_input) - q
    left = F.greatest(F.lit(0), d_max - F.least(d, d_max))
    cap = (
        F.when(F.col("_lane") == "qualifying", F.lit(max_input))
        .when(F.col("_lane") == "dance_experience", d_max)
        .otherwise(F.least(left, F.lit(math.floor(max_input * ratio))))
    )
    chosen = picks.where(F.col("_rn") <= cap).select("id", F.lit(True).alias("selected"))
    # at most three lanes of max_input rows, so the chosen ids are a bounded broadcast
    return (
        rows.join(F.broadcast(chosen), "id", "left")
        .withColumn("selected", F.coalesce("selected", F.lit(False)))
        .withColumn(
            "skip_reason",
            F.when(F.col("selected"), None)
            .when(F.col("partition") == "supporting_only", "supporting_entity_only")
            .when(F.col("partition") == "not_matched", "non_entity_cap")
            .when(F.col("partition") == "qualifying", "entity_cap"),
        )
        .drop("_lane", "_evidence")
    )


def assign_batches(rows: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """Batch number of each selected row, in order; the input is at most one pool."""
    w = Window.orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


# a pattern is keyed by its first characters, as many as the largest of these sizes that it has
GRAMS = (16, 11, 8, 5, 3, 2, 1)


def gram_size(pattern: Column) -> Column:
    return F.coalesce(*[F.when(F.length(pattern) >= n, n) for n in GRAMS])


def ngram_keys(text: Column, sizes: Column) -> Column:
    """All substrings of the given sizes, once each."""
    def of(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.transform(starts, lambda i: F.substring(text, i, n))

    fit = F.filter(sizes, lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fit, of)))


def gram_postings(texts: DataFrame, text: str, patterns: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, _gram): the keys that one of ``patterns`` (_size) could have in a text; only sizes that occur are cut out."""
    sizes = patterns.agg(F.collect_set("_size").alias("s")).scalar()
    rows = texts.where(F.length(text) > 0).select(*keep, F.col(text).alias("_text"), sizes.alias("_sizes"))
    return rows.select(*keep, F.explode(ngram_keys(F.col("_text"), F.col("_sizes"))).alias("_gram"))


def contains_join(texts: DataFrame, patterns: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of ``texts`` (text, ...) joined with the ``patterns`` (pattern) they contain.

    A text contains a pattern only if it contains the pattern's first characters, up to 16, which makes the
    search an equi-join; hot grams are spread by ``keep``.  Grams travel without the text, which
    joins the pairs that met by ``keep``.
    """
    pats = patterns.withColumn("_size", gram_size(F.col("pattern"))).where("_size IS NOT NULL").withColumn(
        "_gram", F.substring("pattern", F.lit(1), F.col("_size")))
    grams = gram_postings(texts, "text", pats, keep)
    met = salted_join(grams, pats.drop("_size"), ["_gram"], keep, salts=4).drop("_gram").distinct()
    met = met.select(*[F.col(k).alias(f"_k_{k}") for k in keep], *[c for c in patterns.columns])
    same = F.lit(True)
    for k in keep:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        texts.select(*keep, "text").join(met, same)
        .where(F.contains(F.col("text"), F.col("pattern")))
        .select(*keep, *patterns.columns)
    )


def surface_sweep(
    ra: DataFrame, needles: list[tuple[str, str]], index: DataFrame, labels: DataFrame
) -> DataFrame:
    """For given (needle, canonical) pairs: raw substring hits and whether the index agrees.

    One row per needle and article with the label, a short excerpt and a digest.
    """
    text = F.lower(F.concat(or_empty(F.col("title")), F.lit("\n"), or_empty(F.col("content"))))
    wanted = F.array(
        *[F.struct(F.lit(n).alias("needle"), F.lit(c).alias("canonical")) for n, c in needles]
    )
    hits = ra.withColumn(
        "_n", F.explode(F.filter(wanted, lambda w: F.contains(text, F.lower(w["needle"]))))
    ).select(
        F.col("_n.needle").alias("needle"), F.col("_n.canonical").alias("canonical"), "id", "title",
        "fetched_at",
        F.substring(F.btrim(F.regexp_replace(or_empty(F.col("content")), f"[{SP}]+", " ")), 1, 800).alias("excerpt"),
        F.length(or_empty(F.col("content"))).alias("content_length"),
        F.sha2(or_empty(F.col("content")), 256).alias("content_hash"),
    )
    names = [c for _, c in needles]
    marks = index.where(F.col("canonical").isin(names) & (F.col("role") != "supporting")).select(
        "id", "canonical", F.lit(True).alias("_m")
    )
    return (
        hits.join(marks, ["id", "canonical"], "left")
        .join(labels.select("id", "label"), "id", "left")
        .select(
            "needle", "canonical", "id", "title", "fetched_at",
            F.coalesce("_m", F.lit(False)).alias("matched"), "label", "excerpt", "content_length",
            "content_hash",
        )
    )
