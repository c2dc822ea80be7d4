"""A plain merge of the groups of one run: the brute-force version of ``stories.merge_groups``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from newsflow.functions.text import is_category, is_source_or_series, normalize_text, strip
from newsflow.operators import stories as st

MAX_ARTICLES, MAX_KEYWORDS, MAX_ENTITIES, MIN_COHESION = 10, 6, 5, 20
RECENT_MICROS = 7 * 86400 * 1_000_000


def _terms(g: dict) -> set[str]:
    names = {e["low"] for e in g["ents"]}
    phrases = {k["phrase"] for k in g["kw"]} | set(g["topic_terms"])
    phrases = {p for p in phrases if len(p) >= 3 and p not in names}
    words = {w for p in phrases for w in p.split(" ") if len(w) >= 5}
    if len(g["facts"]) != len(g["article_ids"]):
        return set()

    def supported(term: str) -> bool:
        return term not in g["series"] and all(
            not (m["source"] and term in m["source"])
            and (term in m["story"] or all(w in m["story"] for w in term.split(" ")))
            for m in g["facts"]
        )

    return {t for t in phrases | words if supported(t)}


def _related(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and (a in b or b in a))


def _finish(g: dict) -> dict:
    g["terms"] = _terms(g)
    g["keys"] = {e["low"] for e in g["ents"] if e["low"]}
    g["dates"] = {m["date"] for m in g["facts"] if m["date"]}
    times = [m["at"] for m in g["facts"] if m["at"] is not None]
    g["latest"] = max(times) if times else None
    return g


def _score(a: dict, b: dict) -> int | None:
    if len(a["dates"] | b["dates"]) > 1:
        return None
    entities = len(a["keys"] & b["keys"])
    if any(" " in t for t in a["terms"] & b["terms"]):
        story = 2
    else:
        story = int(any(_related(x, y) for x in a["terms"] for y in b["terms"]))
    near = (
        a["latest"] is not None and b["latest"] is not None
        and abs(a["latest"] - b["latest"]) <= RECENT_MICROS
    )
    if (entities and story) or (not entities and story == 2 and near):
        return 2 * entities + story
    return None


def _cohesion(ids: list, ents: list, facts: list) -> int:
    if len(ids) < 2 or not ents:
        return 0
    hits = sum(e["norm"] in m["text"] for e in ents for m in facts)
    score = hits / (len(ids) * len(ents)) * 80 + min(len(ids), 5) * 4
    if all(e["cat"] for e in ents):
        score -= 45
    return max(0, min(100, math.floor(score + 0.5)))


def _merge(a: dict, b: dict) -> dict:
    ids = list(dict.fromkeys(a["article_ids"] + b["article_ids"]))
    if len(ids) > MAX_ARTICLES:
        best = {}
        for g in (a, b):
            for i in g["article_ids"]:
                best[i] = max(best.get(i, g["cohesion"]), g["cohesion"])
        ids = sorted(ids, key=lambda i: -best[i])[:MAX_ARTICLES]
    words: dict[str, dict] = {}
    for k in a["kw"] + b["kw"]:
        if k["k"]:
            words.setdefault(k["low"], k)
    larger = b if len(b["article_ids"]) > len(a["article_ids"]) else a
    right = {e["low"] for e in b["ents"]}
    by_id = {m["id"]: m for m in b["facts"] + a["facts"]}
    out = {
        "parts": a["parts"] + b["parts"], "topic": larger["topic"], "reason": larger["reason"],
        "topic_terms": larger["topic_terms"], "kw": list(words.values())[:MAX_KEYWORDS],
        "ents": [e for e in a["ents"] if e["low"] in right][:MAX_ENTITIES],
        "article_ids": ids, "facts": [by_id[i] for i in ids if i in by_id],
        "series": a["series"] | b["series"],
    }
    out["cohesion"] = _cohesion(ids, out["ents"], out["facts"])
    if any(_related(x, y) for x in a["terms"] for y in b["terms"]):
        out["cohesion"] = max(out["cohesion"], min(100, 80 + 4 * min(len(ids), 5)))
    return out


def pairs_of(live: dict) -> list[tuple]:
    """(order, left, right) of all mergeable pairs; keys are positions."""
    out = []
    for i in live:
        for j in live:
            if i < j:
                s = _score(live[i], live[j])
                if s is not None and _merge(live[i], live[j])["cohesion"] >= MIN_COHESION:
                    out.append(((-s, i, j), i, j))
    return sorted(out)


def merge_in_rounds(groups: list[dict]) -> list[dict]:
    """Every round merges the pairs that come before all others of their two groups."""
    live, step = {g["pos"]: _finish(g) for g in groups}, 0
    first = {p: p for p in live}
    while pairs := pairs_of(live):
        step += 1
        best: dict = {}
        for o, i, j in pairs:
            best.setdefault(i, o)
            best.setdefault(j, o)
        for o, i, j in pairs:
            if best[i] == best[j] == o:
                at = step * (1 << 44) + min(first[i], first[j])
                first[at] = min(first[i], first[j])
                live[at] = _finish(_merge(live.pop(i), live.pop(j)))
    return list(live.values())


def merge_one_by_one(groups: list[dict]) -> list[dict]:
    """The best pair merges, again and again; new groups go to the end."""
    live = {k: _finish(g) for k, g in enumerate(sorted(groups, key=lambda g: g["pos"]))}
    end = len(live)
    while pairs := pairs_of(live):
        _, i, j = pairs[0]
        live[end] = _finish(_merge(live.pop(i), live.pop(j)))
        end += 1
    return list(live.values())


def prepared(groups) -> dict[str, list[dict]]:
    """The groups of every run with the normal forms that the plain merge needs."""
    phrase = F.transform("keywords", lambda k: F.struct(strip(k).alias("k"), F.lower(strip(k)).alias("low"), st.story_term(k).alias("phrase")))
    ents = F.transform(
        "common_entities",
        lambda e: F.struct(e.alias("e"), F.lower(strip(e)).alias("low"), normalize_text(e).alias("norm"), is_category(e).alias("cat")))
    phrases = st.all_terms(F.col("keywords"), F.col("topic"))
    tokens = F.flatten(F.transform(phrases, lambda p: F.split(p, " ")))
    series = F.filter(F.array_distinct(F.concat(phrases, tokens)), is_source_or_series)
    topics = F.filter(F.transform(st.quoted_parts(F.col("topic")), st.story_term), lambda t: F.length(t) >= 3)
    members = F.transform(
        "members",
        lambda m: F.struct(
            m["id"].alias("id"), m["text"].alias("text"), m["story"].alias("story"), m["source"].alias("source"),
            m["event_date"].cast("string").alias("date"), F.unix_micros(m["published_at"]).alias("at")))
    out: dict[str, list[dict]] = {}
    for r in groups.select(
        "run_id", "group_id", "pos", "topic", "reason", "article_ids", F.coalesce("cohesion_score", F.lit(0)).alias("cohesion"), phrase.alias("kw"),
        ents.alias("ents"), series.alias("series"), topics.alias("topic_terms"), members.alias("facts"),
    ).collect():
        g = r.asDict(recursive=True)
        out.setdefault(r.run_id, []).append(g | {"parts": [r.group_id], "series": set(g["series"])})
    return out


def keys(groups: list[dict]) -> list[tuple]:
    return sorted(
        ("+".join(g["parts"]), g["topic"], tuple(k["k"] for k in g["kw"]), tuple(g["article_ids"]), tuple(e["e"] for e in g["ents"]), g["cohesion"])
        for g in groups)
