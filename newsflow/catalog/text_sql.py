"""SQL forms of the shared text expressions."""

from __future__ import annotations

from newsflow.functions import text as t
from newsflow.operators import entities as ent

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {q('(?i)' + p)})" for p in patterns) + ")"


def squash(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def normalize_text(expr: str) -> str:
    return squash(f"regexp_replace(lower({expr}), '[^a-z0-9\\s-]', ' ', 'g')")


def clean_text(expr: str, n: int) -> str:
    out = f"regexp_replace({expr}, {q('(?is)' + t.STOP_SECTIONS + '.*$')}, '')"
    out = f"regexp_replace({out}, {q(t.BYLINE)}, chr(10) || '\\1' || chr(10), 'g')"
    out = f"regexp_replace({out}, {q(t.BREAK_BEFORE)}, chr(10) || '\\1' || chr(10), 'gi')"
    for p in t.BOILERPLATE:
        out = f"regexp_replace({out}, {q(p)}, ' ', 'gi')"
    lines = f"list_transform(string_split({out}, chr(10)), lambda x: trim(x, {WS}))"
    lines = f"list_filter({lines}, lambda x: x <> '' AND NOT regexp_matches(x, {q('(?i)' + t.NAV_LINE)}))"
    out = f"regexp_replace(array_to_string({lines}, chr(10)), '[ \\t\\f\\v]+', ' ', 'g')"
    return f"trim(substr({out}, 1, {n}), {WS})"


def snippet(expr: str) -> str:
    return squash(clean_text(f"coalesce({expr}, '')", 500))


def is_category(expr: str) -> str:
    return f"{normalize_text(expr)} IN ({', '.join(q(w) for w in t.CATEGORY_WORDS)})"


def topic_evidence(title: str, content: str) -> str:
    text = f"(coalesce({title}, '') || chr(10) || substr(coalesce({content}, ''), 1, 500))"
    return (
        f"({hit(text, ent.TOPIC_PATTERNS)} OR ({hit(text, [ent.SYNTH_WORD])} AND NOT {hit(title, [ent.VEHICLE_TITLE])})"
        f" OR ({hit(text, [ent.DJ_WORD])} AND NOT {hit(title, [ent.HIP_HOP_TITLE])}))"
    )
