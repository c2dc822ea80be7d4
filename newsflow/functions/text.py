"""Column expressions for text: whitespace, word boundaries, cleaning, normal forms.

Everything here stays on the JVM.  Word boundaries and whitespace are written out
because Java's ``\\b`` is Unicode-aware and its ``\\s`` is ASCII-only, while the
rules below need an ASCII boundary and Unicode white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, for use inside a regex class.
SP = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
# The same set as plain characters, for btrim.
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(
    chr(c) for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
W = "A-Za-z0-9_"

HAYSTACK_CHARS = 500


def rx(pattern: str) -> str:
    """A pattern with ``\\b`` as the ASCII word boundary and ``\\s`` as any white space.

    A boundary at the end of a branch looks ahead, any other looks behind, which is the
    same for patterns whose branches start and end with word characters and much cheaper
    than a two-sided test.  Inside a class write ``{SP}`` instead of ``\\s``.
    """
    out = re.sub(r"\\b(?=$|\||\))", f"(?![{W}])", pattern)
    out = out.replace(r"\b", f"(?<![{W}])")
    return out.replace(r"\s", f"[{SP}]")


def rxi(pattern: str) -> str:
    """``rx`` with case ignored."""
    return "(?i)" + rx(pattern)


def rxu(pattern: str) -> str:
    """A case-ignoring pattern whose ``\\b``, ``\\d``, ``\\w`` and ``\\s`` know all scripts, for rules written that way."""
    return "(?iU)" + pattern


def says(col: Column, pattern: str) -> Column:
    """True when the text has the pattern, boundaries in any script; never null."""
    return F.coalesce(col.rlike(rxu(pattern)), F.lit(False))


def any_match(col: Column, patterns: list[str]) -> Column:
    """True when one of the (case-ignoring) patterns is found; never null."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(col.rlike(rxi(p)), F.lit(False))
    return hit


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda Spark computes an expression anew at every place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def squash(col: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return strip(F.regexp_replace(col, f"[{SP}]+", " "))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def haystack(title: str | Column = "title", content: str | Column = "content") -> Column:
    """Lower-cased title, newline, first 500 characters of the content."""
    t = F.col(title) if isinstance(title, str) else title
    c = F.col(content) if isinstance(content, str) else content
    return F.lower(
        F.concat(or_empty(t), F.lit("\n"), F.substring(or_empty(c), 1, HAYSTACK_CHARS))
    )


def ascii_runs(col: Column) -> Column:
    """All maximal ``[a-z0-9]`` runs in order."""
    return F.regexp_extract_all(col, F.lit("[a-z0-9]+"), F.lit(0))


def normalize_text(col: Column) -> Column:
    """Lower case, only ``[a-z0-9-]`` and single spaces."""
    return squash(F.regexp_replace(F.lower(col), f"[^a-z0-9\\-{SP}]", " "))


# --- fixed values: section markers and boilerplate phrases that cleaning removes ---
BOILERPLATE = [
    r"\b(login|search|members login|become a member|advertise|submit music|contact us)\b",
    r"\b(share|email|facebook|twitter|reddit|pinterest|whatsapp|telegram)\b",
    r"\b(previous article|next article|related articles|more from author|comments are closed)\b",
    r"\b(sign up|subscribe|tags|just released|claim this offer|read more)\b",
    r"\b(news tracks features mixes events genres)\b",
    r"\b(acid house ambient music balearica deep house disco/edits electronica garage house soulful house synth tech house techno uk garage)\b",
    r"\b(deep house tracks reviews|tracks reviews|features mixes events)\b",
]
STOP_SECTIONS = (
    r"\b(previous article|next article|related articles|more from author"
    r"|comments are closed|just released|sign up|subscribe)\b"
)
BYLINE = r"\b(By [A-Z][A-Za-z .'-]+ - [A-Z][a-z]+ \d{1,2}, \d{4})\b"
BREAK_BEFORE = r"\b(Tracklisting|Disclosure Statement|Previous Coverage)\b"
NAV_LINE = r"^(news|tracks|features|mixes|events|genres)$"
# --- end of fixed values ---


def clean_text(
    col: Column, max_chars: int | None = 10000, keep_paragraphs: bool = False
) -> Column:
    """Readable text of a page dump.

    Cuts at the first stop section, puts bylines and known section names on their own
    lines, blanks boilerplate phrases, drops lines that are one navigation word, caps
    the length (``None``: whole text).  Null stays null.
    """
    out = F.regexp_replace(col, "(?s)" + rxi(STOP_SECTIONS) + ".*$", "")
    out = F.regexp_replace(out, rx(BYLINE), "\n$1\n")
    out = F.regexp_replace(out, rxi(BREAK_BEFORE), "\n$1\n")
    for p in BOILERPLATE:
        out = F.regexp_replace(out, rxi(p), " ")
    lines = F.transform(F.split(out, "\n"), strip)
    lines = F.filter(lines, lambda x: ~x.rlike("(?i)" + NAV_LINE))
    if keep_paragraphs:
        out = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    else:
        out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    return strip(out if max_chars is None else F.substring(out, 1, max_chars))


def snippet(content: Column) -> Column:
    """First 500 characters of the cleaned content on one line."""
    return squash(clean_text(or_empty(content), 500))


# Entities: Spark has no decoder, and only these names are known to the rules.
_NAMED_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")]


def decode_entities(col: Column) -> Column:
    """Decode the named and numeric character references of a string, once.

    The string is cut at each reference; every piece is decoded on its own, so a decoded
    ``&amp;`` never forms a new reference.
    """
    def decoded(text: Column) -> Column:
        marked = F.regexp_replace(text, r"(?i)(&(?:#x?[0-9a-f]+|[a-z]+);)", "\u0000$1\u0000")
        pieces = F.transform(F.split(marked, "\u0000"), _decode_piece)
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return once(col, decoded)


def _decode_piece(x: Column) -> Column:
    low = F.lower(x)
    code_hex = F.regexp_extract(low, r"^&#x([0-9a-f]{1,6});$", 1)
    code_dec = F.regexp_extract(low, r"^&#([0-9]{1,7});$", 1)
    code = F.when(code_hex != "", F.conv(code_hex, 16, 10).cast("int")).when(
        code_dec != "", code_dec.cast("int")
    )
    def named(name: Column) -> Column:
        out = F.when(name == "amp", F.lit("&"))
        for n, v in _NAMED_ENTITIES:
            out = out.when(name == n, F.lit(v))
        return out.otherwise(x)

    name = F.regexp_extract(low, r"^&([a-z]+);$", 1)
    out = F.when(code.isNotNull(), code_point(code)).otherwise(once(name, named))
    return F.when(x.startswith("&") & x.endswith(";"), out).otherwise(x)


def code_point(code: Column) -> Column:
    """One character from its code point, through its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def html_to_text(col: Column) -> Column:
    """Text of an HTML fragment: chrome elements out, block ends as newlines, tags gone."""
    out = decode_entities(col)
    for tag in ("script", "style", "noscript", "svg"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/h[1-6]|/li|/blockquote)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, f"\n[{SP}]+", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# --- fixed values: words that mark a category rather than a story ---
CATEGORY_WORDS = [
    "album", "albums", "club", "clubs", "dj", "edm", "festival", "festivals", "house",
    "intros", "lineup", "line-ups", "music", "new", "new music", "premiere", "preview",
    "record", "records", "release", "released", "releases", "single", "synth", "synths",
    "techno", "track", "tracks",
]
STOP_WORDS = [
    "about", "after", "album", "albums", "also", "and", "are", "artist", "artists", "back",
    "best", "can", "club", "dance", "deep", "dj", "edm", "from", "has", "have", "home",
    "house", "into", "label", "live", "magazine", "menu", "mix", "music", "new", "news",
    "out", "premiere", "preview", "records", "release", "released", "releases", "review",
    "show", "site", "single", "so", "techno", "tech", "the", "this", "track", "tracks",
    "with", "year", "far", "just", "page", "privacy", "policy", "cookie", "cookies",
    "http", "https", "www", "com", "net", "org",
]
SOURCE_OR_SERIES = [
    r"\b909originals\b",
    r"^ia mix(?:\s+\d+)?$",
    r"^myrecordbag$",
    r"\b(bandcamp daily|beatportal|attack magazine|inverted audio)\b",
    r"\b(mixmag|dj mag|the quietus|crack magazine|ransom note|5 magazine)\b",
    r"\b(create digital music|cdm|groove magazine|fazemag|tsugi)\b",
]
LOW_SIGNAL = [
    r"^(?:19|20)\d{2}$",
    r"^(?:19|20)\d{2}\s+(?:related|news|review|in review)$",
    r"\b(?:catches up with|chats to|talks to|interview with|in conversation with)\b",
    r"\b(?:best electronic music|best albums|best tracks|top-selling tracks|top selling tracks|chart toppers)\b",
    r"\bfestival line-ups you might\b",
    r"음악\s*산업(?:의)?\s*(?:변화|도전|동향)",
    r"음악\s*페스티벌(?:과|와)\s*라이브\s*공연",
    r"전자\s*음악\s*씬\s*(?:동향|변화|흐름)",
    r"클럽\s*문화(?:의)?\s*(?:변화|동향|흐름)",
]
ENTITY_SITE_SUFFIX = (
    r"\s+[-–—|]\s*(909originals|bandcamp daily|beatportal|attack magazine|inverted audio"
    r"|mixmag|dj mag|cdm|create digital music)$"
)
# --- end of fixed values ---


def normalize_entity(col: Column) -> Column:
    """Entity name without leading dash or article and without a site suffix."""
    out = F.regexp_replace(col, rxi(r"^[-–—:|]\s*"), "")
    out = F.regexp_replace(out, rxi(r"^(at|for|of|the|with)\s+"), "")
    out = F.regexp_replace(out, rxi(ENTITY_SITE_SUFFIX), "")
    return squash(out)


def is_category(col: Column) -> Column:
    return normalize_text(col).isin(CATEGORY_WORDS)


def is_url_text(col: Column) -> Column:
    """Looks like a URL or a domain name."""
    low = F.lower(col)
    norm = normalize_text(col)
    return (
        low.rlike(rx(r"\bhttps?:\/\/"))
        | low.rlike(rx(r"\bwww\."))
        | low.rlike(rx(r"\b[a-z0-9-]+\.(com|net|org|co|uk|de|fr|io|fm)\b"))
        | norm.rlike(rx(r"\b(https|http|www)\b"))
        | norm.rlike(rx(r"\b(com|net|org|co|uk|de|fr|io|fm)\b"))
    )


def is_source_or_series(col: Column) -> Column:
    return any_match(normalize_entity(col), SOURCE_OR_SERIES)


def is_low_signal(col: Column) -> Column:
    return any_match(normalize_text(col), LOW_SIGNAL)


def is_specific_entity(col: Column) -> Column:
    """A name that can identify a story, not a category, site, year or common word."""
    norm = normalize_text(col)
    tokens = F.filter(F.split(norm, " "), lambda t: t != "")
    originals = F.filter(F.split(col, f"[{SP}]+"), lambda t: t != "")
    multi = F.exists(
        tokens,
        lambda t: ~t.isin(STOP_WORDS) & ~t.isin(CATEGORY_WORDS) & ~t.rlike(r"^\d+$"),
    )
    upper = F.exists(
        originals, lambda t: t.rlike("^[A-Z]") | t.rlike("^[A-Z0-9]{2,}$")
    )
    single = upper & (F.length(norm) >= 4) & ~norm.isin(STOP_WORDS)
    rejected = (
        (norm == "")
        | is_category(norm)
        | is_url_text(col)
        | is_source_or_series(col)
        | is_low_signal(col)
        | norm.rlike(rx(r"\b(of the year|the year|so far|year \d{4})\b"))
        | strip(col).rlike("[&-]$")
    )
    return ~rejected & F.when(F.size(tokens) >= 2, multi).otherwise(single)


def regex_quote(col: Column) -> Column:
    """The text of a column as a literal Java regex."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def topic_key(col: Column) -> Column:
    return F.lower(strip(col))


def ordered_distinct(pairs: Column) -> Column:
    """First occurrences of an array, in order (array_distinct keeps the order)."""
    return F.array_distinct(pairs)
