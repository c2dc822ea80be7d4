"""Column expressions for URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import once, or_empty

# --- fixed values: query keys that only track a visit ---
TRACKING_KEYS = [
    "utm_*", "fbclid", "gclid", "msclkid", "yclid", "dclid", "ref", "ref_src", "igshid", "mc_cid", "mc_eid", "spm",
]
# --- end of fixed values ---

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(col: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty when absent."""
    return F.regexp_extract(or_empty(col), "(?s)" + _PARTS, n)


def _denied(key: Column, denylist: list[str]) -> Column:
    low = F.lower(key)
    out = low.isin([d.lower() for d in denylist if not d.endswith("*")])
    for d in denylist:
        if d.endswith("*"):
            out = out | low.startswith(d[:-1].lower())
    return out


def canonical_url(col: Column, denylist: list[str] | None = None) -> Column:
    """The URL without tracking keys; every other part stays."""
    deny = TRACKING_KEYS if denylist is None else denylist
    pairs = F.filter(F.split(url_part(col, 4), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: once(F.coalesce(F.try_url_decode(F.element_at(F.split(p, "=", 2), 1)), p), lambda k: ~_denied(k, deny)))
    # a pair without a value is written with an empty one, and each side in form encoding
    again = F.transform(
        kept,
        lambda p: F.concat(
            _reencode(F.element_at(F.split(p, "=", 2), 1)), F.lit("="),
            F.when(F.contains(p, F.lit("=")), _reencode(F.element_at(F.split(p, "=", 2), -1))).otherwise(""),
        ),
    )
    query = F.array_join(again, "&")
    scheme, host, frag = url_part(col, 1), url_part(col, 2), url_part(col, 5)
    return F.concat(
        once(scheme, lambda x: F.when(x != "", F.concat(F.lower(x), F.lit(":"))).otherwise("")),
        once(host, lambda x: F.when(x != "", F.concat(F.lit("//"), x)).otherwise("")),
        url_part(col, 3),
        once(query, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")),
        once(frag, lambda x: F.when(x != "", F.concat(F.lit("#"), x)).otherwise("")),
    )


def _reencode(part: Column) -> Column:
    # Java's form encoding keeps '*' and encodes '~'; the other way round is wanted
    out = F.url_encode(F.coalesce(F.try_url_decode(part), part))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_url(col: Column) -> Column:
    """The URL without query and fragment."""
    bare = F.regexp_replace(col, "(?s)[?#].*$", "")
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)


def host_key(col: Column) -> Column:
    """Lower-case host without user, port and ``www.``."""
    host = F.regexp_replace(F.lower(url_part(col, 2)), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), r"^www\.", "")
