"""Column expressions for dates and publication times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import once, or_empty, rx, rxu, squash, strip
from newsflow.functions.unicode import nfkc

# --- fixed values: month names, zone words, listing date patterns in their order ---
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
ZONES = {
    "Z": "+00:00", "GMT": "+00:00", "UTC": "+00:00", "UT": "+00:00", "BST": "+01:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
LISTING_PATTERNS = [
    (r"(?<!\d)(20\d{2})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{1,2})(?!\d)", ("y", "m", "d")),
    (r"(?<!\d)(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?", ("y", "m", "d")),
    (r"(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*日", ("m", "d")),
    (r"(?<!\d)(\d{1,2})\s*[/.-]\s*(\d{1,2})(?!\s*[/.-]\s*\d)", ("m", "d")),
    (r"(?i)(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})(?:\s+(20\d{2}))?", ("d", "n", "y")),
    (r"(?i)([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(20\d{2}))?", ("n", "d", "y")),
]
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(Z|z|[+-]\d{2}:?\d{2}|GMT|UTC|BST)?)?$"
RFC = r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})(?:\s+(\d{2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]{1,3})?)?$"
RANGE_FORMS = [
    r"(?P<year>20\d{2})\s*[年년]\s*(?P<month>\d{1,2})\s*[月월]\s*"
    r"(?P<day>\d{1,2})\s*[日일]?\s*(?:[-–—~〜～]|부터|から)\s*"
    r"(?:20\d{2}\s*[年년]\s*)?\d{1,2}\s*[月월]\s*\d{1,2}\s*[日일]?",
    r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
    r"(?P<month_name>[A-Za-z]{3,9})\.?\s+(?P<day>\d{1,2})(?:st|nd|rd|th)?"
    r"(?:,?\s+(?P<year>20\d{2}))?\s*[-–—~]\s*"
    r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
    r"[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+(?P<end_year>20\d{2})",
    r"(?P<day>\d{1,2})(?:st|nd|rd|th)?\s+"
    r"(?P<month_name>[A-Za-z]{3,9})\.?\s*(?P<year>20\d{2})?\s*[-–—~]\s*"
    r"\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?\s+(?P<end_year>20\d{2})",
]
DATE_FORMS = [
    r"(?<!\d)(?P<year>20\d{2})\s*[年년]\s*(?P<month>\d{1,2})\s*[月월]\s*(?P<day>\d{1,2})\s*[日일]?",
    r"(?<!\d)(?P<year>20\d{2})\s*[/.-]\s*(?P<month>\d{1,2})\s*[/.-]\s*(?P<day>\d{1,2})(?!\d)",
    r"(?:[月火水木金土日]\s*)?(?P<day>\d{1,2})\s+(?P<month>\d{1,2})\s*月\s+(?P<year>20\d{2})",
    r"(?P<day>\d{1,2})(?:st|nd|rd|th)?\s+(?P<month_name>[A-Za-z]{3,9})\.?\s+(?P<year>20\d{2})",
    r"(?P<month_name>[A-Za-z]{3,9})\.?\s+(?P<day>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<year>20\d{2})",
]
MONTH_DAY_FORMS = [
    r"(?<!\d)0?{month}\s*[-/.]\s*0?{day}(?!\d)",
    r"(?<!\d)0?{month}\s*[月월]\s*0?{day}\s*[日일]?",
    r"(?:{month_name}|{short_name})\.?\s+{day}(?:st|nd|rd|th)?\b",
    r"(?<!\d){day}(?:st|nd|rd|th)?\s+(?:{month_name}|{short_name})\b",
]
# --- end of fixed values ---


def month_number(name: Column) -> Column:
    """Month of a full or three-letter English name, else null."""
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, start=1):
        out = F.when((low == m) | (low == m[:3]), i).otherwise(out)
    return out


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null when there is no such day."""
    text = F.concat_ws(
        "-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")
    )
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text).try_cast("date")


def _offset(zone: Column) -> Column:
    def offset(z: Column) -> Column:
        out = F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
        for name, off in ZONES.items():
            out = F.when(z == name, off).otherwise(out)
        return F.when(z == "", "+00:00").otherwise(out)

    return once(F.upper(zone), offset)


def _iso_time(t: Column) -> Column:
    g = lambda i: F.regexp_extract(t, rx(ISO), i)
    part = lambda x, d: F.when(x == "", d).otherwise(x)
    iso = F.concat(
        g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), part(g(4), "00"), F.lit(":"), part(g(5), "00"),
        F.lit(":"), part(g(6), "00"), F.lit("."), F.rpad(g(7), 6, "0"), _offset(g(8)),
    )
    return F.when(g(1) != "", iso).try_cast("timestamp")


def _iso_day(t: Column) -> Column:
    day = F.concat(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("T00:00:00+00:00"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), day).try_cast("timestamp")


def _of_this_age(at: Column) -> Column:
    return once(at, lambda x: F.when(F.year(x).between(2000, 2100), x))


def parse_iso(col: Column) -> Column:
    """Time of ISO text, or the day of text that starts with one; no zone is UTC, years 2000 to 2100 only."""
    return once(strip(or_empty(col)), lambda t: _of_this_age(F.coalesce(_iso_time(t), _iso_day(t))))


def parse_published(col: Column) -> Column:
    """Publication time of ISO or mail-style text; no zone is UTC, years 2000 to 2100 only.

    Text that only starts with an ISO date gives that day.
    """
    t = strip(or_empty(col))
    part = lambda x, d: F.when(x == "", d).otherwise(x)
    r = lambda i: F.regexp_extract(t, rx(RFC), i)
    rfc = F.concat(
        r(3), F.lit("-"), F.lpad(month_number(r(2)).cast("string"), 2, "0"), F.lit("-"), F.lpad(r(1), 2, "0"),
        F.lit("T"), part(r(4), "00"), F.lit(":"), part(r(5), "00"), F.lit(":"), part(r(6), "00"), _offset(r(7)),
    )
    return _of_this_age(F.coalesce(_iso_time(t), F.when(r(3) != "", rfc).try_cast("timestamp"), _iso_day(t)))


def nearest_date(m: Column, d: Column, today: Column) -> Column:
    """The day in last, this or next year that is closest to today."""
    options = F.array(*[safe_date(F.year(today) + k, m, d) for k in (-1, 0, 1)])
    scored = F.transform(
        F.filter(options, lambda x: x.isNotNull()),
        lambda x: F.struct(F.abs(F.datediff(x, today)).alias("gap"), x.alias("day")),
    )
    return F.array_min(scored)["day"]


def listing_date(col: Column, today: Column) -> Column:
    """Date in a listing text: the first pattern that gives a real day."""
    def found(text: Column, pattern: str, names: tuple[str, ...]) -> Column:
        at = {n: i for i, n in enumerate(names, start=1)}

        def read(val: Column) -> Column:
            dated = safe_date(val["y"], val["m"], val["d"])
            inferred = nearest_date(val["m"], val["d"], today)
            return F.when(val["said"], dated).otherwise(inferred) if names[0] != "y" else F.when(val["said"], dated)

        part = lambda n: F.regexp_extract(text, rx(pattern), at[n])
        month = once(part("n"), month_number) if "n" in at else part("m").try_cast("int")
        year = part("y") if "y" in at else F.lit("")
        fields = F.struct(
            (year != "").alias("said"), year.try_cast("int").alias("y"), month.alias("m"), part("d").try_cast("int").alias("d"))
        return F.when(part("d") != "", once(fields, read))

    text = F.regexp_replace(or_empty(col), rx(r"\s+"), " ")
    return once(text, lambda t: F.coalesce(*[found(t, pattern, names) for pattern, names in LISTING_PATTERNS]))


def has_month_day(text: Column, day: Column) -> Column:
    """True when the (normalised, lower-case) text states the month and day of ``day``."""
    full = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.month(day))
    known = {
        "month": F.month(day).cast("string"), "day": F.dayofmonth(day).cast("string"),
        "month_name": full, "short_name": F.substring(full, 1, 3),
    }
    out = F.lit(False)
    for form in MONTH_DAY_FORMS:
        parts = re.split(r"{(\w+)}", rxu(form))
        out = out | F.regexp(text, F.concat(*[known[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)]))
    return F.coalesce(out, F.lit(False))


def url_date(url: Column) -> Column:
    """Date in the path of a URL."""
    path = F.regexp_replace(F.regexp_replace(or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)[?#].*$", "")
    p = r"(?U)(?<!\d)(20\d{2})[-/](\d{1,2})[-/](\d{1,2})(?!\d)"
    parts = [F.regexp_extract(nfkc(path), p, i).try_cast("int") for i in (1, 2, 3)]
    return safe_date(*parts)


def _stated(text: Column, form: str, ignore_case: bool) -> Column:
    """(start, end, month, day) of every match of a form; the month is null where its name is none.

    A match begins where the texts between matches and the matches before it end.
    """
    group = re.compile(form).groupindex
    pattern = F.lit(("(?iU)" if ignore_case else "(?U)") + re.sub(r"\(\?P<\w+>", "(", form))
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    got = {n: F.regexp_extract_all(text, pattern, F.lit(i)) for n, i in group.items()}
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

    def read(match: Column, i: Column) -> Column:
        at = lambda n: F.nullif(F.get(got[n], i), F.lit("")) if n in got else F.lit(None).cast("string")
        start = size(between, i + 1) + size(whole, i)
        month = F.coalesce(at("month").try_cast("int"), month_number(at("month_name")))
        year = F.coalesce(at("year"), at("end_year")).try_cast("int")
        return F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), month.alias("month"),
            safe_date(year, month, at("day").try_cast("int")).cast("string").alias("day"),
        )

    return F.filter(F.transform(whole, read), lambda m: m["month"].isNotNull())


def explicit_dates(text: Column) -> Column:
    """Fully stated dates of an NFKC text as ISO text, first seen first.

    A range gives its first day, and dates inside its span are not read again.
    """
    ranges = F.concat(*[_stated(text, f, i > 0) for i, f in enumerate(RANGE_FORMS)])
    dates = F.concat(*[_stated(text, f, i > 2) for i, f in enumerate(DATE_FORMS)])
    free = F.filter(dates, lambda d: ~F.exists(ranges, lambda r: (r["start"] <= d["start"]) & (d["end"] <= r["end"])))
    return F.array_distinct(F.filter(F.transform(F.concat(ranges, free), lambda d: d["day"]), lambda x: x.isNotNull()))
