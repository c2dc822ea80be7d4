"""Benchmark decontamination (operator 3): Wu-Manber search of test-item windows in whole texts.

Both sides are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  The test
strings are all runs of 13 consecutive item words (an item of fewer words is one string).  The
search alphabet is words: a shift table over hashed blocks of two words (one word for strings of
one word) skips positions where no string can end, a bucket of the block that ends a string
together with its first block selects the strings, and a direct comparison of their bytes confirms an
occurrence.  Strings of different lengths have tables of their own, so a short item does not
shorten the shifts of the others.

The item table is a stated query set: it is taken in blocks of ``BLOCK_BYTES`` of text, each broadcast
and searched in all documents in turn.  A document is never shuffled.

Defined cases: a null or empty text has no words, no hits and is not contaminated; items without
words match nothing; a null item id is written as an empty string; equal item ids count once; repeated documents are judged
one by one; an empty item table leaves every document clean.
"""

from __future__ import annotations


from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

WINDOW = 13
BLOCK_BYTES = 8 << 20
TABLE_BITS = 18
SHARE = 20  # contaminated if 20 * n_hit >= n_words


@dataclass
class Patterns:
    """The tables for the strings of one length in words."""

    length: int
    block: int
    shift: np.ndarray
    pair: np.ndarray  # sorted hashes of (last block, first block)
    first: np.ndarray  # bounds of each pair's strings
    last: np.ndarray
    words: list[bytes]  # the strings, words joined by a blank, in the order of the pairs
    items: list[list[str]]  # the items of each string


def _words(text: str) -> list[bytes]:
    s = next(tb.slices(pa.array([text]), tb.LOWER, 1 << 62))
    start, end, _ = tb.runs(s, tb.ALNUM)
    return [s.raw(a, b) for a, b in zip(start, end, strict=True)]


def _codes(words: list[bytes]) -> np.ndarray:
    s = next(tb.slices(pa.array([b" ".join(words)]).cast(pa.string()), tb.KEEP_CASE, 1 << 62))
    start, end, _ = tb.runs(s, tb.ALNUM)
    return tb.hashes(s, start, end)


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    return tb.mix(h[:-1] * np.uint64(0x100000001B3) + h[1:]) if size == 2 else tb.mix(h)


def build(items: list[tuple[str, str]]) -> list[Patterns]:
    """The search tables of the items."""
    strings: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            part = w[i: i + WINDOW]
            strings[len(part)][b" ".join(part)].add(item)
    out = []
    for length, found in sorted(strings.items()):
        block = min(2, length)
        shift = np.full(1 << TABLE_BITS, length - block + 1, np.int64)
        rows = []
        for text, ids in found.items():
            b = _blocks(_codes(text.split(b" ")), block)
            np.minimum.at(shift, (b >> np.uint64(64 - TABLE_BITS)).astype(np.int64), len(b) - 1 - np.arange(len(b)))
            rows.append((int(tb.mix(b[-1:] * np.uint64(31) + b[:1])[0]), text, sorted(ids)))
        rows.sort(key=lambda r: r[:2])
        pair = np.array([r[0] for r in rows], np.uint64)
        keys, first, n = np.unique(pair, return_index=True, return_counts=True)
        out.append(Patterns(length, block, shift, keys, first, first + n, [r[1] for r in rows], [r[2] for r in rows]))
    return out


def _search(p: Patterns, s: tb.Slice, start: np.ndarray, end: np.ndarray, first: np.ndarray, h: np.ndarray):
    """(first word, string) of every occurrence.  All texts of a slice advance together."""
    if len(h) < p.length:
        return
    b = _blocks(h, p.block)
    # position of a block = its first word; the string ends with the block
    at = first[:-1] + p.length - p.block
    stop = first[1:] - p.block
    live = at <= stop
    at, stop = at[live], stop[live]
    cell = (b >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    ends = []
    # long texts are cut into stretches, so that no text advances alone
    at, stop = _stretch(at, stop)
    while len(at):
        step = p.shift[cell[at]]
        ends.append(at[step == 0])
        at = at + np.maximum(step, 1)
        live = at <= stop
        at, stop = at[live], stop[live]
    if not ends:
        return
    last = np.concatenate(ends)
    begin = last - (p.length - p.block)
    pair = tb.mix(b[last] * np.uint64(31) + b[begin])
    place = np.searchsorted(p.pair, pair)
    place[place == len(p.pair)] = 0
    for k in np.flatnonzero(p.pair[place] == pair):
        w = int(begin[k])
        text = b" ".join(s.raw(start[i], end[i]) for i in range(w, w + p.length))
        for j in range(p.first[place[k]], p.last[place[k]]):
            if p.words[j] == text:
                yield w, j


STRETCH = 256


def _stretch(at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (stop - at) // STRETCH + 1
    row = np.repeat(np.arange(len(at)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = at[row] + k * STRETCH
    return lo, np.minimum(lo + STRETCH - 1, stop[row])


def _scan(column: pa.Array, patterns: list[Patterns]) -> Iterator[tuple[tb.Slice, np.ndarray, list, list]]:
    """By slice: words of each row, hit words (positions) of each row, items of each row."""
    for s in tb.slices(column, tb.LOWER):
        start, end, first = tb.runs(s, tb.ALNUM)
        h = tb.hashes(s, start, end)
        hit: dict[int, set[int]] = defaultdict(set)
        items: dict[int, set[str]] = defaultdict(set)
        for p in patterns:
            for w, j in _search(p, s, start, end, first, h):
                r = int(np.searchsorted(first, w, "right")) - 1
                hit[r].update(range(w - int(first[r]), w - int(first[r]) + p.length))
                items[r].update(p.items[j])
        yield s, np.diff(first), hit, items


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[Patterns]]:
    """Search tables for one block of items after the other."""
    rows = tables.only(benchmark, (item_id, "item_id", "string"), (text, "text", "string")).where("text is not null")
    block, size, any_yet = [], 0, False
    for r in rows.toLocalIterator():
        block.append((r.item_id or "", r.text))
        size += len(r.text)
        if size >= BLOCK_BYTES:
            yield build(block)
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield build(block)



def search(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_n_words``, ``_hit`` (sorted word positions, 32 bit) and ``_items``."""
    out = docs.withColumns({
        "_n_words": F.lit(0).cast("long"), "_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>"),
    })
    place = docs.columns.index(text)
    for patterns in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, n_words, hit, items in _scan(b.column(place), shared.value):
                    part = b.slice(s.lo, s.rows)
                    before_hit, before = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                    hits, names = [], []
                    for r in range(s.rows):
                        if r not in hit and not before_hit[r].is_valid:
                            hits.append(None)
                            names.append(None)
                            continue
                        old = np.frombuffer(before_hit[r].as_py() or b"", np.uint32)
                        new = np.union1d(old, np.array(sorted(hit.get(r, ())), np.uint32)).astype(np.uint32)
                        hits.append(new.tobytes())
                        names.append(sorted(set(before[r].as_py() or ()) | items.get(r, set())))
                    cols = part.columns[:-3] + [
                        pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string())),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

        out = out.mapInArrow(work, out.schema)
    return out



def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated."""
    found = search(tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string")), benchmark)
    n_hit = F.coalesce(F.length("_hit") / 4, F.lit(0)).cast("long")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("_n_words"))).alias("contaminated"),
        items.alias("items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    found = search(plain, benchmark, names[docs.columns.index(text)])
    n_hit = F.coalesce(F.length("_hit") / 4, F.lit(0)).cast("long")
    clean = found.where(~((n_hit > 0) & (SHARE * n_hit >= F.col("_n_words"))))
    return clean.select(*names).toDF(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark")).drop("items")
