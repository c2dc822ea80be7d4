"""Substring dedup by sliding sentence spans (operator 2).

A text is cut into units: a word that ends in ``.``, ``!`` or ``?``, or a line end, closes one, and in every
``LONGEST`` words without a sentence start the word whose pair with the one before it has the least hash starts one.
Units so depend on the words around them alone, not on where the text or its last sentence began.  A span is ``WORDS`` words
from the start of a unit: every repeated passage of ``1 + LONGEST + WORDS`` words or more holds a span of all its
copies, wherever it is spliced in.  All spans of all texts are hashed and joined globally.  The words of a span that is not
its first occurrence (by doc_id, then place) are removed, and with them the words on both sides that it
shares with its first occurrence.

Skew: a text sends each span once, first occurrences are minima that add up before the shuffle, and the spans are
joined back by an equi-join whose hot keys Spark can split.  The words around a first occurrence (``REACH`` on a side: no copy of a passage
goes further beyond its spans) are read for the outermost spans of each repeated run alone.

Defined cases: a null text stays null and an empty one empty; rows with equal id and text are one document (a
repeat inside a text counts, a repeated row does not); a null id comes first; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

WORDS = 24
LONGEST = 16
REACH = 24
NO_ID = -(1 << 63)

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _sliding(v: np.ndarray, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``LONGEST`` consecutive values (a power of two)."""
    k = 1
    while k < LONGEST:
        v = best(v[:-k], v[k:])
        k *= 2
    return v


class Spans:
    """Units and spans of a slice.

    ``w_start``, ``word``, ``w_first``: first byte and hash of each word, first word of each row; ``unit``: first word of
    each unit; ``first``: first unit of each row; ``i``: first word of each span; ``h``: its hash; ``row``: its row; ``nth``:
    equal spans before it in its row.
    """

    def __init__(self, s: tb.Slice):
        low = tb.Slice(s.lo, s.hi, tb.LOWER[s.buf], s.offsets)
        self.w_start, w_end, self.w_first = tb.runs(low, tb.VISIBLE)
        n = len(self.w_start)
        self.word = tb.hashes(low, self.w_start, w_end)
        head = np.zeros(n + 1, bool)  # a unit starts here
        head[self.w_first] = True
        if n:
            lines = np.concatenate([[0], np.cumsum(low.buf[: low.size] == 0x0A)])
            closed = _STOP[low.buf[w_end - 1]]
            closed[:-1] |= lines[self.w_start[1:]] > lines[w_end[:-1]]
            head[1:] |= closed
        head = head[:n]
        if n:
            # a sentence start is the least of all windows around it, also of those that cross rows
            v = tb.mix(np.roll(self.word, 1) * np.uint64(31) + self.word) | np.uint64(1)
            v[head] = 0
            edge = np.zeros(LONGEST - 1, np.uint64)
            least = _sliding(np.concatenate([v, edge]), np.minimum)
            head = head | (v == _sliding(np.concatenate([edge, least]), np.maximum))
        self.unit = np.flatnonzero(head)
        self.first = np.searchsorted(self.unit, self.w_first)
        row = tb.row_of(self.first)
        ok = self.unit + WORDS <= self.w_first[row + 1]
        self.i, self.row = self.unit[ok], row[ok]
        power = np.full(n + 1, np.uint64(_P), np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        back = np.full(n + 1, np.uint64(_P_INVERSE), np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * power[:-1], dtype=np.uint64)])
        self.h = tb.mix((total[self.i + WORDS] - total[self.i]) * back[self.i])
        self.nth, _ = tb.occurrence(self.row, self.h)

    def short(self, i: int, j: int) -> np.ndarray:
        """32 bits of the hashes of the words from i to j."""
        return (self.word[i:j] >> np.uint64(32)).astype(np.uint32)


def _first_last(docs: DataFrame) -> DataFrame:
    """(h, id, key, at) of every distinct span of a text; ``at`` counts words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in tb.slices(b.column(2)):
                p = Spans(s)
                one = p.nth == 0
                r = p.row[one] + s.lo
                yield tables.record([
                    ("h", pa.int64(), p.h[one].view(np.int64)), ("id", pa.int64(), ids[r]), ("key", pa.int64(), keys[r]),
                    ("at", pa.int32(), (p.i[one] - p.w_first[p.row[one]]).astype(np.int32))])

    return docs.mapInArrow(work, "h long, id long, key long, at int")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), tables.text_key(body).alias("key"),
        body.alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, first_ids, hits, around): the spans of a text that stand in an earlier one, where, and the words around there."""
    keyed = _keyed(docs, doc_id, text)
    rows = _first_last(keyed)
    seen = rows.groupBy("h").agg(
        F.min(F.struct("id", "key")).alias("lead"), F.max(F.struct("id", "key")).alias("last"))
    seen = seen.where("lead <> last").select("h", "lead")
    hits = rows.join(seen, "h").where(F.struct("id", "key") != F.col("lead"))
    # a text's own spans bound its lists; a repeated row has the same ones
    hits = tables.stored(hits.groupBy("id", "key").agg(
        F.array_sort(F.collect_set("lead.id")).alias("first_ids"),
        F.array_sort(F.collect_set(F.struct("at", "h", F.col("lead.id").alias("lead_id"), F.col("lead.key").alias("lead_key")))).alias("hits"),
    ), "span-hits")
    edges = tables.stored(_edges(hits), "span-edges")
    wanted = edges.groupBy(F.col("lead_id").alias("id"), F.col("lead_key").alias("key")).agg(F.collect_set("h").alias("spans"))
    around = _around(keyed.join(wanted, ["id", "key"])).dropDuplicates(["h"])
    around = edges.join(around, "h").groupBy("id", "key").agg(F.collect_list(F.struct("h", "before", "after")).alias("around"))
    return hits.select("id", "key", "first_ids", F.col("hits.h").alias("spans")).join(around, ["id", "key"], "left")


def _edges(hits: DataFrame) -> DataFrame:
    """(id, key, h, lead_id, lead_key) of the first and the last span of every run of spans that touch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            off = col.offsets.to_numpy()
            at, h, lead_id, lead_key = (
                x.to_numpy(zero_copy_only=False)[off[0]: off[-1]] for x in col.values.flatten())
            owner = np.repeat(np.arange(b.num_rows), np.diff(off))
            opens = np.ones(len(at), bool)
            opens[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + WORDS)
            ends = np.append(opens[1:], True)[: len(at)]
            k = np.flatnonzero(opens | ends)
            yield tables.record([
                ("id", pa.int64(), b.column(0).to_numpy()[owner[k]]), ("key", pa.int64(), b.column(1).to_numpy()[owner[k]]),
                ("h", pa.int64(), h[k]), ("lead_id", pa.int64(), lead_id[k]), ("lead_key", pa.int64(), lead_key[k])])

    return hits.select("id", "key", "hits").mapInArrow(work, "id long, key long, h long, lead_id long, lead_key long")


def _around(texts: DataFrame) -> DataFrame:
    """(h, before, after): the words beside the first occurrence of each of a text's ``spans``, 4 bytes a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(0)):
                p = Spans(s)
                k = np.flatnonzero((p.nth == 0) & _listed(p, b.column(1).slice(s.lo, s.rows)))
                before, after = [], []
                for i, r in zip(p.i[k].tolist(), p.row[k].tolist(), strict=True):
                    before.append(p.short(max(i - REACH, p.w_first[r]), i).tobytes())
                    after.append(p.short(i + WORDS, min(i + WORDS + REACH, p.w_first[r + 1])).tobytes())
                yield tables.record([
                    ("h", pa.int64(), p.h[k].view(np.int64)), ("before", pa.binary(), before), ("after", pa.binary(), after)])

    return texts.select("text", "spans").mapInArrow(work, "h long, before binary, after binary")


def _listed(p: Spans, spans: pa.Array) -> np.ndarray:
    """Whether each span is in its row's list."""
    off = spans.offsets.to_numpy()
    listed = spans.values.to_numpy(zero_copy_only=False)[off[0]: off[-1]].view(np.uint64)
    if not len(listed) or not len(p.h):
        return np.zeros(len(p.h), bool)
    owner = np.repeat(np.arange(len(spans)), np.diff(off))
    # spans of one row are told apart from those of another by the row in the hash
    known = np.sort(tb.mix(listed + owner.astype(np.uint64) * np.uint64(_P)))
    mine = tb.mix(p.h + p.row.astype(np.uint64) * np.uint64(_P))
    return known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cut, and ``_n`` (n_sentences, n_removed) and ``_first_ids`` behind its columns.

    ``n_sentences`` counts units, ``n_removed`` those that lost words.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text)
    body = F.col(f"c{place}").cast("string")
    plain = docs.toDF(*names).select(
        *[body.alias(c) if i == place else F.col(c) for i, c in enumerate(names)],
        F.coalesce(F.col(names[docs.columns.index(doc_id)]).cast("long"), F.lit(NO_ID)).alias("id"),
        tables.text_key(body).alias("key"))
    joined = plain.join(repeats(docs, doc_id, text), ["id", "key"], "left").select(
        *names, "spans", "around", F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"))
    schema = joined.drop("spans", "around").withColumns(
        {"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(place)):
                part = b.slice(s.lo, s.rows)
                texts, total, gone = _cut(s, part.column(place), part.column(len(names)), part.column(len(names) + 1))
                cols = [texts if i == place else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, part.column(len(names) + 2), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                    names=schema.names)

    return joined.mapInArrow(work, schema)


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two runs share from their start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _gone(p: Spans, spans: pa.Array, around: pa.Array) -> np.ndarray:
    """Whether each word of a slice goes."""
    n = len(p.word)
    listed = _listed(p, spans)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, p.i[listed], 1)
    np.add.at(edge, p.i[listed] + WORDS, -1)
    again = np.flatnonzero(p.nth > 0)
    where: dict[tuple[int, int], list[int]] = {}
    sides = around.to_pylist()
    if len(again) or any(sides):
        for r, h, i in zip(p.row.tolist(), p.h.view(np.int64).tolist(), p.i.tolist(), strict=True):
            where.setdefault((r, h), []).append(i)
    own = []  # (first occurrence, repeat) in one text; the first keeps its words where the two overlap
    for k in again.tolist():
        i = int(p.i[k])
        f = where[int(p.row[k]), int(p.h[k : k + 1].view(np.int64)[0])][0]
        own.append((f, i, int(p.row[k])))
        edge[max(i, f + WORDS)] += 1
        edge[i + WORDS] -= 1
    gone = np.cumsum(edge)[:n] > 0
    for r, each in enumerate(sides):
        lo, hi = p.w_first[r], p.w_first[r + 1]
        for x in each or ():
            before, after = np.frombuffer(x["before"], np.uint32), np.frombuffer(x["after"], np.uint32)
            for i in where.get((r, x["h"]), ()):
                gone[i - _alike(p.short(max(i - REACH, lo), i)[::-1], before[::-1]): i] = True
                end = i + WORDS
                gone[end: end + _alike(p.short(end, min(end + REACH, hi)), after)] = True
    for f, i, r in own:
        if i > f + WORDS and not gone[i - 1]:
            m = min(i - f - WORDS, f - p.w_first[r], REACH)
            gone[i - _alike(p.word[i - m: i][::-1], p.word[f - m: f][::-1]): i] = True
        end, last = i + WORDS, p.w_first[r + 1]
        if end < last and not gone[end]:
            m = min(REACH, last - end)
            gone[end: end + _alike(p.word[end: end + m], p.word[f + WORDS: f + WORDS + m])] = True
    return gone


def _cut(s: tb.Slice, text: pa.Array, spans: pa.Array, around: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    p = Spans(s)
    gone = _gone(p, spans, around)
    row = tb.row_of(p.first)
    touched = np.add.reduceat(gone, p.unit, dtype=np.int64) > 0 if len(p.unit) else np.zeros(0, bool)
    n_gone = np.bincount(row[touched], minlength=s.rows)
    out: list = []
    for r, old in enumerate(text):
        if not n_gone[r]:
            out.append(old.as_py())
            continue
        lo, hi = p.w_first[r], p.w_first[r + 1]
        mine = gone[lo:hi]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))  # a removed run from, to, ...
        bounds = np.append(p.w_start[lo:hi], s.offsets[r + 1])[turn]
        kept = np.concatenate([[s.offsets[r]], bounds, [s.offsets[r + 1]]]).reshape(-1, 2)
        out.append(b"".join(s.raw(a, b) for a, b in kept).decode("utf-8", "replace"))
    return pa.array(out, pa.string()), np.diff(p.first), n_gone


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cut; ``n_chars``, where there is one, counts the new text."""
    out = deduplicated(docs, doc_id, text).drop("n_sentences", "n_removed", "first_ids").toDF(*docs.columns)
    kind = dict(docs.dtypes)
    if kind.get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.length(f"`{text}`").cast(kind["n_chars"]))
    return out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.only(tables.read(spark, sf_dir, "documents"), ("doc_id", "doc_id", "long"), ("text", "text", "string"))
    return deduplicated(docs).toDF("doc_id", "text", "first_ids", "n_sentences", "n_removed")
