"""Near-duplicate classes by order MinHash (operator 6).

Words are lower-cased runs of digits, letters and non-ASCII characters.  A text is the sequence of its
five-word shingles, each labelled with how many equal ones stand before it.

1. Equal texts (128 bits of hash) are one node; everything below works on nodes.
2. For each of ``SKETCHES`` hash functions the ``PICK`` shingles of smallest hash are kept in text order and
   hashed: an order MinHash.  ``ROWS`` sketches make a band key.
3. In each bucket of a band the node that meets most others leads, and every other member is compared with the leader.
   A bucket whose members are all similar to it is done: they are in one class.  Otherwise every member that is not
   is compared with all others.  Where these pairs are more than ``WIDTH`` a member, the bucket is cut into blocks of
   about ``BLOCK`` words and every two blocks meet in one group, which counts the shingles that two members share: only pairs
   that share enough to be similar are aligned.  The count is exact, so no pair that is similar is left out.
4. A pair is verified by banded alignment of the labelled shingles: the longest common chain within
   a band around the diagonal.  Similar: ``aligned / (n1 + n2 - aligned) >= SIMILARITY``, for all shingles or
   for the first of each kind alone (texts that repeat themselves differently).
5. Classes are the connected components of the verified links.

Defined cases: a null text is a class of its own; texts without words are in a class with equal texts
alone; a text of fewer than five words is one shingle; the class id is the smallest id of the
class; rows that repeat id and text are in the same class, and ``keep_first`` keeps one of them; a null id sorts before all others; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import tables
from newsflow.llm import textbytes as tb
from newsflow.operators.components import components

SHINGLE = 5
SIMILARITY = 0.8
PICK = 2
ROWS = 3
BANDS = 24
SKETCHES = ROWS * BANDS
SEED = 11
WIDTH = 8
BLOCK = 1 << 16
NO_ID = -(1 << 63)

_ODD = tb.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
_LABEL = np.uint64(0x9E3779B97F4A7C15)


def shingles(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes in text order, offsets of the rows, whether each is the first of its kind)."""
    n = np.diff(first)
    h, at = tb.windows(word, first, SHINGLE)
    row = tb.row_of(first)[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):  # the whole text is its one shingle
        one = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = n[short] > k
            one[has] = tb.mix(one[has] * np.uint64(31) + word[first[short[has]] + k])
        row = np.concatenate([row, short])
        h = np.concatenate([h, one])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    nth, _ = tb.occurrence(row, h)
    return tb.mix(h + nth.astype(np.uint64) * _LABEL), np.searchsorted(row, np.arange(len(n) + 1)), nth == 0


def sketches(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An order MinHash per row and hash function; rows without shingles are zero."""
    rows = len(at) - 1
    out = np.zeros((rows, SKETCHES), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    start, size = at[full], np.diff(at)[full]
    group = np.repeat(np.arange(len(full)), size)
    top = np.uint64((1 << 64) - 1)
    for i in range(SKETCHES):
        y = x * _ODD[i]
        place, value = [], []
        for _ in range(PICK):
            low = np.minimum.reduceat(y, start)
            p = np.flatnonzero(y == low[group])
            p = p[np.concatenate([[True], group[p][1:] != group[p][:-1]])]  # ties: the first
            value.append(np.where(low == top, np.uint64(0), x[p]))
            place.append(np.where(low == top, np.iinfo(np.int64).max, p))
            y[p] = top
        order = np.argsort(np.stack(place), axis=0, kind="stable")
        picked = np.take_along_axis(np.stack(value), order, 0)
        h = np.zeros(len(full), np.uint64)
        for v in picked:
            h = tb.mix(h * np.uint64(31) + v)
        out[full, i] = h
    return out


def _band_keys(sk: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sk), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sk), b + 1, np.uint64)
        for r in range(ROWS):
            h = tb.mix(h * np.uint64(31) + sk[:, b * ROWS + r])
        out[:, b] = h
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Length of the longest common chain of labelled shingles inside the band the similarity allows."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (1 - similarity) / (1 + similarity) * (len(a) + len(b)) + 1
    ok = np.abs(i - j) <= band
    i, j = i[ok], j[ok]
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for v in j.tolist():
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)


def similar(
    a: np.ndarray, b: np.ndarray, new_a: np.ndarray, new_b: np.ndarray, similarity: float = SIMILARITY
) -> bool:
    """Whether all shingles, or the first ones of each kind alone, align well enough."""
    for x, y in ((a, b), (a[new_a], b[new_b])):
        m = aligned(x, y, similarity)
        if m > 0 and m >= similarity * (len(x) + len(y) - m):
            return True
        if new_a.all() and new_b.all():
            break
    return False


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(SEED), "text").alias("h2"))


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, sk) of every text; sk is empty without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(1), tb.LOWER):
                start, end, first = tb.runs(s, tb.ALNUM)
                x, at, _ = shingles(tb.hashes(s, start, end), first)
                sk = sketches(x, at)[np.diff(at) > 0].view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.diff(at) > 0)]) * SKETCHES
                part = b.slice(s.lo, s.rows)
                yield tables.record([
                    *[(n, pa.int64(), part.column(i)) for n, i in (("doc_id", 0), ("h1", 2), ("h2", 3))],
                    ("sk", pa.list_(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sk.reshape(-1)))),
                ])

    return _texts(docs).where("text is not null").mapInArrow(work, "doc_id long, h1 long, h2 long, sk array<long>")


def _words(docs: DataFrame) -> DataFrame:
    """(node, words): 32-bit word hashes of the texts of (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(1), tb.LOWER):
                start, end, first = tb.runs(s, tb.ALNUM)
                h = (tb.hashes(s, start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield tables.record([
                    ("node", pa.int64(), b.column(0).slice(s.lo, s.rows)),
                    ("words", pa.list_(pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h))),
                ])

    return docs.select("node", "text").mapInArrow(work, "node long, words array<int>")


def _of_lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    word = col.values.to_numpy(zero_copy_only=False)[off[0]: off[-1]].view(np.uint32).astype(np.uint64)
    return shingles(word, (off - off[0]).astype(np.int64))


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                (xa, fa, na), (xb, fb, nb) = _of_lists(part.column(2)), _of_lists(part.column(3))
                cut_a = [slice(fa[i], fa[i + 1]) for i in range(part.num_rows)]
                cut_b = [slice(fb[i], fb[i + 1]) for i in range(part.num_rows)]
                ok = [similar(xa[a], xb[b], na[a], nb[b]) for a, b in zip(cut_a, cut_b, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok))

    wa = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    wb = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(work, "a long, b long")


def _shared(x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """How many labelled shingles each row of ``x`` shares with each row of ``y``; a row has each of its own once."""
    out = np.zeros((len(fx) - 1, len(fy) - 1), np.int64)
    order = np.argsort(y, kind="stable")
    ys, col = y[order], tb.row_of(fy)[order]
    lo, n = np.searchsorted(ys, x), np.searchsorted(ys, x, side="right")
    n -= lo
    row = tb.row_of(fx)
    total = np.cumsum(n)
    at = 0
    while at < len(x):  # about four million meetings at once
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22), side="right")))
        m = n[at:end]
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cell = np.repeat(row[at:end], m) * out.shape[1] + col[np.repeat(lo[at:end], m) + within]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
        at = end
    return out


def _can_be_similar(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Whether the words of each row of ``a`` and of ``b`` share enough shingles, all or the first of each kind."""
    (xa, fa, na), (xb, fb, nb) = _of_lists(a), _of_lists(b)
    ok = np.zeros((len(a), len(b)), bool)
    for x, fx, y, fy in (
        (xa, fa, xb, fb),
        (xa[na], np.concatenate([[0], np.cumsum(na)])[fa], xb[nb], np.concatenate([[0], np.cumsum(nb)])[fb]),
    ):
        m = _shared(x, fx, y, fy)
        ok |= (m > 0) & (m >= SIMILARITY * (np.diff(fx)[:, None] + np.diff(fy)[None, :] - m))
    return ok


def _across_blocks(members: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members (key, node, ok) of a bucket that can be similar; not two that are both ``ok``."""

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        low, high = (t.filter(pc.equal(t["block"], t[c])) for c in ("low", "high"))
        na, nb = (v["node"].to_numpy() for v in (low, high))
        fa, fb = (v["ok"].to_numpy() for v in (low, high))
        ok = ~(fa[:, None] & fb[None, :])
        ok &= (na[:, None] < nb[None, :]) | (t["low"][0].as_py() != t["high"][0].as_py())
        if ok.any():
            ok &= _can_be_similar(*(v["words"].combine_chunks() for v in (low, high)))
        p, q = np.nonzero(ok)
        return pa.table({"a": np.minimum(na[p], nb[q]), "b": np.maximum(na[p], nb[q])})

    sized = members.join(words.select("node", "words"), "node")
    size = members.join(words.select("node", F.size("words").alias("n")), "node").groupBy("key").agg(
        F.ceil(F.sum(F.col("n") + 64) / BLOCK).alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    met = sized.join(size, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "ok", "words")
    return met.groupBy("key", "low", "high").applyInArrow(work, "a long, b long")


def _candidates(nodes: DataFrame) -> DataFrame:
    """(key, band, node, sk, pop) of all buckets with two nodes at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sk = b.column(1).flatten().to_numpy().view(np.uint64).reshape(n, SKETCHES)
            keys = _band_keys(sk)
            yield tables.record([
                ("key", pa.int64(), keys.reshape(-1).view(np.int64)),
                ("band", pa.int32(), np.tile(np.arange(BANDS, dtype=np.int32), n)),
                ("node", pa.int64(), np.repeat(b.column(0).to_numpy(), BANDS)),
            ])

    keyed = nodes.select("node", "sk").where(F.size("sk") > 0).mapInArrow(work, "key long, band int, node long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = tables.stored(keyed.join(sizes, "key"), "near-buckets")
    pop = met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("pop"))
    out = tables.stored(met.drop("n").join(pop, "node"), "near-members")
    tables.drop(met)
    return out


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes (node, h1, h2, rep, sk)."""
    left = _candidates(nodes)
    wanted = left.select("node").distinct().join(nodes.select("node", "h1", "h2", "rep"), "node")
    texts = (
        _texts(docs).withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID)))
        .join(wanted, ["rep", "h1", "h2"]).select("node", "text")
    )
    # rows that repeat id and text stand for one node
    words = tables.stored(_words(texts).groupBy("node").agg(F.first("words").alias("words")), "near-words")
    found = []

    def compare(pairs: DataFrame) -> None:
        """Verifies the pairs (a, b) that are not links yet."""
        pairs = pairs.distinct()
        if found:
            pairs = pairs.join(reduce(DataFrame.unionByName, found), ["a", "b"], "left_anti")
        found.append(tables.stored(verified(pairs, words), "near-links"))

    lead = left.groupBy("key").agg(F.max(F.struct("pop", (-F.col("node")).alias("o"))).alias("top"))
    lead = lead.select("key", (-F.col("top.o")).alias("leader"))
    a, b = F.least("node", "leader"), F.greatest("node", "leader")
    met = tables.stored(
        left.join(lead, "key").where("node <> leader").withColumns({"a": a, "b": b}).select("key", "node", "a", "b"), "near-round")
    compare(met.select("a", "b"))
    linked = found[0].withColumn("ok", F.lit(True))
    known = met.join(linked, ["a", "b"], "left").select("key", "node", F.coalesce("ok", F.lit(False)).alias("ok"))
    yes, no = F.sum(F.col("ok").cast("long")), F.sum((~F.col("ok")).cast("long"))
    sizes = known.groupBy("key").agg(yes.alias("yes"), no.alias("no")).where("no > 0 and yes + no > 1").select(
        "key", (F.col("no") * (F.col("yes") + (F.col("no") - 1) / 2) <= WIDTH * (F.col("yes") + F.col("no"))).alias("few"))
    known = tables.stored(known.join(sizes, "key"), "near-rest")
    few = known.where("few").select("key", "node", "ok")
    other = few.select("key", F.col("node").alias("other"), F.col("ok").alias("fine"))
    # each pair with a rejected member once
    across = few.where("not ok").join(other, "key").where("node <> other and (fine or node < other)")
    compare(across.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
    compare(_across_blocks(known.where("not few").select("key", "node", "ok"), words))
    tables.drop(left, met, known, words)
    return reduce(DataFrame.unionByName, found)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, h1, h2 (hashes of the text), class_id, n_links, first.

    ``n_links`` counts the verified links of the row's text; ``first`` marks the class's representative.
    """
    docs = tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string"))
    sketched = tables.stored(_sketched(docs), "near-sketches")
    rep = sketched.groupBy("h1", "h2").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"))
    rep = tables.stored(rep.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    own = sketched.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(rep, ["h1", "h2", "rep"])
    nodes = tables.stored(own.groupBy("node", "h1", "h2", "rep").agg(F.first("sk").alias("sk")), "near-node-sketches")
    edges = links(docs, nodes)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    comp = components(edges).withColumnRenamed("id", "node")
    ids = rep.select("node", "h1", "h2", "rep").join(comp, "node", "left").join(degree, "node", "left").select(
        "h1", "h2", "rep", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    low = ids.groupBy("component").agg(F.min("rep").alias("class"))
    ids = ids.join(low, "component").select("h1", "h2", "class", "n_links")
    with_text = sketched.select("doc_id", "h1", "h2").join(ids, ["h1", "h2"])
    known = with_text.select(
        "doc_id", "h1", "h2", F.nullif(F.col("class"), F.lit(NO_ID)).alias("class_id"), "n_links",
        (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("class")).alias("first"))
    null = docs.where("text is null").select(
        "doc_id", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return known.unionByName(null)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each class."""
    got = classes(docs, doc_id, text).where("first and h1 is not null").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    body = F.col(f"`{text}`").cast("string")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(body).alias("_h1"), F.xxhash64(F.lit(SEED), body).alias("_h2"), body.isNull().alias("_none"))
    w = Window.partitionBy("_id", "_h1", "_h2").orderBy("_id")
    kept = keyed.where("not _none").join(got, ["_id", "_h1", "_h2"]).withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    return kept.select("_row.*").unionByName(keyed.where("_none").select("_row.*"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(tables.read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "first")
