"""Alignment of two tokenizers by merge-path partitioning (operator 13).

Both tokenizers cut the same bytes, a space and the text.  The ends of the A tokens and of the B tokens of a slice are
two sorted lists of byte places.

1. ``merge_path``: the merge of the two lists is a path through their grid.  Every ``WORK`` steps a diagonal crosses it;
   all diagonals search their crossing by bisection at once.  The pieces between crossings are independent and of
   equal work.
2. Pieces merge side by side, one step each at a time.  A step that uses up an end emits the overlap of the A and the B token
   that meet there; an end of B equal to the A end used before it emits nothing and closes a group.
3. ``stitched``: pieces number their groups from 0; what a piece leaves open goes on in the next one.
4. The links of about ``CHUNK_LINKS`` links of texts are one row: its distinct id pairs with their counts, and for every
   link the place of its pair among them.  The pairs add up over the corpus, each B id's highest count is found, and every
   chunk gets the counts of its own pairs back.

Texts are encoded by the two libraries themselves, cut at spaces where neither can join what lies on both sides: before a
single space with a visible character behind it.  A worker keeps the ids of up to ``CACHE_PIECES`` distinct parts.

No text and no id is shuffled: only distinct pairs of chunks, and the packed pair places once.

Defined cases: a null or empty text, and one whose tokens don't spell it, has zeros and ''; repeated rows count each;
a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

WORK = 64
CHUNK_LINKS = 1 << 21
CACHE_PIECES = 400_000
SLICE = 1 << 20

SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_CHUNK = (
    "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "sha array<string>, places binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) where every ``work``-th diagonal crosses the merge of two sorted lists; equal values are taken from a first."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, diagonal - low
        mid = (low[open_] + high[open_]) >> 1
        # a[mid] comes before b[diagonal - mid - 1]: the crossing lies behind it
        after = a[mid] <= b[diagonal[open_] - mid - 1]
        low[open_] = np.where(after, mid + 1, low[open_])
        high[open_] = np.where(after, high[open_], mid)


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, and (A token, B token) that close every group, from the two lists of ends."""
    i, j = merge_path(a, b, work)
    stop = np.diff(np.append(i + j, len(a) + len(b)))[: len(i)]
    stop[-1] = 0
    pieces = np.flatnonzero(stop)
    i, j, left = i[pieces], j[pieces], stop[pieces]
    n = len(pieces)
    end = np.iinfo(np.int64).max
    a1, b1 = np.append(a, end), np.append(b, end)
    at_a, at_b = np.zeros((n, work), np.int64), np.zeros((n, work), np.int64)
    what = np.zeros((n, work), np.int8)  # 1 an overlap, 2 a closed group
    for k in range(work if n else 0):
        live = left > k
        from_a = live & (a1[i] <= b1[j])
        # the A end before i was used up earlier, maybe by the piece before this one
        closes = live & ~from_a & (i > 0) & (a1[i - 1] == b1[j])
        at_a[:, k], at_b[:, k] = i - closes, j
        what[:, k] = np.where(closes, 2, live)
        i += from_a
        j += live & ~from_a
    link, close = what == 1, what == 2
    return at_a[link], at_b[link], at_a[close], at_b[close]


def stitched(n_links: int, link_a: np.ndarray, close_a: np.ndarray) -> np.ndarray:
    """The group of every overlap: what pieces leave open belongs to the group that the next closing end closes."""
    return np.searchsorted(close_a, link_a) if n_links else np.zeros(0, np.int64)


class Vocabulary:
    """Bytes and sizes of a tokenizer's ids."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray, n: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Whether the next ``n`` ids spell each part."""
        owner = np.repeat(np.arange(len(parts)), n)
        want = np.fromiter(map(len, parts), np.int64, len(parts))
        good = np.bincount(owner, self.size[ids], len(parts)).astype(np.int64) == want
        use = ids[good[owner]]
        got = _gathered(self.pool, self.first[use], self.size[use])
        same = got == np.frombuffer(b"".join([p for p, g in zip(parts, good.tolist(), strict=True) if g]), np.uint8)
        wrong = np.bincount(np.repeat(np.flatnonzero(good), want[good])[~same], minlength=len(parts)) > 0
        return good & ~wrong

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(self.pool[self.first[i]: self.first[i] + self.size[i]].tobytes() for i in ids)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, the rest from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(0x100 + k): x for k, x in enumerate(rest)}


class Pair:
    """Both tokenizers and the parts met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, vocab = _byte_letters(), self.a.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            names[i] = name
        self.va = Vocabulary([bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names])
        self.vb = Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])
        self._forget()

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode("utf-8") for p in parts]
        got = [
            [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)],
            self.b.encode([t[1:] for t in texts], num_threads=1),
        ]
        for p in parts:
            self.known[p] = len(self.known)
        good = np.ones(len(parts), bool)
        for k, v in enumerate((self.va, self.vb)):
            n = np.fromiter(map(len, got[k]), np.int64, len(parts))
            ids = np.fromiter(chain.from_iterable(got[k]), np.int32, int(n.sum()))
            good &= v.spell(ids, n, parts)
            self.first[k] = np.concatenate([self.first[k], len(self.ids[k]) + np.cumsum(n) - n])
            self.n[k] = np.concatenate([self.n[k], n])
            self.ids[k] = np.concatenate([self.ids[k], ids])
        self.good = np.concatenate([self.good, good])

    def encode(self, parts: list[bytes]) -> np.ndarray:
        """The number of every part."""
        new = list(dict.fromkeys(p for p in parts if p not in self.known))
        if new:
            if len(self.known) + len(new) > CACHE_PIECES or len(self.ids[0]) > 16 * CACHE_PIECES:
                self._forget()
                new = list(dict.fromkeys(parts))
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))


_KEPT: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """The worker's two tokenizers."""
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Pair(path_a, path_b)
    return _KEPT[path_a, path_b]


# a byte after which a cut before a space is safe: visible ASCII, or the first byte of a letter that is no white space in any plane
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True


def parts(s: tb.Slice) -> tuple[list[bytes], np.ndarray]:
    """The parts of all texts of a slice, each with a space before it, and the first part of every row."""
    b, n = s.buf, s.size
    space = b[:n] == 0x20
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[1: n - 1] = space[1:-1] & (b[: n - 2] != 0x20) & _VISIBLE[b[2:n]]
    cut[s.offsets] = False  # a text's first part gets a space of its own
    edge = s.offsets[(s.offsets > 1) & (s.offsets <= n)] - 1
    cut[edge] = False  # nothing of this text follows its last byte
    head = cut.copy()
    head[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
    start = np.flatnonzero(head[:n])
    stop = np.append(start[1:], n)
    raw = b[:n].tobytes()
    out = [raw[x:y] if c else b" " + raw[x:y] for x, y, c in zip(start.tolist(), stop.tolist(), cut[start].tolist(), strict=True)]
    return out, np.searchsorted(start, s.offsets)


def _gathered(pool: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``pool[first: first + n]`` in one row."""
    before = np.cumsum(n) - n
    return pool[np.repeat(first - before, n) + np.arange(int(n.sum()))]


_DIGIT = np.array([10**k for k in range(9, -1, -1)], np.int64)


def _written(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with its mark behind it, as one row of bytes, and where each begins."""
    width = 1 + np.searchsorted(_DIGIT[::-1][1:], ids, "right")
    size = width + 1
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    left = ids.astype(np.int64)
    for k in range(int(width.max()) if len(ids) else 0):
        has = width > k
        out[(first + width - 1 - k)[has]] = 0x30 + (left % 10)[has]
        left //= 10
    out[first + width] = mark
    return out, np.append(first, len(out))


def aligned(s: tb.Slice, both: Pair) -> dict:
    """Per row: counts and digests; per link: its row and ids."""
    part, first = parts(s)
    number = both.encode(part)
    owner = np.repeat(np.arange(s.rows), np.diff(first))
    odd = np.bincount(owner[~both.good[number]], minlength=s.rows) > 0
    use = ~odd[owner]
    number, owner = number[use], owner[use]
    ids, row, ends = [], [], []
    for k, v in enumerate((both.va, both.vb)):
        n = both.n[k][number]
        ids.append(_gathered(both.ids[k], both.first[k][number], n))
        row.append(np.repeat(owner, n))
        ends.append(np.cumsum(v.size[ids[k]]))
    link_a, link_b, close_a, close_b = merged(ends[0], ends[1])
    n_groups = np.bincount(row[0][close_a], minlength=s.rows)
    # the A ids of a group, then its B ids: an A id stands behind all B ids of earlier groups, a B id behind all A ids up to its group
    group_a = np.searchsorted(close_a, np.arange(len(ids[0])))
    group_b = np.searchsorted(close_b, np.arange(len(ids[1])))
    a_until, b_until = close_a + 1, np.concatenate([[0], close_b + 1])
    place_a = np.arange(len(ids[0])) + b_until[group_a]
    place_b = np.arange(len(ids[1])) + a_until[group_b]
    every, mark = np.zeros(len(ids[0]) + len(ids[1]), np.int64), np.full(len(ids[0]) + len(ids[1]), ord(","), np.uint8)
    every[place_a], every[place_b] = ids[0], ids[1]
    mark[place_a[close_a]], mark[place_b[close_b]] = ord("|"), ord(";")
    text, begin = _written(every, mark)
    raw = text.tobytes()
    n_a, n_b = np.bincount(row[0], minlength=s.rows), np.bincount(row[1], minlength=s.rows)
    upto = begin[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    sha = [hashlib.sha256(raw[x: y - 1]).hexdigest() if y > x else "" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "sha": sha, "row": row[0][link_a], "group": stitched(len(link_a), link_a, close_a),
        "a": ids[0][link_a], "b": ids[1][link_b]}


def _chunks(docs: DataFrame, path_a: str, path_b: str, chunk_links: int) -> DataFrame:
    """The links of runs of documents, coded by their chunk's distinct pairs, the commonest first."""

    def row_of(number: int, count: int, held: list[tuple]) -> pa.RecordBatch:
        names, n_a, n_b, n_groups, n_links, sha, code = zip(*held, strict=True)
        pairs, place, n = np.unique(np.concatenate(code), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        packed = rank[place].astype("<u4").view(np.uint8).reshape(-1, 4).T  # all low bytes first: they compress well apart
        a, b = (pairs[order] >> 32).astype(np.int32), (pairs[order] & 0xFFFFFFFF).astype(np.int32)

        def one(values, kind: pa.DataType) -> pa.Array:
            return pa.array([values], pa.list_(kind))

        lists = [np.concatenate(x) for x in (n_a, n_b, n_groups, n_links)]
        cols = [
            pa.array([number << 32 | count], pa.int64()), one([x for k in names for x in k], pa.int64()),
            *[one(x, pa.int64()) for x in lists], one([x for k in sha for x in k], pa.string()),
            pa.array([zlib.compress(np.ascontiguousarray(packed).tobytes(), 1)], pa.binary()),
            one(a, pa.int32()), one(b, pa.int32()), one(n[order], pa.int64())]
        return pa.RecordBatch.from_arrays(
            cols, names=["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "places", "pair_a", "pair_b", "pair_n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, count, held, links = pair(path_a, path_b), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for s in tb.slices(batch.column(1), most=SLICE):
                x = aligned(s, both)
                n_links = np.bincount(x["row"], minlength=s.rows)
                held.append((
                    names[s.lo: s.hi], x["n_a"], x["n_b"], x["n_groups"], n_links, x["sha"],
                    x["a"].astype(np.int64) << 32 | x["b"]))
                links += len(x["row"])
                if links >= chunk_links:
                    yield row_of(number, count, held)
                    count, held, links = count + 1, [], 0
        if held:
            yield row_of(number, count, held)

    return docs.mapInArrow(work, _CHUNK)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, total, best) of the corpus from (a, b, n) of chunks."""
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return total.select("a", "b", "total", (F.col("total") == F.max("total").over(Window.partitionBy("b"))).alias("best"))


def alignment(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None,
    chunk_links: int = CHUNK_LINKS,
) -> tuple[DataFrame, DataFrame]:
    """(one row per document, the corpus's id pairs with their counts)."""
    path_a, path_b = tokenizers or default_tokenizers()
    plain = tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string"))
    chunks = tables.stored(_chunks(plain, path_a, path_b, chunk_links), "aligned-chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    counts = tables.stored(pair_counts(pairs), "pair-counts")
    back = pairs.join(counts, ["a", "b"]).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "total", "best"))).alias("known"))
    joined = chunks.drop("pair_a", "pair_b", "pair_n").join(back, "chunk", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield _summed(batch.slice(r, 1))

    return joined.mapInArrow(work, SCHEMA), counts


def _values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).flatten()


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per document of a chunk."""
    n_links = _values(batch, "n_links").to_numpy()
    planes = np.frombuffer(zlib.decompress(batch.column("places")[0].as_py()), np.uint8).reshape(4, -1)
    place = np.ascontiguousarray(planes.T).view("<u4").ravel()
    known = batch.column("known").flatten()
    at, total, best = (known.field(k).to_numpy(zero_copy_only=False) for k in ("at", "total", "best"))
    counts, top = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
    counts[at], top[at] = total, best
    bound = np.concatenate([[0], np.cumsum(n_links)])
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[place])])[bound]) for v in (top, counts)]
    return tables.record([
        ("doc_id", pa.int64(), _values(batch, "ids")), *[(k, pa.int64(), _values(batch, k)) for k in ("n_a", "n_b", "n_groups", "n_links")],
        ("n_best", pa.int64(), sums[0]), ("count_sum", pa.int64(), sums[1]), ("groups_sha256", pa.string(), _values(batch, "sha"))])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(tables.read(spark, sf_dir, "documents"))[0]
