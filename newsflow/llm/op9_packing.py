"""Hierarchical multi-length packing (operator 9).

A document is its token ids and an end id.  What exceeds the longest context is cut off in full
windows.  The rest goes to the smallest of the ``TIERS`` it fits.  From the longest tier down, each
sequence opens with that tier's longest piece; its gap is filled with the longest pieces of shorter tiers
that fit, and closed with the head of one more piece, whose remainder goes back to its tier.  The
last sequence of a block ends at powers of two, so nothing is padded.  The sequences of a block are dealt to
step groups of ``GROUP`` sequences with balanced attention cost.

A block is a run of about ``BLOCK_TOKENS`` tokens of one input split.  Blocks are packed where they are
read: no text or id is shuffled, and memory is bounded by a block and the longest document.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null id is kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import tables
from newsflow.llm import textbytes as tb
from newsflow.llm.wordids import encoder

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
BLOCK_TOKENS = 1 << 20
GROUP = 32
SLICE = 2 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (size, [(document, start, length), …]) that hold every token of the documents once."""
    longest = tiers[-1]
    out, left = [], []  # left: (length, document, start), sorted
    for d, n in enumerate(lengths):
        whole = n // longest * longest
        out.extend((longest, [(d, s, longest)]) for s in range(0, whole, longest))
        if n > whole:
            left.append((n - whole, d, whole))
    left.sort()
    while left:
        n, d, s = left.pop()  # the longest: its tier is the highest that is not empty
        size = next(t for t in tiers if t >= n)
        parts, gap = [(d, s, n)], size - n
        while gap and left:
            at = bisect_right(left, (gap, float("inf"), 0))
            if at:
                n, d, s = left.pop(at - 1)
            else:  # even the shortest is too long: its head closes the gap
                n, d, s = left.pop(0)
                insort(left, (n - gap, d, s + gap))
                n = gap
            parts.append((d, s, n))
            gap -= n
        out.extend(_closed(parts) if gap else [(size, parts)])
    return out


def _closed(parts: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The last sequence as sequences of powers of two."""
    total = sum(p[2] for p in parts)
    out, parts = [], list(reversed(parts))
    for bit in range(total.bit_length() - 1, -1, -1):
        size = 1 << bit
        if not total & size:
            continue
        here, room = [], size
        while room:
            d, s, n = parts.pop()
            if n > room:
                parts.append((d, s + room, n - room))
                n = room
            here.append((d, s, n))
            room -= n
        out.append((size, here))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], group: int = GROUP) -> list[int]:
    """A group number for each sequence: the costliest first, dealt out there and back."""
    cost = [sum(p[2] ** 2 for p in parts) for _, parts in sequences]
    n = -(-len(sequences) // group)
    out = [0] * len(sequences)
    for k, i in enumerate(sorted(range(len(sequences)), key=lambda i: -cost[i])):
        turn, at = divmod(k, n)
        out[i] = at if turn % 2 == 0 else n - 1 - at
    return out


def packed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    path = tokenizer or default_tokenizer()

    def flush(ids: list, texts: list[np.ndarray], number: int, block: int) -> pa.RecordBatch:
        lengths = [len(t) for t in texts]
        sequences = pack(lengths, tiers)
        groups = step_groups(sequences)
        rows = [
            (d, s, n, q, size, g)
            for q, ((size, parts), g) in enumerate(zip(sequences, groups, strict=True)) for d, s, n in parts
        ]
        d, s, n, q, size, g = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        before = np.cumsum(n) - n
        offset = before - np.repeat(before[head], np.diff(np.append(head, len(q))))
        crc = [zlib.crc32(texts[a][b: b + c].tobytes()) for a, b, c, *_ in rows]
        base = number << 36 | block << 20  # a block of 2^20 tokens has fewer than 2^20 sequences
        return tables.record([
            ("doc_id", pa.int64(), [ids[i] for i in d]), ("start", pa.int64(), s), ("length", pa.int64(), n),
            ("ids_crc32", pa.int64(), crc), ("doc_tokens", pa.int64(), np.array(lengths, np.int64)[d]),
            ("sequence_id", pa.int64(), base + q), ("offset", pa.int64(), offset),
            ("tier", pa.int32(), size.astype(np.int32)), ("step_group", pa.int64(), base + g),
        ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, block = encoder(path), TaskContext.get().partitionId(), 0
        ids, texts, total = [], [], 0
        for b in batches:
            names = b.column(0).to_pylist()
            for s in tb.slices(b.column(1), most=SLICE):
                flat, at = enc.ids(s)
                for r in range(s.rows):
                    one = np.append(flat[at[r]: at[r + 1]], np.uint32(END_ID)).astype("<u4")
                    ids.append(names[s.lo + r])
                    texts.append(one)
                    total += len(one)
                    if total >= BLOCK_TOKENS:
                        yield flush(ids, texts, number, block)
                        ids, texts, total, block = [], [], 0, block + 1
        if ids:
            yield flush(ids, texts, number, block)

    return tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string")).mapInArrow(work, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(tables.read(spark, sf_dir, "documents"))
