"""Words of many texts at once, on their UTF-8 bytes.

An Arrow string column is one byte buffer with row offsets.  Words are runs of bytes of a class;
a word is known by a 64-bit hash of its bytes (words of up to eight bytes never collide).
Batches are cut into slices of bounded bytes, so memory depends on the slice and on the longest
text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# byte classes
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
VISIBLE = np.ones(256, bool)  # [^\x20\x09-\x0D]
VISIBLE[0x20] = False
VISIBLE[0x09:0x0E] = False

KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[0x41:0x5B] += 32

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@dataclass
class Slice:
    """Rows ``lo`` to ``hi`` of a batch; ``buf`` has eight spare bytes after the last row."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def row_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))

    def raw(self, start: int, end: int) -> bytes:
        return self.buf[start:end].tobytes()


def slices(column: pa.Array, fold: np.ndarray = KEEP_CASE, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; a null is an empty text.  ``fold`` maps every byte."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset: col.offset + n + 1]
    if col.null_count:  # the bytes under a null are not text
        size = np.where(np.asarray(col.is_valid()), np.diff(offsets), 0)
    else:
        size = np.diff(offsets)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        if col.null_count:
            parts = [all_bytes[offsets[i]: offsets[i] + size[i]] for i in range(lo, hi)]
            body = np.concatenate(parts)
        else:
            body = all_bytes[offsets[lo]: offsets[hi]]
        buf = np.zeros(len(body) + 8, np.uint8)
        np.take(fold, body, out=buf[: len(body)])
        yield Slice(lo, hi, buf, at[lo: hi + 1] - at[lo])
        lo = hi


def runs(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each row and their number) of runs of bytes of a class."""
    m = inside[s.buf[: s.size]]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(s.rows + 1, np.int64)
    before = np.concatenate([[False], m[:-1]])
    after = np.concatenate([m[1:], [False]])
    edge = s.offsets[(s.offsets > 0) & (s.offsets < s.size)]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hashes(s: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every run, eight bytes a step."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(s.buf) - 7,), np.dtype("<u8"), s.buf, 0, (1,))
    size = ends - starts
    h = eight[starts] & _MASK[np.minimum(size, 8)]
    h = mix(h)
    at, left = starts + 8, size - 8
    todo = np.flatnonzero(left > 0)
    while len(todo):
        part = eight[at[todo]] & _MASK[np.minimum(left[todo], 8)]
        h[todo] = mix(h[todo] * np.uint64(31) + part + np.uint64(0x9E3779B97F4A7C15))
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    return h


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every k consecutive words that lie in one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x100000001B3) + h[i: i + n])
    ok = np.ones(n, bool)
    for i in range(1, k):  # a window must not run over the end of a row
        e = first[1:-1] - i
        ok[e[(e >= 0) & (e < n)]] = False
    at = np.flatnonzero(ok)
    return out[at], at


def row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def occurrence(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many equal ones stand before it in its row, how many equal ones its row has)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    rank = np.arange(len(h)) - head[group]
    count = np.diff(np.concatenate([head, [len(h)]]))[group]
    nth, total = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    nth[order], total[order] = rank, count
    return nth, total
