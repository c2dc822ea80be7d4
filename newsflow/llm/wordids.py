"""Token ids of whole texts, with every distinct word encoded once.

The vocabulary's tokenizer ends words at white space and between letters and signs, and its
lower-casing works letter by letter.  A text is therefore cut into pieces that the tokenizer treats
apart: runs of letters and runs of ASCII signs where a white-space separated chunk has nothing
else, and the whole chunk otherwise.  Distinct pieces are encoded by the tokenizer itself; a worker
keeps the ids of those it has met, up to ``CACHE_PIECES`` of them.
"""

from __future__ import annotations

import os

import numpy as np

from newsflow.llm import textbytes as tb

CACHE_PIECES = 1_000_000
JOINED = 1000

_WHITE, _LETTER, _SIGN, _OTHER = 0, 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, _OTHER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = _WHITE
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    for lo, hi in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
        kind[lo:hi] = _SIGN
    kind[[0x27, 0x3C]] = _OTHER  # an apostrophe may start a suffix, < a special token
    lead = np.zeros(256, bool)
    lead[0xC3:0xC6] = True  # U+00C0 to U+017F
    return kind, lead


_KIND, _LEAD = _classes()


def kinds(s: tb.Slice) -> np.ndarray:
    """What each byte is; in a chunk with anything but letters and ASCII signs every byte is OTHER."""
    b = s.buf[: s.size]
    kind = _KIND[b]
    lead = np.flatnonzero(_LEAD[b])
    if len(lead):
        after = s.buf[lead + 1]
        ok = (after >= 0x80) & (after < 0xC0) & ~((b[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        lead = lead[ok]
        kind[lead] = kind[lead + 1] = _LETTER
    start, end, _ = tb.runs(s, _KIND != _WHITE)
    other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    odd = other[end] > other[start]
    for a, z in zip(start[odd], end[odd], strict=True):
        kind[a:z] = _OTHER
    return kind


class WordIds:
    """Encodes slices with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool: list[np.ndarray] = []
        self.pooled = 0
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, s: tb.Slice, start: np.ndarray, end: np.ndarray, plain: np.ndarray, keys: np.ndarray) -> None:
        pieces = [s.raw(a, z).decode("utf-8", "replace") for a, z in zip(start, end, strict=True)]
        ids: list[np.ndarray | None] = [None] * len(pieces)
        simple = np.flatnonzero(plain)
        groups = [simple[i: i + JOINED] for i in range(0, len(simple), JOINED)]
        for g, got in zip(groups, self._encode([" ".join(pieces[i] for i in g) for g in groups]), strict=True):
            flat = np.array(got, np.uint32)
            stop = np.flatnonzero(self.ends[flat]) + 1
            if len(stop) == len(g) and stop[-1] == len(flat):
                for i, part in zip(g, np.split(flat, stop[:-1]), strict=True):
                    ids[i] = part
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, got in zip(rest, self._encode([pieces[i] for i in rest]), strict=True):
            ids[i] = np.array(got, np.uint32)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._forget()
        size = np.array([len(x) for x in ids], np.int32)
        first = self.pooled + np.cumsum(size, dtype=np.int64) - size
        self.flat = np.concatenate([self.flat, *ids])
        self.pooled = len(self.flat)
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size])[order]

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def ids(self, s: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the rows in them)."""
        kind = kinds(s)
        n = s.size
        if not n:
            return np.zeros(0, np.uint32), np.zeros(s.rows + 1, np.int64)
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[s.offsets[s.offsets < n]] = True
        bound = np.flatnonzero(new)
        full = kind[bound] != _WHITE
        start, end = bound[full], np.append(bound[1:], n)[full]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(s.rows + 1, np.int64)
        plain = kind[start] != _OTHER
        folded = s.buf.copy()
        letters = np.flatnonzero(kind == _LETTER)
        folded[letters] = tb.LOWER[folded[letters]]
        h = tb.hashes(tb.Slice(s.lo, s.hi, folded, s.offsets), start, end)
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        _, known = self._found(keys)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_PIECES:
                self._forget()
                known[:] = False
            w = where[~known]
            self._learn(s, start[w], end[w], plain[w], keys[~known])
        at, _ = self._found(keys)
        first, size = self.first[at][inverse], self.size[at][inverse].astype(np.int64)
        before = np.cumsum(size) - size
        flat = self.flat[np.repeat(first - before, size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, total[np.searchsorted(start, s.offsets)]


_KEPT: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder for this tokenizer file."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
