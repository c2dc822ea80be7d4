"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
ODD_TEXTS = [
    None, "", "", " \n\t ", "...", "one", "ONE two", "one two\nthree four", LONG, LONG, "日本語 テキスト です", "a\x00b c\u0301d é",
    "same text of six words here", "same text of six words here",
]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def decontaminated(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 12) if v else 0):
            win = v[i: i + 13]
            for k in range(len(w) - len(win) + 1):
                if w[k: k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add("" if item is None else str(item))
    names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), names, bool(hit) and 20 * len(hit) >= len(w)


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if tri[tuple(w[i: i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (
        n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
        n < 50 or 100 * len(again) > 50 * n)


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = words(t)
        if w:
            out[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def near_classes(texts, similarity=0.8):
    """Connected components of equal texts and of set similarity."""
    sets, parent = shingle_sets(texts), {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids, by = sorted(texts), defaultdict(list)
    for i in ids:
        if texts[i] is not None:
            by[texts[i]].append(i)
    pairs = [(v[0], x) for v in by.values() for x in v[1:]]
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    near = {(a, b) for v in inverted.values() for k, a in enumerate(v) for b in v[k + 1:]}
    pairs += [(a, b) for a, b in near if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}
