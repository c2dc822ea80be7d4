"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brute import ODD_TEXTS, SF
from newsflow.llm import op13_alignment as op


@pytest.fixture(scope="module")
def both():
    return op.Pair(*op.default_tokenizers())


def plain(rows, both):
    """The contract, token by token."""
    out, links = [], []
    for doc, text in rows:
        mine = []
        body = (" " + (text or "")).encode()
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if not text or both.va.spelled(a) != body or both.vb.spelled(b) != body:
            out.append((doc, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum(both.va.size[a]).tolist(), np.cumsum(both.vb.size[b]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        of_a, of_b = defaultdict(list), defaultdict(list)
        for x, g in zip(a, group_a.tolist(), strict=True):
            of_a[g].append(str(x))
        for x, g in zip(b, group_b.tolist(), strict=True):
            of_b[g].append(str(x))
        groups = [",".join(of_a[g]) + "|" + ",".join(of_b[g]) for g in range(len(shared))]
        i = j = start = 0
        for end in sorted(set(ends_a) | set(ends_b)):
            while ends_a[i] <= start:
                i += 1
            while ends_b[j] <= start:
                j += 1
            mine.append((a[i], b[j]))
            start = end
        out.append((doc, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(mine)
    count = Counter(x for m in links for x in m)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (d, na, nb, ng, len(m), sum(count[x] == top[x[1]] for x in m), sum(count[x] for x in m), sha)
        for (d, na, nb, ng, sha), m in zip(out, links, strict=True)]


ODD = [
    *ODD_TEXTS, " leading", "two  spaces", "a \n b", "x   y z", "\n \n y", "tab\t x", "привет мир, как дела", "a▁b c", "<|endoftext|> <s> </s>",
    "don't we'll  it's", "е　 я", "日本 語 テキスト", "\x00 \x01 a", "🙂 🙂🙂 x", " ", "   ", "a ", "a  ", "ﬁ ½", "é ö", "x" * 3000, "   a b",
]


def test_odd_rows(spark, both):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, places string")
    want = sorted(plain(rows, both), key=str)
    for df in (docs, docs.repartition(7)):
        assert sorted((tuple(r) for r in op.alignment(df, chunk_links=50)[0].collect()), key=str) == want
    assert op.alignment(docs.limit(0))[0].count() == 0


def test_documents(spark, both, texts):
    got = sorted(tuple(r) for r in op.op13_alignment(spark, SF).collect())
    assert got == sorted(plain(sorted(texts.items()), both))


@pytest.mark.parametrize("work", [1, 2, 7, 64])
def test_pieces_merge_as_a_whole(work):
    rng = np.random.default_rng(work)
    for n in (0, 1, 5, 300):
        ends = np.sort(rng.choice(np.arange(1, 4 * n + 2), 2 * n, False)) if n else np.zeros(0, np.int64)
        a = np.sort(rng.choice(ends, n, False)) if n else ends
        b = np.sort(rng.choice(ends, n, False)) if n else ends
        if n:
            a[-1] = b[-1] = ends[-1] + 1
        i, j = op.merge_path(a, b, work)
        assert (np.diff(i + j) <= work).all() and (i[-1], j[-1]) == (len(a), len(b))
        link_a, link_b, close_a, _ = op.merged(a, b, work)
        every = np.union1d(a, b)
        assert link_a.tolist() == np.searchsorted(a, every).tolist() and link_b.tolist() == np.searchsorted(b, every).tolist()
        assert a[close_a].tolist() == np.intersect1d(a, b).tolist()
