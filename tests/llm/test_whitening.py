"""Whitening by incremental eigendecomposition against a plain one."""

import math

import numpy as np
import pytest

from brute import SF
from newsflow.llm import op12_whitening as op


def plain(vectors, components=op.COMPONENTS):
    """(n, deviations, whitened, explained) of whole-number vectors from their covariance matrix."""
    n, k = len(vectors), len(vectors[0])
    total = [sum(v[i] for v in vectors) for i in range(k)]
    deviation = [sum((n * v[i] - total[i]) ** 2 for i in range(k)) for v in vectors]
    off = np.array([[(n * v[i] - total[i]) / n for i in range(k)] for v in vectors])
    e, q = np.linalg.eigh(off.T @ off / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return n, deviation, off @ q / np.sqrt(e), e / (off**2).sum() * n


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def table(rows, k):
    """{vec_id: [rows by component]}."""
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, []).append(r)
    assert all(len(x) == k for x in out.values())
    return {i: sorted(x, key=lambda r: r.component) for i, x in out.items()}


def test_the_whole_table(spark):
    vectors = {r.vec_id: whole(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviation, white, explained = plain(list(vectors.values()))
    got = table(op.op12_whitening(spark, SF).collect(), 32)
    assert set(got) == set(vectors)
    mine = np.array([[r.whitened for r in got[i]] for i in vectors])
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-8
    for i, d in zip(vectors, deviation, strict=True):
        assert {(r.n, r.deviation) for r in got[i]} == {(n, d)}
        assert np.allclose([r.explained for r in got[i]], explained, rtol=1e-9)
        assert max(r.identity_error for r in got[i]) < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-90, 90, 6) / 64], "x") for i in range(40)]
    rows += [(100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 6, "x"),
             (103, [float("inf")] * 6, "x"), (104, [], "x"), (105, [1.0], "x"), (None, rows[0][1], "x"), rows[1], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    kept = [whole(v) for i, v, _ in rows if i is None or i < 100]
    n, deviation, white, explained = plain(kept)
    for each in (df, df.repartition(9), df.coalesce(1)):
        got = op.whitened(each).collect()
        assert len(got) == 6 * len(kept) and {r.n for r in got} == {n}
        assert sorted({r.deviation for r in got}) == sorted(set(deviation))
        assert max(r.identity_error for r in got) < 1e-9
        by = {r.component: r.explained for r in got}
        assert np.allclose([by[c] for c in range(1, 7)], explained, rtol=1e-9)
    assert op.whitened(df.limit(0)).count() == 0
    same = op.whitened(df.where("vec_id = 1")).collect()  # three equal rows: no variance at all
    assert {(r.whitened, r.deviation, r.identity_error) for r in same} == {(0.0, 0, 0.0)}
    large = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in op.whitened(large).where("vec_id < 3").collect()} == {None}


@pytest.mark.parametrize("case", ["plain", "equal rows", "flat", "one dimension", "clustered"])
def test_updates_keep_the_spectrum(case):
    rng = np.random.default_rng(5)
    x = rng.integers(-30, 30, (90, 1 if case == "one dimension" else 12)).astype(float)
    if case == "equal rows":
        x[20:60] = x[0]
    if case == "flat":
        x[:, 5], x[:, 6] = 7, x[:, 2]
    if case == "clustered":
        x = np.repeat(np.eye(12), 10, 0)[rng.permutation(120)]
    s = op.Spectra.empty(3, x.shape[1])
    for i in range(0, len(x), 3):
        s.add(x[i: i + 3])
    one = s.one()
    m = x - x.mean(0)
    d, q = one.d[0], one.q[0]
    size = max(d.max(), 1)
    assert (np.diff(d) >= -1e-12 * size).all() and np.allclose(q.T @ q, np.eye(len(d)), atol=1e-13)
    assert np.allclose(q @ np.diag(d) @ q.T, m.T @ m, atol=1e-12 * size)
    assert np.allclose(one.mean[0], x.mean(0))
