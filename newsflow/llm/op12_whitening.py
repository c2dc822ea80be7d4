"""Embedding whitening by incremental eigendecomposition (operator 12).

Entry c of a vector becomes the whole number ``floor(64 * c) + 1000000``.  The scatter of the vectors about their mean is kept
as a spectrum: eigenvalues and eigenvectors, never as a matrix.

1. A task deals its vectors to up to ``LANES`` spectra that advance side by side.  The vector x after n others of mean m adds
   ``n / (n + 1) * (x - m)(x - m)'``: one centred rank-one update.
2. ``rank_one``: with ``z = Q'(x - m)`` the new eigenvalues are the roots of the secular equation
   ``1 + rho * sum(z_j^2 / (d_j - t)) = 0``, one between any two old ones.  Entries of z that vanish and equal eigenvalues are
   deflated first.  Vectors come from the z that fits the found roots exactly, so they stay orthogonal.
3. ``combine``: a spectrum is added to another by one update per eigenpair and one for the distance of the means.  Tasks'
   spectra meet in ``FAN`` tasks and then on the driver: at most ``FAN`` of d * d numbers each.
4. Rayleigh-Ritz: all tasks project their centred vectors on the eigenvectors found, the sums of products are a d * d matrix
   near a diagonal one, and its eigenvectors rotate the basis to double precision.

Sums of entries are exact whole numbers.  Memory is ``LANES`` spectra of d * d numbers and a batch.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are dropped; so are those of another length
than the longest (they have no place in its space); entries beyond 2^51 / 64 count as that bound; a component without variance
(below 1e-12 of the trace) has whitened 0 and does not count in ``identity_error``; a ``deviation`` beyond a long is null; repeated
rows count each; a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LANES = 32
LANE_ROWS = 64
FAN = 32
FLAT = 1e-12
LARGEST = 1 << 51
LONG = (1 << 63) - 1
EPS = np.finfo(float).eps

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# ---- secular equation -------------------------------------------------------------------------------------------------


def _roots(d: np.ndarray, z2: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d of the pole next to every root, distance from it) for rows of ascending d, z2 > 0 and rho.

    Bracketed iteration on two-pole rational fits; the equation is solved in the distance from the nearer pole.
    """
    n, k = d.shape
    gap = np.diff(d, axis=1)
    gap = np.concatenate([gap, (rho * z2.sum(1))[:, None]], 1)
    index = np.arange(k)

    # the sign at the middle of each interval says which pole is nearer
    pole = np.repeat(index[None, :], n, 0)
    delta = d[:, None, :] - d[:, :, None]  # [row, root, pole], from the root's left pole
    w = rho[:, None, None] * z2[:, None, :]
    middle = 1 + (w / (delta - (gap / 2)[:, :, None])).sum(2)
    right = (middle < 0) & (index < k - 1)
    pole += right
    origin = np.take_along_axis(d, pole, 1)
    delta = (d[:, None, :] - origin[:, :, None]).reshape(n * k, k)
    w = np.broadcast_to(w, (n, k, k)).reshape(n * k, k)
    half = gap.ravel() / 2
    right, last = right.ravel(), np.tile(index == k - 1, n)
    low = np.where(right, -half, np.where(middle.ravel() < 0, half, 0))
    high = np.where(right, 0, np.where(last & (middle.ravel() < 0), gap.ravel(), half))
    own = np.tile(index, n)
    below = index[None, :] <= np.arange(k)[:, None]  # poles left of a root
    x = (low + high) / 2
    todo = np.arange(n * k)
    for _ in range(80):
        i = own[todo]
        s = delta[todo] - x[todo, None]
        s[s == 0] = np.finfo(float).tiny
        f = w[todo] / s
        g = f / s
        left = below[i]
        psi, dpsi = (f * left).sum(1), (g * left).sum(1)
        phi, dphi = f.sum(1) - psi, g.sum(1) - dpsi
        value = 1 + psi + phi
        low[todo] = np.where(value < 0, x[todo], low[todo])
        high[todo] = np.where(value > 0, x[todo], high[todo])
        tight = high[todo] - low[todo] <= 2 * EPS * np.maximum(np.abs(low[todo]), np.abs(high[todo]))
        more = (np.abs(value) > 4 * k * EPS * (1 + np.abs(psi) + np.abs(phi))) & ~tight
        if not more.any():
            break
        todo, i, s, value, psi, dpsi, dphi = (v[more] for v in (todo, i, s, value, psi, dpsi, dphi))
        rows = np.arange(len(todo))
        s0 = s[rows, i]
        s1 = s[rows, np.minimum(i + 1, k - 1)]
        with np.errstate(all="ignore"):
            c = value - s0 * dpsi - s1 * dphi
            a = (s0 + s1) * value - s0 * s1 * (dpsi + dphi)
            b = s0 * s1 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            c_last = value - s0 * dpsi
            step = np.where(i == k - 1, s0 + s0 * s0 * dpsi / c_last, step)
            new = x[todo] + step
        fine = np.isfinite(new) & (new > low[todo]) & (new < high[todo])
        x[todo] = np.where(fine, new, (low[todo] + high[todo]) / 2)
    return origin, x.reshape(n, k)


def _deflated(d: np.ndarray, z: np.ndarray, q: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Turns pairs of equal eigenvalues until one of their z is 0 (in place); says which entries stay fixed."""
    n, k = d.shape
    size = np.maximum(np.abs(d).max(1), rho * (z * z).sum(1))
    tol = 8 * EPS * size
    norm = np.sqrt((z * z).sum(1))
    fixed = rho[:, None] * norm[:, None] * np.abs(z) <= tol[:, None]
    z[fixed] = 0
    if not ((np.diff(d, axis=1) <= np.sqrt(EPS) * size[:, None]).any()):
        return fixed
    lanes = np.arange(n)
    kept = np.full(n, -1)  # the last entry of each lane that is not fixed
    for j in range(k):
        live = ~fixed[:, j]
        at = np.maximum(kept, 0)
        zi, zj = z[lanes, at], z[:, j]
        r = np.hypot(zi, zj)
        r[r == 0] = 1
        c, s = zj / r, zi / r
        gap = d[:, j] - d[lanes, at]
        same = live & (kept >= 0) & (np.abs(gap * c * s) <= tol)
        if same.any():
            m = np.flatnonzero(same)
            a, cm, sm = at[m], c[m, None], s[m, None]
            qi, qj = q[m, :, a], q[m, :, j]
            q[m, :, a], q[m, :, j] = cm * qi - sm * qj, sm * qi + cm * qj
            z[m, a], z[m, j] = 0, r[m]
            di, dj = d[m, a], d[m, j]
            d[m, a], d[m, j] = di * c[m] ** 2 + dj * s[m] ** 2, di * s[m] ** 2 + dj * c[m] ** 2
            fixed[m, a] = True
        kept = np.where(live, j, kept)
    return fixed


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of ``q diag(d) q' + rho v v'`` for rows of ascending d, matrices q (eigenvectors in columns), v and rho >= 0."""
    n, k = d.shape
    z = np.einsum("nij,ni->nj", q, v)
    d, q = d.copy(), q.copy()
    fixed = _deflated(d, z, q, rho)
    # entries that move come first, ascending
    order = np.lexsort((d, fixed), axis=1)
    d, z, fixed = (np.take_along_axis(x, order, 1) for x in (d, z, fixed))
    q = np.take_along_axis(q, order[:, None, :], 2)
    most = int((~fixed).sum(1).max())
    if most:
        moves = ~fixed[:, :most]
        room = np.abs(d).max(1) + rho * (z * z).sum(1) + 1
        pad = room[:, None] * (2 + np.arange(most))
        dm = np.where(moves, d[:, :most], pad)
        z2 = np.where(moves, z[:, :most] ** 2, 0)
        real_last = moves & ~np.concatenate([moves[:, 1:], np.zeros((n, 1), bool)], 1)
        origin, x = _roots_padded(dm, z2, rho, moves)
        new = np.where(moves, origin + x, d[:, :most])
        # z that has exactly these roots
        apart = (origin[:, :, None] - dm[:, None, :]) + x[:, :, None]  # [root, pole]: root - pole
        both = moves[:, :, None] & moves[:, None, :]
        i, j = np.arange(most)[:, None], np.arange(most)[None, :]
        poles = np.where(i < j, dm[:, :, None], np.concatenate([dm[:, 1:], dm[:, -1:] + 1], 1)[:, :, None]) - dm[:, None, :]
        single = (real_last[:, :, None] & (i >= j)[None]) | ~both
        with np.errstate(all="ignore"):
            ratio = np.where(both, apart, 1) / np.where(single, 1, poles)
            zhat = np.sqrt(np.abs(ratio.prod(1))) * np.where(z[:, :most] < 0, -1, 1)
            u = np.where(both, zhat[:, None, :] / -apart, 0)  # [root, entry]
        u[~np.isfinite(u)] = 0
        u[:, np.arange(most), np.arange(most)] += ~moves
        u /= np.sqrt((u * u).sum(2))[:, :, None]
        q[:, :, :most] = q[:, :, :most] @ u.transpose(0, 2, 1)
        d[:, :most] = new
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, order, 1), np.take_along_axis(q, order[:, None, :], 2)


def _roots_padded(d: np.ndarray, z2: np.ndarray, rho: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_roots`` of lanes with different numbers of moving entries, lanes of one number together."""
    origin, x = d.copy(), np.zeros_like(d)
    count = moves.sum(1)
    for c in np.unique(count[count > 0]).tolist():
        m = np.flatnonzero(count == c)
        origin[m, :c], x[m, :c] = _roots(d[m, :c], z2[m, :c], rho[m])
    return origin, x


# ---- spectra ----------------------------------------------------------------------------------------------------------


@dataclass
class Spectra:
    """Lanes of (count, mean, eigenvalues, eigenvectors) of scatters, and the exact sum of all entries."""

    n: np.ndarray
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, lanes: int, k: int) -> Spectra:
        return cls(np.zeros(lanes), np.zeros((lanes, k)), np.zeros((lanes, k)), np.repeat(np.eye(k)[None], lanes, 0))

    def add(self, x: np.ndarray) -> None:
        """One more vector for each of the first lanes."""
        m = len(x)
        off = x - self.mean[:m]
        weight = self.n[:m] / (self.n[:m] + 1)
        self.d[:m], self.q[:m] = rank_one(self.d[:m], self.q[:m], off, weight)
        self.n[:m] += 1
        self.mean[:m] += off / self.n[:m, None]

    def one(self) -> Spectra:
        """All lanes as one."""
        x = self
        while len(x.n) > 1:
            half = (len(x.n) + 1) // 2
            a = Spectra(*(v[:half].copy() for v in (x.n, x.mean, x.d, x.q)))
            combine(a, Spectra(*(v[half:] for v in (x.n, x.mean, x.d, x.q))))
            x = a
        return x


def combine(a: Spectra, b: Spectra) -> None:
    """Adds lane i of b to lane i of a, one update per eigenpair."""
    m = len(b.n)
    d, q = a.d[:m], a.q[:m]
    for j in range(b.d.shape[1]):
        d, q = rank_one(d, q, b.q[:, :, j], np.maximum(b.d[:, j], 0))
    total = a.n[:m] + b.n
    off = b.mean - a.mean[:m]
    some = np.maximum(total, 1)
    a.d[:m], a.q[:m] = rank_one(d, q, off, a.n[:m] * b.n / some)
    a.mean[:m] += off * (b.n / some)[:, None]
    a.n[:m] = total


# ---- rows -------------------------------------------------------------------------------------------------------------


def _whole(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their whole-number vectors) of a list column."""
    off = column.offsets.to_numpy()
    size = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
    rows = np.flatnonzero(size == k) if k else np.zeros(0, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    c = flat[off[rows][:, None] + np.arange(k)[None, :]] if len(rows) else np.zeros((0, k))
    fine = np.isfinite(c).all(1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * c[fine]), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return rows[fine], x


def _vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return tables.only(df, (vec_id, "vec_id", "long"), (embedding, "v", "array<double>"))


def dimension(rows: DataFrame) -> int:
    """The longest length of a vector without null and non-finite entries; 0 if there is none."""
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~odd).agg(F.max(F.size("v"))).first()[0] or 0


def _gathered(rows: DataFrame, make: Callable[[Iterator[np.ndarray]], dict | None], merge: Callable[[dict, dict], dict], k: int) -> dict | None:
    """``make`` of every task's vectors, merged in ``FAN`` tasks and then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make(_whole(b.column(1), k)[1] for b in batches)
        if state is not None:
            yield tables.record([("part", pa.int64(), [TaskContext.get().partitionId()]), ("state", pa.binary(), [_packed(state)])])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for x in b.column(0):
                state = _unpacked(x.as_py()) if state is None else merge(state, _unpacked(x.as_py()))
        if state is not None:
            yield tables.record([("state", pa.binary(), [_packed(state)])])

    states = rows.mapInArrow(first, "part long, state binary").withColumn("part", F.pmod("part", F.lit(FAN)))
    met = states.repartition(FAN, "part").sortWithinPartitions("part").select("state").mapInArrow(second, "state binary")
    total = None
    for r in met.toLocalIterator():
        total = _unpacked(r.state) if total is None else merge(total, _unpacked(r.state))
    return total


def _packed(state: dict) -> bytes:
    """Arrays and whole numbers of any size."""
    head = json.dumps({k: list(v.shape) if isinstance(v, np.ndarray) else {"": v} for k, v in state.items()}).encode()
    body = b"".join(v.astype("<f8").tobytes() for v in state.values() if isinstance(v, np.ndarray))
    return len(head).to_bytes(8, "little") + head + body


def _unpacked(raw: bytes) -> dict:
    n = int.from_bytes(raw[:8], "little")
    head, at, out = json.loads(raw[8: 8 + n]), 8 + n, {}
    for k, v in head.items():
        if isinstance(v, dict):
            out[k] = v[""]
            continue
        size = int(np.prod(v))
        out[k] = np.frombuffer(raw, "<f8", size, at).reshape(v).copy()
        at += 8 * size
    return out


# ---- steps ------------------------------------------------------------------------------------------------------------


def _spectrum(k: int) -> Callable[[Iterator[np.ndarray]], dict | None]:
    def make(batches: Iterator[np.ndarray]) -> dict | None:
        lanes, held = None, np.zeros((0, k), np.int64)
        n, total = 0, [0] * k
        for x in batches:
            if not len(x):
                continue
            n += len(x)
            # halves of the numbers add up without overflow
            high, low = (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)
            total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high, low, strict=True)]
            if lanes is None:
                lanes = Spectra.empty(min(LANES, max(1, len(x) // LANE_ROWS)), k)
            held = np.concatenate([held, x]) if len(held) else x
            step, at = len(lanes.n), 0
            for at in range(0, len(held) - step + 1, step):
                lanes.add((held[at: at + step] - SHIFT).astype(float))
            held = held[len(held) // step * step:]
        if lanes is None:
            return None
        if len(held):
            lanes.add((held - SHIFT).astype(float))
        s = lanes.one()
        return {"n": n, "sum": total, "mean": s.mean, "d": s.d, "q": s.q}

    return make


def _met(a: dict, b: dict) -> dict:
    x, y = (Spectra(np.array([float(s["n"])]), s["mean"], s["d"], s["q"]) for s in (a, b))
    combine(x, y)
    return {"n": a["n"] + b["n"], "sum": [p + q for p, q in zip(a["sum"], b["sum"], strict=True)], "mean": x.mean, "d": x.d, "q": x.q}


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n, the difference to the whole part of the mean first."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole).astype(float) - rest


def _products(n: int, total: list[int], basis: np.ndarray) -> Callable[[Iterator[np.ndarray]], dict | None]:
    """Sums of products of the centred vectors' coordinates on ``basis``."""

    def make(batches: Iterator[np.ndarray]) -> dict | None:
        out = np.zeros((basis.shape[1], basis.shape[1]))
        for x in batches:
            y = _centred(x, n, total) @ basis
            out += y.T @ y
        return {"t": out}

    return make


@dataclass
class Whitening:
    """The fitted transform: count and sums of the fit list, components by falling eigenvalue, and their scales."""

    n: int
    total: list[int]
    basis: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    incremental: np.ndarray
    identity_error: float


def fit(rows: DataFrame, k: int, components: int = COMPONENTS) -> Whitening | None:
    found = _gathered(rows, _spectrum(k), _met, k)
    if found is None:
        return None
    n, total = found["n"], found["sum"]

    def add(a: dict, b: dict) -> dict:
        return {"t": a["t"] + b["t"]}

    basis = np.linalg.qr(found["q"][0])[0]
    ritz, turn = np.linalg.eigh(_gathered(rows, _products(n, total, basis), add, k)["t"] / n)
    basis = (basis @ turn)[:, ::-1]
    variance = np.maximum(ritz[::-1], 0)
    trace = float(variance.sum())
    top = slice(0, min(components, k))
    live = variance[top] > FLAT * trace
    scale = np.where(live, 1 / np.sqrt(np.where(live, variance[top], 1)), 0)
    weights = basis[:, top] * scale
    t = _gathered(rows, _products(n, total, weights), add, k)["t"] / n
    error = float(np.abs(t - np.diag(live.astype(float))).max()) if len(live) else 0.0
    explained = variance[top] / trace if trace else np.zeros(len(live))
    return Whitening(n, total, basis, variance, explained, weights, found["d"][0][::-1] / n, error)


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - S)^2, exact."""
    whole = np.array([s // n for s in total], np.int64)
    rest = [s % n for s in total]
    off = x - whole
    most = int(np.abs(off).max(initial=0)) + 1
    if (n * most) ** 2 * max(x.shape[1], 1) <= LONG:
        y = n * off - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]
    return [v if v <= LONG else None for v in exact]


def whitened(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component."""
    rows = _vectors(df, vec_id, embedding)
    k = dimension(rows)
    w = fit(rows, k, components) if k else None
    if w is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    top = w.weights.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _whole(b.column(1), k)
            m = len(at)
            yield tables.record([
                ("vec_id", pa.int64(), b.column(0).take(pa.array(np.repeat(at, top)))),
                ("component", pa.int32(), np.tile(np.arange(1, top + 1, dtype=np.int32), m)), ("n", pa.int64(), np.full(m * top, w.n)),
                ("deviation", pa.int64(), pa.array(_deviation(x, w.n, w.total), pa.int64()).take(pa.array(np.repeat(np.arange(m), top)))),
                ("whitened", pa.float64(), (_centred(x, w.n, w.total) @ w.weights).ravel()),
                ("explained", pa.float64(), np.tile(w.explained, m)), ("identity_error", pa.float64(), np.full(m * top, w.identity_error))])

    return rows.mapInArrow(work, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(tables.read(spark, sf_dir, "embeddings"))
