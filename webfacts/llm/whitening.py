"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 12).

Vectors become whole numbers on a fixed grid. The leading eigenvectors of their covariance are found without forming it: a
block of trial vectors goes through a polynomial of the covariance that damps the unwanted part of the spectrum, then QR
and Rayleigh-Ritz turn the block towards the eigenvectors, until the residuals certify them. Every step of the
polynomial recurrence is one distributed pass over the rows, the centred product XᵀXQ; only matrices of (dimensions
x block) reach the driver. A few Lanczos steps beforehand bound the low end of the spectrum, so that the
polynomial need not damp where there is nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.llm.common import stored

COMPONENTS = 8
#: Width of the block beyond the wanted components, degree of the polynomial, and the passes that bound the spectrum.
GUARD = 24
DEGREE = 12
BOUND_STEPS = 10
ROUNDS = 40
#: Residual at once accepted, and the most that is accepted when rounds no longer halve it, relative to the first eigenvalue.
SHARP, CERTIFIED = 2e-14, 1e-10
SCALE, SHIFT = 1024.0, 100000
#: Scaled entries are held within this, so that every grid value is exact as a double.
REACH = float(2**51)
BATCH = 4096


def grid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, x``: the vectors without null or non-finite entries as whole numbers, written once."""
    v = F.col(vector)
    whole = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    on_grid = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), c.cast("double") * SCALE))).cast("long") + SHIFT)
    return stored(vectors.filter(whole).select(F.col(vec_id).alias("id"), on_grid.alias("x")))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            part = whole.slice(start, BATCH)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Rows:
    """The fit list: rows of one dimension with exact sums, and distributed products with their centred matrix."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows.filter(F.size("x") == dim), dim
        places = self.rows.select(F.posexplode("x").alias("i", "c"))
        low = F.lit(2**20 - 1)
        sums = places.groupBy("i").agg(F.sum(F.shiftright("c", 20)).alias("high"), F.sum(F.col("c").bitwiseAND(low)).alias("low"), F.count(F.lit(1)).alias("n"), F.max(F.abs("c")).alias("most"))
        found = sorted(sums.collect())  # one row per dimension
        self.n = found[0].n
        self.sums = [(r.high << 20) + r.low for r in found]
        self.most = max(r.most for r in found)
        self.exact = self.n * self.most < 2**61

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S / n in double precision; the difference is taken in whole numbers where they fit."""
        n, mean = self.n, np.array([s / self.n for s in self.sums])
        if not self.exact:
            return lambda x: x - mean
        sums = np.array(self.sums, np.int64)
        return lambda x: (x * n - sums) / n

    def summed(self, partial: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
        """Sum over all rows of ``partial(centred block)``, a matrix of ``height`` x ``width``; partition sums meet row by row in a shuffle."""
        dim, centred = self.dim, self.centred()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for _, x in _matrices(batches, dim):
                total += partial(centred(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *[pa.array(total[:, k].copy()) for k in range(width)]], names=["i", *[f"y{k}" for k in range(width)]])

        parts = self.rows.select("x").mapInArrow(run, ", ".join(["i int", *[f"y{k} double" for k in range(width)]]))
        out = np.zeros((height, width))
        for r in parts.groupBy("i").agg(*[F.sum(f"y{k}").alias(f"y{k}") for k in range(width)]).collect():  # ``height`` rows
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V: one pass XᵀX q over the centred rows."""
        return self.summed(lambda x: x.T @ (x @ q), self.dim, q.shape[1]) / self.n


def lower_bound(times: Callable[[np.ndarray], np.ndarray], dim: int, steps: int = BOUND_STEPS) -> float:
    """A bound below the spectrum: smallest Ritz value of a few Lanczos steps less the norm of what they left."""
    v = np.random.default_rng(12).standard_normal(dim)
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, dim)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0] - beta[-1]))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` that is small on [low, high] and one at ``top``, applied to ``q``."""
    half, centre = (high - low) / 2, (high + low) / 2
    first = half / (top - centre)
    scale, before = first, q
    now = (times(q) - centre * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix behind ``times``."""
    width = min(dim, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(21).standard_normal((dim, width)))[0]
    low, last = None, np.inf
    for _ in range(ROUNDS):
        y = times(q)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        top = abs(values[0])
        residual = np.linalg.norm(y - q * values, axis=0)[:wanted].max()
        if width == dim or top == 0 or residual <= SHARP * top or (residual <= CERTIFIED * top and residual > last / 2):
            break
        last = residual
        low = lower_bound(times, dim) if low is None else low
        high = max(values[-1], low + 1e-9 * top)
        if values[0] <= high * (1 + 1e-12):
            break  # a flat spectrum: every direction is as good
        q = np.linalg.qr(filtered(times, q, low, high, values[0], degree))[0]
    else:
        raise ArithmeticError(f"no certified eigenvectors after {ROUNDS} rounds: residual {residual:.3g} of {top:.3g}")
    signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(width)])
    return values[:wanted], (q * signs)[:, :wanted]


def _deviations(x: np.ndarray, n: int, sums: list[int], exact: bool) -> pa.Array:
    """Exact sums of (n x - S)^2; null where the sum is no long."""
    if exact:
        off = x * n - np.array(sums, np.int64)
        if float(np.abs(off.astype(np.float64)).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return pa.array((off * off).sum(axis=1))
    rows = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in rows], pa.int64())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """One row per usable vector and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Null vectors and vectors with null or non-finite entries are dropped. Where lengths differ, the most frequent length
    (of equally frequent ones the greater) is the fit list and the others are dropped too. Components whose
    eigenvalue is zero up to rounding cannot be whitened and are left out, so a single row, equal rows or empty vectors
    give no rows, as does an empty table. Repeated ids are separate rows, a null id is kept. Scaled entries beyond
    2^51 are held there; ``deviation`` is null where it exceeds a long. Other columns are not read.
    """
    schema = f"`{vec_id}` {vectors.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = grid(vectors, vec_id, vector)
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None or usual.dim == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = Rows(rows, usual.dim)
    trace = float(fit.summed(lambda x: (x * x).sum(axis=0)[:, None], fit.dim, 1).sum()) / fit.n
    wanted = min(components, fit.dim)
    values, vectors_ = leading(fit.times, fit.dim, wanted, guard, degree)
    kept = int((values > trace * 1e-12).sum()) if trace > 0 else 0
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    values = values[:kept]
    project = vectors_[:, :kept] / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ project
        return np.hstack([w.T @ w, w.sum(axis=0)[:, None]])

    found = fit.summed(moments, kept, kept + 1) / fit.n
    covariance = found[:, :kept] - np.outer(found[:, kept], found[:, kept])
    error = float(np.abs(covariance - np.eye(kept)).max())
    explained = values / trace
    dim, n, sums, exact, centred = fit.dim, fit.n, fit.sums, fit.exact, fit.centred()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dim, 1):
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(take), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)),
                    _deviations(x, n, sums, exact).take(take), pa.array((centred(x) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                ],
                names=[vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.rows.select("id", "x").mapInArrow(run, schema)
