"""Spatial regularisation of basis coefficients, and denoising of signals by aligning their neighbours.

All sites are updated at once in a round (Jacobi); inside a site the coefficients are swept in turn.  Rounds
are settled in the shared folder; one number a round comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assignment, harmonics, models, solvers
from ..functions import vectors as V
from . import graph
from .neighbours import KEY, OFFSETS6, OFFSETS26, meeting, shifted

AHEAD = [(0, 0, -1), (0, -1, 0), (-1, 0, 0)]  # what stands one place on is seen from one place back
NEAR_DEGREES = 5.0
TOGETHER = 1 << 20
Progress = Callable[[int, DataFrame], None]


def spread_matrix(directions: np.ndarray, degrees: float = NEAR_DEGREES) -> np.ndarray:
    """|cos| of axes nearer than an angle to one another, 0 for the others."""
    d = np.asarray(directions, float)
    d = d / np.linalg.norm(d, axis=1, keepdims=True)
    c = np.abs(d @ d.T)
    return np.where(c > math.cos(math.radians(degrees)), c, 0.0)


def basis_edges(voxels: DataFrame, directions: np.ndarray) -> DataFrame:
    """(voxel, at, w): in both directions, 1 - d / largest of the squared distance of a voxel's alpha to the spread one of the next voxel along an axis."""
    spread = spread_matrix(directions)

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        return pd.Series(((x - y @ spread) ** 2).sum(1))

    rows = voxels.select(*KEY, V.doubles("alpha").alias("alpha"), F.struct(*KEY).alias("at"))
    pairs = graph.settle(meeting(rows, shifted(rows, ["alpha", "at"], AHEAD)).select("at", "n_at", apart("alpha", "n_alpha").alias("d")))
    top = pairs.agg(F.max("d")).first()[0] or 0.0
    w = (1 - F.col("d") / top) if top > 1e-6 else F.lit(1.0)
    one = pairs.select("at", F.col("n_at").alias("from"), w.alias("w"))
    both = one.unionByName(one.select(F.col("from").alias("at"), F.col("at").alias("from"), "w"))
    return both.select(*[F.col(f"at.{k}").alias(k) for k in KEY], F.col("from").alias("at"), "w")


def _around(now: DataFrame, edges: DataFrame) -> DataFrame:
    """(voxel, near): weights and coefficients of the neighbours, at most six, in the order of their places."""
    rows = now.select(F.struct(*KEY).alias("at"), F.col("alpha").alias("n"))
    return edges.join(rows.hint("merge"), "at").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "w", "n"))).alias("near"))


def _rounds(voxels: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], update: Callable, rounds: int, stop: float, callback: Progress | None) -> DataFrame:
    """Rounds of update(alpha, cross, wpt, sums of w * alpha, sums of w), a row for each voxel of a batch, until the mean squared change is at most stop."""
    spec = "slice int, row int, col int, alpha array<double>, cross array<double>, wpt array<double>, moved double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            old, cross, wpt = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("alpha", "cross", "wpt"))
            wa, w = np.zeros_like(old), np.zeros(len(old))
            for i, (weights, alphas) in enumerate(zip(pdf["w"], pdf["n"], strict=True)):
                if weights is not None:
                    wa[i], w[i] = np.asarray(weights) @ np.stack(alphas), np.sum(weights)
            new = update(old.copy(), cross, wpt, wa, w)
            yield pdf[[*KEY, "cross", "wpt"]].assign(alpha=list(new), moved=((new - old) ** 2).mean(1))[[*KEY, "alpha", "cross", "wpt", "moved"]]

    now = last = graph.settle(voxels.select(*KEY, V.doubles("alpha").alias("alpha"), "cross", "wpt"))
    fixed = graph.settle(edges) if isinstance(edges, DataFrame) else None
    for k in range(rounds):
        if callback is not None:
            callback(k, now.select(*KEY, "alpha"))
        near = _around(now, fixed if fixed is not None else edges(now))
        new = graph.settle(now.join(near.hint("merge"), KEY, "left").select(*KEY, "alpha", "cross", "wpt", F.col("near.w").alias("w"), F.col("near.n").alias("n")).mapInPandas(run, spec))
        graph.discard(last)
        last, now = new, new.drop("moved")
        if (new.agg(F.avg("moved")).first()[0] or 0.0) <= stop:
            break
    return now.select(*KEY, "alpha")


def prepared(voxels: DataFrame, phi: np.ndarray, directions: np.ndarray, tensor: str | None = None) -> DataFrame:
    """(voxel, alpha, cross, wpt): the signal's products with the basis, and weights of the directions by a tensor column (0 without one)."""

    @F.pandas_udf("array<double>")
    def products(s0: pd.Series, dw: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(y, float) / (s or 1.0) @ phi for s, y in zip(s0, dw, strict=True)])

    table = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in np.asarray(directions, float)])
    wpt = V.projection_weights(F.col(tensor), table) if tensor else F.array_repeat(F.lit(0.0), len(directions))
    return voxels.select(*KEY, "alpha", products("s0", "dw").alias("cross"), wpt.alias("wpt"))


def regularize(voxels: DataFrame, phi: np.ndarray, directions: np.ndarray, spread: float, mu: float, rounds: int = 100, stop: float = 1e-12, callback: Progress | None = None) -> DataFrame:
    """(voxel, alpha >= 0): non-negative least squares of each voxel with its neighbours' pull mu, and a bonus of `spread` for coefficients that differ.

    voxels: alpha, s0 and dw.  The normal equations of a voxel are those of the signal, plus spread times the
    centring matrix, plus mu for each of the six neighbours that are there.
    """
    gram = phi.T @ phi + spread * (np.eye(phi.shape[1]) - 1.0 / phi.shape[1])

    def update(a, cross, wpt, wa, w):
        for x in np.unique(w):  # voxels with as many neighbours share their matrix
            a[w == x] = solvers.nnls_batch(gram + mu * x * np.eye(a.shape[1]), (cross + mu * wa)[w == x])
        return a

    rows = voxels.select(*KEY, F.struct(*KEY).alias("at"))
    edges = meeting(rows.select(*KEY), shifted(rows, ["at"], OFFSETS6)).select(*KEY, F.col("n_at").alias("at"), F.lit(1.0).alias("w"))
    return _rounds(prepared(voxels, phi, directions), edges, update, rounds, stop, callback)


def robust_smooth(voxels: DataFrame, phi: np.ndarray, directions: np.ndarray, smooth: float, weight: float = 0.0, bonus: float = 0.0, tensor: str | None = None, edges: DataFrame | None = None, rounds: int = 1000, inner: int = 4, stop: float = 1e-8, callback: Progress | None = None) -> DataFrame:
    """(voxel, alpha >= 0): `inner` sweeps of coordinate descent a round, pulled to the neighbours by edge weights.

    weight: of the directions' weights by the tensor; bonus: taken from the diagonal, and the mean
    coefficient's share of it from the right side.
    """
    gram = phi.T @ phi
    own = np.diag(gram)

    def update(a, cross, wpt, wa, w):
        mean = a.mean(1)
        den = own + smooth * w[:, None] + weight * wpt - bonus
        for _ in range(inner):
            for k in range(a.shape[1]):
                others = a @ gram[k] - a[:, k] * own[k]
                a[:, k] = np.maximum(0.0, (cross[:, k] - others + smooth * wa[:, k] - bonus * mean) / den[:, k])
        return a

    return _rounds(prepared(voxels, phi, directions, tensor), basis_edges(voxels, directions) if edges is None else edges, update, rounds, stop, callback)


def mixed_smooth(voxels: DataFrame, phi: np.ndarray, directions: np.ndarray, smooth: float, tensor: str | None = None, edges: DataFrame | None = None, rounds: int = 1000, inner: int = 4, stop: float = 1e-8, callback: Progress | None = None) -> DataFrame:
    """(voxel, alpha >= 0): as robust_smooth(), with the pull mixed over near directions and the spread of coefficients rewarded."""
    gram, q, gini = phi.T @ phi, models.smoothing_matrix(np.asarray(directions, float)), models.gini_matrix(phi.shape[1])

    def update(a, cross, wpt, wa, w):
        same, b = gram - smooth * gini, (cross + smooth * wa) @ q.T
        for _ in range(inner):
            for k in range(a.shape[1]):
                own = same[k, k] + smooth * (w * q[k, k] + wpt[:, k])
                others = a @ same[k] + smooth * (w * (a @ q[k]) + wpt[:, k] * a[:, k]) - a[:, k] * own
                a[:, k] = np.maximum(0.0, (b[:, k] - others) / own)
        return a

    return _rounds(prepared(voxels, phi, directions, tensor), basis_edges(voxels, directions) if edges is None else edges, update, rounds, stop, callback)


def regularize_in_steps(voxels: DataFrame, phi: np.ndarray, directions: np.ndarray, tensor: str, first: float = 4.5e-2, steps: int = 3, mixed: bool = False, rounds: int = 1000, stop: float = 1e-8, callback: Progress | None = None) -> DataFrame:
    """(voxel, alpha): steps of smoothing with a weight that grows by `first` each time and edges taken anew from what the step before gave."""
    now, data = voxels, voxels.drop("alpha")
    for k in range(1, steps + 1):
        lam = first * k
        if mixed:
            alpha = mixed_smooth(now, phi, directions, lam, tensor, rounds=rounds, stop=stop, callback=callback)
        else:
            alpha = robust_smooth(now, phi, directions, lam, lam, lam, tensor, rounds=rounds, stop=stop, callback=callback)
        now = data.join(alpha.hint("merge"), KEY)
    return now.select(*KEY, "alpha")


def denoise_aligned(signals: DataFrame, gradients: np.ndarray, lmax: int = 8) -> DataFrame:
    """(voxel, dw, errors): each signal made anew from the half of its neighbours whose shapes align best with its own.

    A signal's shape is its amplitude along each gradient and the opposite one.  Neighbours are aligned by
    iterated closest points; the shape and those up to the middle error are fitted with harmonics, whose
    mean gives the amplitudes.  errors: of the alignments, neighbours in the order of their places.

    Voxels go through it together, as many as have about TOGETHER distances between points to compare.
    """
    g = np.asarray(gradients, float)
    n, basis = len(g), harmonics.design(g, lmax)
    step = max(1, TOGETHER // (len(OFFSETS26) * n * n))

    def shapes(y: np.ndarray) -> np.ndarray:
        return y[:, :, None] * g  # the opposite points go without saying

    def fit(points: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(points, axis=2)
        design = harmonics.design(points.reshape(-1, 3), lmax).reshape(len(points), n, -1)
        least = np.finfo(float).eps * max(design.shape[1:])
        return (np.linalg.pinv(design, rcond=least) @ size[:, :, None])[:, :, 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                some = pdf.iloc[lo : lo + step]
                near = [x if x is not None else [] for x in some["near"]]
                counts = np.array([len(x) for x in near])
                own, of = shapes(np.stack(some["dw"].to_numpy()).astype(float)), np.repeat(np.arange(len(some)), counts)
                others = np.array([np.asarray(y, float) for x in near for y in x]).reshape(-1, n)
                aligned, errors = assignment.axial_icp(shapes(others), own[of])
                errors = np.split(errors, np.cumsum(counts)[:-1])
                kept = np.concatenate([e <= np.sort(np.append(e, np.inf))[(len(e) + 1) // 2] for e in errors])
                coefs, voxel = fit(np.concatenate([own, aligned[kept]])), np.append(np.arange(len(some)), of[kept])
                total = np.zeros((len(some), coefs.shape[1]))
                np.add.at(total, voxel, coefs)
                mean = total / np.bincount(voxel)[:, None]
                yield some[KEY].assign(dw=list(mean @ basis.T), errors=errors)

    rows = signals.select(*KEY, V.doubles("dw").alias("dw"), F.struct(*KEY).alias("at"))
    near = shifted(rows, ["dw", "at"], OFFSETS26).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("n_at", "n_dw"))).alias("n"))
    joined = rows.select(*KEY, "dw").join(near.hint("merge"), KEY, "left").select(*KEY, "dw", F.col("n.n_dw").alias("near"))
    return graph.spread(joined, *KEY).mapInPandas(run, "slice int, row int, col int, dw array<double>, errors array<double>")
