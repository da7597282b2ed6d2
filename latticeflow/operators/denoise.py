"""Image filters on one slice or volume, applied per group: each slice is one array of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward differences along rows and columns, the last two axes; 0 at the far edges."""
    r, c = np.zeros_like(f), np.zeros_like(f)
    r[..., :-1, :], c[..., :-1] = f[..., 1:, :] - f[..., :-1, :], f[..., 1:] - f[..., :-1]
    return r, c


def back_divergence(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Minus the adjoint of forward()."""
    d = np.zeros_like(r)
    d[..., 0, :], d[..., 1:-1, :], d[..., -1, :] = r[..., 0, :], r[..., 1:-1, :] - r[..., :-2, :], -r[..., -2, :]
    e = np.zeros_like(c)
    e[..., 0], e[..., 1:-1], e[..., -1] = c[..., 0], c[..., 1:-1] - c[..., :-2], -c[..., -2]
    return d + e


def total_variation(g: np.ndarray, lam: float, data: str = "l2", huber: float = 0.0, rounds: int = 5000, tolerance: float = 1e-9, callback: Callable[[np.ndarray], None] | None = None) -> np.ndarray:
    """Primal-dual minimiser of TV(u) (Huber-smoothed if huber > 0) + lam / 2 |u - g|^2, or lam |u - g|_1.

    g is an image or a stack of images, each filtered by itself; rounds go on until the last of them stands.
    callback is shown the image after each round.
    """
    if min(g.shape[-2:]) < 2:
        return g.astype(float)
    outer, shape = g.shape, (*g.shape[-2:], g.size // (g.shape[-2] * g.shape[-1]))
    last = lambda x: np.moveaxis(x.reshape(shape[2], *shape[:2]), 0, 2)
    first = lambda x: np.moveaxis(x, 2, 0).reshape(outer).copy()
    g = np.ascontiguousarray(last(g.astype(float)))  # images last: a step along either side is one long run of numbers
    u, bar = g.copy(), g.copy()
    p, q, po, qo, old, d, e = (np.zeros(shape) for _ in range(7))
    tau = sigma = 1 / np.sqrt(8)
    pull = tau * lam * g
    step = lambda x, y: np.abs(np.subtract(x, y, out=d), out=d).max()
    for _ in range(rounds):
        p, po, q, qo, u, old = po, p, qo, q, old, u
        np.subtract(bar[1:], bar[:-1], out=d[:-1])
        np.subtract(bar[:, 1:], bar[:, :-1], out=e[:, :-1])
        d[-1], e[:, -1] = 0, 0
        for now, was, gap in ((p, po, d), (q, qo, e)):
            np.multiply(gap, sigma, out=gap)
            np.add(was, gap, out=now)
            if huber:
                now /= 1 + sigma * huber
        np.multiply(p, p, out=d)
        np.multiply(q, q, out=e)
        d += e
        np.sqrt(d, out=d)
        np.maximum(d, 1, out=d)
        p /= d
        q /= d
        np.add(p, q, out=d)  # minus the adjoint of forward(); the far edges of p and q are 0
        d[1:] -= p[:-1]
        d[:, 1:] -= q[:, :-1]
        d *= tau
        d += old
        if data == "l2":
            d += pull
            np.divide(d, 1 + tau * lam, out=u)
        else:
            u[:] = g + np.sign(d - g) * np.maximum(np.abs(d - g) - tau * lam, 0)
        np.multiply(u, 2, out=bar)
        bar -= old
        if callback is not None:
            callback(first(u))
        if step(u, old) < tolerance and step(p, po) < tolerance and step(q, qo) < tolerance:
            break
    return first(u)


def total_generalized_variation(g: np.ndarray, lam: float, first: float = 1.0, second: float = 2.0, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Second-order TGV with an L2 data term: first * |grad u - w| + second * |sym grad w| + lam / 2 |u - g|^2; of an image or a stack of them."""
    if min(g.shape[-2:]) < 2:
        return g.astype(float)
    u, ub = g.astype(float).copy(), g.astype(float).copy()
    w, wb = np.zeros((2, *g.shape)), np.zeros((2, *g.shape))
    p, q = np.zeros((2, *g.shape)), np.zeros((3, *g.shape))
    tau = sigma = 1 / np.sqrt(12)
    for _ in range(rounds):
        r, c = forward(ub)
        p += sigma * np.stack([r - wb[0], c - wb[1]])
        p /= np.maximum(1, np.sqrt((p**2).sum(0)) / first)
        (ar, ac), (br, bc) = forward(wb[0]), forward(wb[1])
        q += sigma * np.stack([ar, bc, (ac + br) / 2])
        q /= np.maximum(1, np.sqrt(q[0] ** 2 + q[1] ** 2 + 2 * q[2] ** 2) / second)
        uo, wo = u, w
        u = (u + tau * (back_divergence(p[0], p[1]) + lam * g)) / (1 + tau * lam)
        w = w + tau * np.stack([p[0] + back_divergence(q[0], q[2]), p[1] + back_divergence(q[2], q[1])])
        ub, wb = 2 * u - uo, 2 * w - wo
        if np.abs(u - uo).max() < tolerance:
            break
    return u


def robust_weight(r2: np.ndarray, kind: str, scale: float = 2.0) -> np.ndarray:
    """Weight of squared residuals: Geman-McClure, Tukey (none over the scale), or 1."""
    if kind == "geman":
        return scale**2 / (scale + r2) ** 2
    if kind == "tukey":
        return np.where(r2 < scale, (1 - r2 / scale) ** 2, 0.0)
    return np.ones_like(r2)


def robust(img: np.ndarray, lam: float, kind: str = "geman", scale: float = 2.0, data_scale: float | None = None, rounds: int = 30) -> np.ndarray:
    """Membrane smoothing of an image or volume (last axis: channels, if ndim is 4) with a line process on differences.

    data_scale: robust weights on the data term too, so that outliers let go.
    """
    z = img.astype(float).copy()
    axes = range(min(3, img.ndim))
    for _ in range(rounds):
        m = 1.0 if data_scale is None else robust_weight(channel_sum((z - img) ** 2), kind, data_scale)
        num, den = (m if data_scale is None else spread(m, img)) * img, (m if data_scale is None else spread(m, img)) * np.ones_like(z)
        for a in axes:
            if z.shape[a] < 2:
                continue
            lo, hi = [slice(None)] * z.ndim, [slice(None)] * z.ndim
            lo[a], hi[a] = slice(None, -1), slice(1, None)
            lo, hi = tuple(lo), tuple(hi)
            w = lam * spread(robust_weight(channel_sum((z[hi] - z[lo]) ** 2), kind, scale), z[lo])
            num[lo] += w * z[hi]
            den[lo] += w
            num[hi] += w * z[lo]
            den[hi] += w
        new = num / np.maximum(den, 1e-300)
        if np.abs(new - z).max() < 1e-9:
            break
        z = new
    return z


def channel_sum(x: np.ndarray) -> np.ndarray:
    return x.sum(-1) if x.ndim == 4 else x


def spread(w: np.ndarray, like: np.ndarray) -> np.ndarray:
    return w[..., None] if like.ndim == 4 else w


FILTERS: dict[str, Callable] = {
    "tv_l2": lambda g, lam: total_variation(g, lam, "l2"),
    "tv_l1": lambda g, lam: total_variation(g, lam, "l1", tolerance=1e-5),
    "huber_l2": lambda g, lam: total_variation(g, lam, "l2", huber=0.05, tolerance=1e-4),
    "tgv_l2": lambda g, lam: total_generalized_variation(g, lam),
    "robust": lambda g, lam: robust(g, lam),
    "robust_or": lambda g, lam: robust(g, lam, data_scale=2.0),
}


STACKED = ("tv_l2", "tv_l1", "huber_l2", "tgv_l2")
BUNDLE = 16


def filter_slices(voxels: DataFrame, value: str, name: str, lam: float, by: list[str] | None = None) -> DataFrame:
    """(by, row, col, filtered): one filter over each slice.

    A group is up to BUNDLE neighbouring slices, where `slice` is among the keys: those of one shape go through
    the rounds together.  A slice with missing voxels has its mean there.
    """
    by = by or ["slice"]
    spec = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in [*by, "row", "col"])
    keys = ["__bundle" if k == "slice" and name in STACKED else k for k in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        images, places = [], []
        for _, at in sorted(pdf.groupby(by).indices.items()):
            own = pdf.iloc[at]
            r, c = own["row"].to_numpy(), own["col"].to_numpy()
            g = np.full((r.max() + 1, c.max() + 1), own[value].mean())
            g[r, c] = own[value].to_numpy()
            images.append(g)
            places.append((at, r, c))
        filtered = np.empty(len(pdf))
        for shape in {g.shape for g in images}:
            same = [i for i, g in enumerate(images) if g.shape == shape]
            stack = FILTERS[name](np.stack([images[i] for i in same]), lam) if name in STACKED else [FILTERS[name](images[i], lam) for i in same]
            for i, u in zip(same, stack, strict=True):
                at, r, c = places[i]
                filtered[at] = u[r, c]
        return pdf[[*by, "row", "col"]].assign(filtered=filtered)

    rows = voxels.select(*by, "row", "col", value, *([F.floor(F.col("slice") / BUNDLE).alias("__bundle")] if "__bundle" in keys else []))
    tasks = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes cost much work, so they are not coalesced
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, f"{spec}, filtered double")
