"""Non-negative and sparse least squares for one signal, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nnls(e: np.ndarray, f: np.ndarray, eps: float = 1e-10) -> tuple[np.ndarray, float]:
    """(x >= 0, sum of squared residuals) of least squares, by the active-set method; at most 3m rounds."""
    e, f = np.asarray(e, float), np.asarray(f, float)
    m = e.shape[1]
    x, free = np.zeros(m), np.zeros(m, dtype=bool)
    gram, cross = e.T @ e, e.T @ f
    for _ in range(3 * m):
        w = cross - gram @ x
        w[free] = -np.inf
        j = int(np.argmax(w)) if m else 0
        if not m or w[j] <= eps:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(e[:, at], f, rcond=None)[0]
            if (z > eps).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= eps
            ratio = x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)
            x[at] += ratio.min() * (z - x[at])
            free[at[x[at] <= eps]] = False
            x[~free] = 0
            if not free.any():
                break
    return x, float(((e @ x - f) ** 2).sum())


def nnls_batch(e: np.ndarray, f: np.ndarray, eps: float = 1e-10, at_once: int = 4096) -> np.ndarray:
    """x >= 0 of least squares for every row of f, by nnls()'s active sets, all rows a step at a time.

    The rows share one Gram matrix; rows whose sets have one size are solved together.
    """
    e, f = np.asarray(e, float), np.atleast_2d(np.asarray(f, float))
    m, gram = e.shape[1], e.T @ e
    parts = [_nnls_rows(gram, f[k : k + at_once] @ e, eps) for k in range(0, len(f), at_once)]
    return np.concatenate(parts) if parts else np.zeros((0, m))


def _on_sets(gram: np.ndarray, cross: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Least squares on each row's set of columns, 0 elsewhere."""
    z, sizes = np.zeros_like(cross), sets.sum(1)
    for k in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == k)
        at = np.nonzero(sets[rows])[1].reshape(len(rows), k)
        g, c = gram[at[:, :, None], at[:, None, :]], cross[rows[:, None], at]
        try:
            found = np.linalg.solve(g, c[..., None])[..., 0]
        except np.linalg.LinAlgError:
            found = (np.linalg.pinv(g, hermitian=True) @ c[..., None])[..., 0]
        z[rows[:, None], at] = found
    return z


def _nnls_rows(gram: np.ndarray, cross: np.ndarray, eps: float) -> np.ndarray:
    n, m = cross.shape
    x, free, live = np.zeros((n, m)), np.zeros((n, m), dtype=bool), np.arange(n)
    for _ in range(3 * m):
        w = np.where(free[live], -np.inf, cross[live] - x[live] @ gram)
        j = w.argmax(axis=1)
        more = w[np.arange(len(live)), j] > eps
        live = live[more]
        if not len(live):
            break
        free[live, j[more]] = True
        open_ = live
        while len(open_):
            z = _on_sets(gram, cross[open_], free[open_])
            bad = free[open_] & (z <= eps)
            fine = ~bad.any(1)
            x[open_[fine]] = z[fine]
            open_, z, bad = open_[~fine], z[~fine], bad[~fine]
            old = x[open_]
            ratio = np.where(bad, old / np.maximum(old - z, 1e-300), np.inf).min(axis=1, initial=np.inf)
            new = np.where(free[open_], old + ratio[:, None] * (z - old), 0.0)
            free[open_] &= new > eps
            x[open_] = np.where(free[open_], new, 0.0)
            open_ = open_[free[open_].any(1)]
    return x


def least_squares(e: np.ndarray, f: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """x of least |Ex - f|, on all columns or on some (0 for the others)."""
    at = np.arange(e.shape[1]) if columns is None else np.asarray(columns)
    x = np.zeros(e.shape[1])
    x[at] = np.linalg.lstsq(np.asarray(e, float)[:, at], np.asarray(f, float), rcond=None)[0]
    return x


def nnls_subset(e: np.ndarray, f: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, float]:
    x = np.zeros(e.shape[1])
    x[columns], error = nnls(e[:, columns], f)
    return x, error


def nnls_robust(e: np.ndarray, f: np.ndarray, kind: str = "geman", sigma: float | None = None, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Reweighted NNLS with Geman-McClure or Tukey weights; sigma defaults to the median absolute residual."""
    x, error = nnls(e, f)
    for _ in range(rounds):
        r = np.abs(e @ x - f)
        s = sigma or 1.4826 * np.median(r) or 1e-12
        w = s**2 / (s**2 + r**2) if kind == "geman" else np.where(r < s, 1 - (r / s) ** 2, 0.0)
        new, _ = nnls(e * w[:, None], f * w)
        if np.abs(new - x).max() < 1e-10:
            break
        x = new
    return x, float(((e @ x - f) ** 2).sum())


def nnsls(e: np.ndarray, f: np.ndarray, sparsity: float) -> tuple[np.ndarray, float]:
    """(x, RMSE) of NNLS with one row more of sqrt(sparsity) and target 0."""
    x, _ = nnls(np.vstack([e, np.full(e.shape[1], np.sqrt(sparsity))]), np.append(f, 0.0))
    return x, float(np.sqrt(((e @ x - f) ** 2).mean()))


def nnsls_pgs(e: np.ndarray, f: np.ndarray, sparsity: float, mu: float = 0.0, outer: int = 100, inner: int = 5, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Projected Gauss-Seidel on 0.5|Ex - f|^2 + sparsity * sum(x) + 0.5 mu |x|^2: full sweeps, then sweeps of the positive ones."""
    gram, cross = e.T @ e, e.T @ f
    d = np.maximum(np.diag(gram) + mu, 1e-300)
    x = np.zeros(e.shape[1])
    for _ in range(outer):
        old = x.copy()
        for j in range(len(x)):
            x[j] = max(0.0, x[j] + (cross[j] - gram[j] @ x - sparsity - mu * x[j]) / d[j])
        for _ in range(inner):
            for j in np.flatnonzero(x > 0):
                x[j] = max(0.0, x[j] + (cross[j] - gram[j] @ x - sparsity - mu * x[j]) / d[j])
        if np.sqrt(((x - old) ** 2).mean()) < tolerance:
            break
    return x, float(np.sqrt(((e @ x - f) ** 2).mean()))


def nnsls_batch(e: np.ndarray, f: np.ndarray, sparsity: float) -> np.ndarray:
    """x of nnsls() for every row of f."""
    return nnls_batch(np.vstack([e, np.full(e.shape[1], np.sqrt(sparsity))]), np.hstack([f, np.zeros((len(f), 1))]))


def pgs_batch(e: np.ndarray, f: np.ndarray, sparsity: float, mu: float = 0.0, outer: int = 100, inner: int = 5, tolerance: float = 1e-10, at_once: int = 1024) -> np.ndarray:
    """x of nnsls_pgs() for every row of f: the same sweeps, a column of all rows at a time; a row that stands leaves."""
    gram = e.T @ e
    d = np.maximum(np.diag(gram) + mu, 1e-300)
    out = np.zeros((len(f), e.shape[1]))
    for lo in range(0, len(f), at_once):
        cross = (f[lo : lo + at_once] @ e).T - sparsity  # columns first: a coordinate of all rows is one run of numbers
        live, x = np.arange(cross.shape[1]), np.zeros(cross.shape)
        for _ in range(outer):
            old = x.copy()
            for j in range(len(x)):
                x[j] = np.maximum(0.0, x[j] + (cross[j] - gram[j] @ x - mu * x[j]) / d[j])
            for _ in range(inner):
                swept = x > 0
                for j in np.flatnonzero(swept.any(axis=1)):
                    x[j] = np.where(swept[j], np.maximum(0.0, x[j] + (cross[j] - gram[j] @ x - mu * x[j]) / d[j]), x[j])
            moves = np.sqrt(((x - old) ** 2).mean(axis=0)) >= tolerance
            out[lo + live] = x.T
            if not moves.any():
                break
            live, x, cross = live[moves], x[:, moves], cross[:, moves]
    return out


def standardize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of mean 0 and norm 1, the means, the norms)."""
    mean = x.mean(0)
    norm = np.linalg.norm(x - mean, axis=0)
    return (x - mean) / np.where(norm > 0, norm, 1), mean, norm


def lars(x: np.ndarray, y: np.ndarray, bound: float, positive: bool = False, least_correlation: float = 0.0) -> np.ndarray:
    """Least angle regression with the lasso's drops, up to an L1 norm of `bound` (or down to a largest correlation).

    positive: only columns of positive correlation enter and coefficients stay >= 0.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    m = x.shape[1]
    beta, active = np.zeros(m), []
    for _ in range(8 * max(m, 1)):
        c = x.T @ (y - x @ beta)
        score = c.copy() if positive else np.abs(c)
        idle = [j for j in range(m) if j not in active]
        top = max([score[j] for j in idle], default=-np.inf)
        if active:
            top = max(top, max(abs(c[j]) for j in active))
        if top <= max(least_correlation, 1e-12):
            break
        if not dropped_last(active, score, top) and idle:
            j = max(idle, key=lambda k: score[k])
            if score[j] >= top - 1e-9 * max(1.0, top):
                active.append(j)
        a = np.array(active)
        sign = np.ones(len(a)) if positive else np.sign(c[a])
        xa = x[:, a] * sign
        g = np.linalg.lstsq(xa.T @ xa, np.ones(len(a)), rcond=None)[0]
        scale = 1 / np.sqrt(max(g.sum(), 1e-300))
        w = scale * g
        u = xa @ w
        slope = x.T @ u
        cmax = np.abs(c[a]).max()
        step, enters = cmax / scale, None
        for j in range(m):
            if j in active:
                continue
            for num, den in ((cmax - c[j], scale - slope[j]), *(() if positive else ((cmax + c[j], scale + slope[j]),))):
                if den > 1e-12 and 1e-12 < num / den < step:
                    step, enters = num / den, j
        move = w * sign
        leaves = None
        for k, j in enumerate(active):
            if beta[j] * move[k] < 0 and -beta[j] / move[k] < step:
                step, leaves, enters = -beta[j] / move[k], j, None
        if least_correlation > 0 and scale > 0 and (cmax - least_correlation) / scale < step:
            step, leaves, enters, final = (cmax - least_correlation) / scale, None, None, True
        else:
            final = False
        now = np.abs(beta).sum()
        trial = beta.copy()
        trial[a] += step * move
        if np.abs(trial).sum() > bound:
            room = (bound - now) / max(np.abs(trial).sum() - now, 1e-300)
            beta[a] += room * step * move
            break
        beta = trial
        if final:
            break
        if leaves is not None:
            beta[leaves] = 0
            active.remove(leaves)
        elif enters is None:
            break
    return np.maximum(beta, 0) if positive else beta


def dropped_last(active: list[int], score: np.ndarray, top: float) -> bool:
    """Whether all columns that could enter are in already."""
    return bool(active) and all(j in active for j in np.flatnonzero(score >= top - 1e-9 * max(1.0, top)))


def nn_lars(x: np.ndarray, y: np.ndarray, least_correlation: float) -> np.ndarray:
    """Non-negative LARS that stops where no column outside correlates more than `least_correlation`."""
    return lars(x, y, np.inf, positive=True, least_correlation=least_correlation)


def nn_lars_scaled(x: np.ndarray, s: np.ndarray, mu: float, tolerance: float = 1e-6, most: int = 200) -> tuple[np.ndarray, float]:
    """Non-negative LARS with a scale of the target that is fitted along; stops after `most` rounds at the latest."""
    k = 1.0
    for _ in range(most):
        beta = nn_lars(x, k * s, mu)
        new = float((x @ beta) @ s + mu) / float(s @ s + mu)
        if abs(new - k) <= tolerance:
            break
        k = new
    return beta, k


def ternary_search(f: Callable, low: float, high: float, rounds: int = 100) -> float:
    for _ in range(rounds):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if f(a) < f(b):
            high = b
        else:
            low = a
    return (low + high) / 2


def bfgs(f: Callable, gradient: Callable, x: np.ndarray, tolerance: float = 1e-8, most: int = 200) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent: rank-two update of the inverse Hessian, step by bracketing and ternary search."""
    x = np.array(x, float)
    h, g = np.eye(len(x)), gradient(x)
    for _ in range(most):
        if np.abs(g).max() < tolerance:
            break
        p = -h @ g
        if p @ g >= 0:
            h, p = np.eye(len(x)), -g
        top = 1.0
        while f(x + 2 * top * p) < f(x + top * p) and top < 1e6:
            top *= 2
        t = ternary_search(lambda a, x=x, p=p: f(x + a * p), 0.0, 2 * top)
        s = t * p
        new = x + s
        gn = gradient(new)
        y = gn - g
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            v = np.eye(len(x)) - r * np.outer(s, y)
            h = v @ h @ v.T + r * np.outer(s, s)
        x, g = new, gn
    return x, float(f(x))


SOLVERS = {
    "nnls": lambda e, f, lam: nnls(e, f)[0],
    "nnsls": lambda e, f, lam: nnsls(e, f, lam)[0],
    "pgs": lambda e, f, lam: nnsls_pgs(e, f, lam)[0],
    "lars": lambda e, f, lam: nn_lars(e, f, lam),
    "geman": lambda e, f, lam: nnls_robust(e, f, "geman")[0],
    "tukey": lambda e, f, lam: nnls_robust(e, f, "tukey", max(3 * np.std(f), 1e-9))[0],
}


BATCHES = {"nnls": lambda e, f, lam: nnls_batch(e, f), "nnsls": nnsls_batch, "pgs": pgs_batch}  # solvers of many signals at once
