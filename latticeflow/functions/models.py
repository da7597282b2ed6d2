"""Diffusion models of one voxel: tensors of rank 2 and 4, orientation bases, deconvolution, grouping."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import harmonics, linalg, solvers
from .assignment import emd

FLOOR = 1e-8


def monomials(rank: int) -> list[tuple[int, int, int]]:
    return [(a, b, rank - a - b) for a in range(rank, -1, -1) for b in range(rank - a, -1, -1)]


@dataclass
class TensorModel:
    """Log-linear fit of a symmetric tensor of even rank: ln(S / S0) = -b sum mult * g^k * D_k."""

    b: float
    gradients: np.ndarray
    rank: int = 2

    def __post_init__(self):
        if self.rank % 2:
            raise ValueError("the rank must be even")
        g = np.asarray(self.gradients, float)
        self.powers = monomials(self.rank)
        mult = [math.factorial(self.rank) // (math.factorial(i) * math.factorial(j) * math.factorial(k)) for i, j, k in self.powers]
        self.design = np.stack([m * g[:, 0] ** i * g[:, 1] ** j * g[:, 2] ** k for m, (i, j, k) in zip(mult, self.powers, strict=True)], 1) * -self.b
        self.inverse = linalg.pseudo_inverse(self.design)

    def solve(self, s0: float, s: np.ndarray) -> np.ndarray:
        return self.inverse @ (np.log(np.maximum(s, FLOOR)) - math.log(max(s0, FLOOR)))

    def matrix(self, coefs: np.ndarray) -> np.ndarray:
        d = dict(zip(self.powers, coefs, strict=True))
        get = lambda i, j: d[tuple(sum(1 for q in (i, j) if q == k) for k in range(3))]
        return np.array([[get(i, j) for j in range(3)] for i in range(3)])

    def voxel(self, s0: float, s: np.ndarray) -> dict:
        """voxels() of one."""
        return {k: x[0].tolist() if x.ndim > 1 else float(x[0]) for k, x in self.voxels(np.array([s0], float), np.asarray(s, float)[None]).items()}

    def voxels(self, s0: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        """Eigenvalues (ascending), principal direction, mean diffusivity and FA of many signals at once; NaN where a signal is below the floor."""
        if self.rank != 2:
            raise ValueError("eigenvalues are of rank 2")
        fine = (s0 >= FLOOR) & (s >= FLOOR).all(1)
        logs = np.log(np.maximum(s, FLOOR)) - np.log(np.maximum(s0, FLOOR))[:, None]
        coefs = logs @ self.inverse.T
        at = {p: k for k, p in enumerate(self.powers)}
        index = np.array([[at[tuple((i == k) + (j == k) for k in range(3))] for j in range(3)] for i in range(3)])
        values, vectors = np.linalg.eigh(coefs[:, index])
        md = values.mean(1)
        size = np.linalg.norm(values, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            fa = np.minimum(math.sqrt(1.5) * np.linalg.norm(values - md[:, None], axis=1) / size, 1.0)
        out = {"ev": values, "pdd": vectors[:, :, -1], "md": md, "fa": fa}
        for x in out.values():
            x[~fine] = np.nan
        return out


def tensor(direction: np.ndarray, longitudinal: float, transversal: float) -> np.ndarray:
    d = np.asarray(direction, float) / np.linalg.norm(direction)
    return transversal * np.eye(3) + (longitudinal - transversal) * np.outer(d, d)


def signal(fractions, tensors, gradients: np.ndarray, b) -> np.ndarray:
    """Sum of f exp(-b g'Dg) at each gradient; b is a number or one for each gradient."""
    g = np.asarray(gradients, float)
    return sum(f * np.exp(-np.asarray(b) * np.einsum("ni,ij,nj->n", g, d, g)) for f, d in zip(fractions, tensors, strict=True))


def rician(s: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return np.hypot(s + sigma * rng.standard_normal(len(s)), sigma * rng.standard_normal(len(s))) if sigma > 0 else s


def basis(gradients: np.ndarray, directions: np.ndarray, b: float, longitudinal: float, transversal: float) -> np.ndarray:
    """Gradients x directions: the signal of an axisymmetric tensor along each direction."""
    g, d = np.asarray(gradients, float), np.asarray(directions, float)
    d = d / np.linalg.norm(d, axis=1, keepdims=True)
    n2 = (g * g).sum(1)[:, None]
    return np.exp(-b * ((longitudinal - transversal) * (g @ d.T) ** 2 + transversal * n2))


def odf(fractions, tensors, directions: np.ndarray) -> np.ndarray:
    """Orientation distribution sum f / sqrt(det D d'D^-1 d), scaled to sum 1."""
    d = np.asarray(directions, float)
    out = sum(f / np.sqrt(np.linalg.det(t) * np.einsum("ni,ij,nj->n", d, np.linalg.inv(t), d)) for f, t in zip(fractions, tensors, strict=True))
    return out / out.sum() if out.sum() else out


def fit_basis(s: np.ndarray, phi: np.ndarray, solver: str = "nnls", sparsity: float = 0.0, refit: bool = False) -> tuple[np.ndarray, float, float]:
    """(coefficients, SSE, RMSE) with the named solver; refit: NNLS on the columns it kept."""
    x = solvers.SOLVERS[solver](phi, np.asarray(s, float), sparsity)
    if refit and (x > 1e-9).any():
        x, _ = solvers.nnls_subset(phi, s, np.flatnonzero(x > 1e-9))
    sse = float(((phi @ x - s) ** 2).sum())
    return x, sse, math.sqrt(sse / len(s))


def fit_bases(s: np.ndarray, phi: np.ndarray, solver: str = "nnls", sparsity: float = 0.0, refit: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit_basis() for every row of s: (coefficients, SSE, RMSE).  Solvers that have a form for batches go through all rows together; a refit of NNLS changes nothing."""
    if solver not in solvers.BATCHES or refit and solver != "nnls":
        found = [fit_basis(y, phi, solver, sparsity, refit) for y in s]
        return np.array([x for x, _, _ in found]).reshape(len(s), phi.shape[1]), np.array([e for _, e, _ in found]), np.array([r for _, _, r in found])
    x = solvers.BATCHES[solver](phi, s, sparsity)
    sse = ((x @ phi.T - s) ** 2).sum(axis=1)
    return x, sse, np.sqrt(sse / s.shape[1])


def centroid(directions: np.ndarray, alpha: np.ndarray, members: list[int]) -> tuple[np.ndarray, float]:
    """(unit weighted mean with signs aligned to the heaviest member, sum of |dot| * alpha)."""
    lead = directions[max(members, key=lambda i: alpha[i])]
    rows = directions[members]
    rows = rows * np.where(rows @ lead < 0, -1, 1)[:, None]
    mean = alpha[members] @ rows
    mean /= max(np.linalg.norm(mean), 1e-300)
    return mean, float(alpha[members] @ np.abs(rows @ mean))


def group(alpha: np.ndarray, directions: np.ndarray, near: list[set[int]], over: float = 0.0, most: int = 5) -> list[list[int]]:
    """Groups grown from the largest coefficients over neighbouring directions; at most `most` members each."""
    free, out = {i for i in np.flatnonzero(alpha > over).tolist()}, []
    while free:
        seed = max(free, key=lambda i: (alpha[i], -i))
        members, rim = [seed], sorted(near[seed] & free - {seed}, key=lambda i: -alpha[i])
        free.discard(seed)
        while rim and len(members) < most:
            i = rim.pop(0)
            if i in free:
                free.discard(i)
                members.append(i)
                rim = sorted(set(rim) | (near[i] & free), key=lambda j: -alpha[j])
        out.append(members)
    return out


def neighbourhoods(directions: np.ndarray, k: int | None = None, most: float | None = None) -> list[set[int]]:
    """For each axis the k nearest others, or those within `most` radians."""
    a = linalg.angle_matrix(directions)
    np.fill_diagonal(a, np.inf)
    if k is not None:
        return [set(np.argsort(r, kind="stable")[:k].tolist()) for r in a]
    return [set(np.flatnonzero(r <= most).tolist()) for r in a]


def peaks(alpha: np.ndarray, directions: np.ndarray, k: int = 16, keep: int = 3, share: float = 0.3, near: list[set[int]] | None = None) -> list[tuple[np.ndarray, float]]:
    """Up to `keep` group centroids of at least `share` of the largest amount, amounts scaled to sum 1; near: neighbourhoods() where they are known."""
    found = [centroid(directions, alpha, g) for g in group(alpha, directions, near or neighbourhoods(directions, k=k))]
    found = sorted(found, key=lambda p: -p[1])[:keep]
    found = [p for p in found if p[1] > share * found[0][1]] or found[:1]
    total = sum(a for _, a in found)
    return [(d, a / total) for d, a in found]


def split_by_angle(alpha: np.ndarray, directions: np.ndarray, most: float, keep: int = 3) -> np.ndarray:
    """Label of each direction with a positive coefficient: components of axes within `most` radians, heaviest first; -1 for the rest."""
    live = np.flatnonzero(alpha > 1e-9)
    a = linalg.angle_matrix(directions)
    label, parts = np.full(len(alpha), -1), []
    left = set(live.tolist())
    while left:
        todo = [left.pop()]
        part = list(todo)
        while todo:
            i = todo.pop()
            step = {j for j in left if a[i, j] <= most}
            left -= step
            todo += step
            part += step
        parts.append(part)
    for k, part in enumerate(sorted(parts, key=lambda p: -alpha[p].sum())[:keep]):
        label[part] = k
    return label


def refine(s: np.ndarray, gradients: np.ndarray, directions: np.ndarray, b: float, longitudinal: float, transversal: float, rounds: int = 20, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, coefficients, SSE): NNLS, then bisectors of all kept pairs join the basis, until the error stays."""
    d, last = np.asarray(directions, float), np.inf
    for _ in range(rounds):
        x, error, _ = fit_basis(s, basis(gradients, d, b, longitudinal, transversal))
        keep = np.flatnonzero(x > 1e-9)
        d, x = d[keep], x[keep]
        if last - error < tolerance or not len(keep):
            break
        last = error
        i, j = np.triu_indices(len(d), 1)
        mid = d[i] + d[j] * np.where((d[i] * d[j]).sum(1) < 0, -1, 1)[:, None]
        mid = mid[np.linalg.norm(mid, axis=1) > 1e-6]
        d = np.concatenate([d, mid / np.linalg.norm(mid, axis=1, keepdims=True)]) if len(mid) else d
    return d, x, error


def profile_objective(p, s, gradients, directions, alpha, b) -> float:
    """0.5 |phi(transversal, difference) alpha - s|^2"""
    return 0.5 * float(((basis(gradients, directions, b, p[0] + p[1], p[0]) @ alpha - s) ** 2).sum())


def profile_gradient(p, s, gradients, directions, alpha, b) -> np.ndarray:
    g, d = np.asarray(gradients, float), np.asarray(directions, float)
    c2 = (g @ d.T) ** 2
    phi = basis(g, d, b, p[0] + p[1], p[0])
    r = phi @ alpha - s
    n2 = (g * g).sum(1)[:, None]
    return np.array([r @ ((-b * n2 * phi) @ alpha), r @ ((-b * c2 * phi) @ alpha)])


def profile_hessian(p, s, gradients, directions, alpha, b) -> np.ndarray:
    g, d = np.asarray(gradients, float), np.asarray(directions, float)
    c2, n2 = (g @ d.T) ** 2, (g * g).sum(1)[:, None]
    phi = basis(g, d, b, p[0] + p[1], p[0])
    r = phi @ alpha - s
    parts = [(-b * n2 * phi), (-b * c2 * phi)]
    first = [q @ alpha for q in parts]
    w = [n2, c2]
    return np.array([[first[i] @ first[j] + r @ ((b * b * w[i] * w[j] * phi) @ alpha) for j in (0, 1)] for i in (0, 1)])


def fit_profile(s, gradients, directions, alpha, b, start=(3e-4, 1.4e-3)) -> np.ndarray:
    """(transversal, longitudinal - transversal) of least squares."""
    f = lambda q: profile_objective(q * 1e-3, s, gradients, directions, alpha, b)
    g = lambda q: profile_gradient(q * 1e-3, s, gradients, directions, alpha, b) * 1e-3
    return solvers.bfgs(f, g, np.array(start) * 1e3)[0] * 1e-3


def profile_distance(a: np.ndarray, b: np.ndarray, directions: np.ndarray) -> float:
    """Earth mover's distance of two coefficient profiles on the angles of their directions."""
    i, j = np.flatnonzero(a > 1e-9), np.flatnonzero(b > 1e-9)
    if not len(i) or not len(j):
        return float(abs(a.sum() - b.sum()) * math.pi / 2)
    d = linalg.angle_matrix(directions)
    return emd(np.where(a > 1e-9, a, 0), np.where(b > 1e-9, b, 0), d, metric=True)


def entropy(h: np.ndarray) -> float:
    p = np.asarray(h, float) / np.sum(h)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


@dataclass
class Deconvolution:
    """Constrained spherical deconvolution: zonal response, non-negative amplitudes on constraint directions."""

    response: np.ndarray
    gradients: np.ndarray
    constraints: np.ndarray
    lmax: int = 8
    threshold: float = 0.1
    weight: float = 1.0

    def __post_init__(self):
        rh = harmonics.rotational(self.response)
        by_l = np.array([rh[l // 2] if l // 2 < len(rh) else 0.0 for l, _ in harmonics.orders(self.lmax)])
        self.forward = harmonics.design(self.gradients, self.lmax) * by_l
        self.check = harmonics.design(self.constraints, self.lmax)

    def solve(self, s0: float, s: np.ndarray, rounds: int = 50) -> np.ndarray:
        y = np.asarray(s, float) / s0
        low = [k for k, (l, _) in enumerate(harmonics.orders(self.lmax)) if l <= 4]
        f = np.zeros(self.forward.shape[1])
        f[low] = np.linalg.lstsq(self.forward[:, low], y, rcond=None)[0]
        for _ in range(rounds):
            amplitude = self.check @ f
            bad = amplitude < self.threshold * amplitude.mean()
            rows = self.weight * len(y) / len(amplitude) * self.check[bad]
            new = np.linalg.lstsq(np.vstack([self.forward, rows]), np.concatenate([y, np.zeros(bad.sum())]), rcond=None)[0]
            done = np.abs(new - f).max() < 1e-10
            f = new
            if done:
                break
        return f


def response(signals: list[tuple[float, np.ndarray, np.ndarray]], gradients: np.ndarray, lmax: int = 8) -> tuple[np.ndarray, int]:
    """(mean zonal coefficients, voxels used) of (s0, signal, principal direction): directions turned to z, then fitted."""
    out = []
    for s0, s, pdd in signals:
        if s0 > FLOOR and np.isfinite(pdd).all():
            g = np.asarray(gradients) @ linalg.from_to_rotation(pdd, np.array([0, 0, 1.0])).T
            c = np.linalg.lstsq(harmonics.design(g, lmax), np.asarray(s) / s0, rcond=None)[0]
            out.append([c[k] for k, (_, m) in enumerate(harmonics.orders(lmax)) if m == 0])
    return (np.mean(out, axis=0) if out else np.zeros(lmax // 2 + 1)), len(out)


def smoothing_matrix(directions: np.ndarray, power: int = 500) -> np.ndarray:
    """|cos|^power, rows scaled to a largest entry of 1, squared as a matrix."""
    u = directions / np.linalg.norm(directions, axis=1, keepdims=True)
    m = np.abs(u @ u.T) ** power
    m /= m.max(1, keepdims=True)
    return m @ m


def gini_matrix(n: int) -> np.ndarray:
    j = linalg.centring(n)
    return j.T @ j
