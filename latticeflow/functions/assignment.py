"""Optimal assignment, vector matching, rigid alignment and the earth mover's distance."""

from __future__ import annotations

import heapq
from itertools import permutations

import numpy as np

from .linalg import quaternion_rotation, quaternion_rotations, rotation_quaternion  # noqa: F401

PAD = 1e5


def assign(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """(column of each row, total) of least total cost for a square matrix, by shortest augmenting paths with potentials.

    Rows whose least column no row before them has start out matched; only the others need a path.
    """
    c = np.asarray(cost, float)
    n = len(c)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, dtype=int)
    if n:
        u[1:] = c.min(1)
        columns, rows = np.unique(c.argmin(1), return_index=True)
        row_of[columns + 1] = rows + 1
    for i in np.setdiff1d(np.arange(1, n + 1), row_of[1:]):
        row_of[0], j0 = i, 0
        least, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            done[j0] = True
            i0 = row_of[j0]
            slack = c[i0 - 1] - u[i0] - v[1:]
            free = ~done[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[j1]
            u[row_of[done]] += step
            v[done] -= step
            least[1:][free] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[back[j0]]
            j0 = back[j0]
    out = np.zeros(n, dtype=int)
    out[row_of[1:] - 1] = np.arange(n)
    return out, float(c[np.arange(n), out].sum())


def assign_batch(cost: np.ndarray) -> np.ndarray:
    """The columns of assign() for each square matrix of a batch (n x k x k): all go through their paths together."""
    c = np.asarray(cost, float)
    n, k = c.shape[:2]
    if not n or not k:
        return np.zeros((n, k), dtype=int)
    at = np.arange(n)
    u, v, least = c.min(2), np.zeros((n, k)), c.argmin(2)
    row_of = np.full((n, k), -1)
    for i in range(k)[::-1]:
        row_of[at, least[:, i]] = i
    free = np.take_along_axis(row_of, least, 1) != np.arange(k)
    while len(one := np.flatnonzero(free.any(1))):
        start = free[one].argmax(1)
        free[one, start] = False
        dist = c[one, start] - u[one, start][:, None] - v[one]
        back, done, end = np.full((len(one), k), -1), np.zeros((len(one), k), dtype=bool), np.zeros(len(one), dtype=int)
        on = np.arange(len(one))  # those whose path has not reached a column without a row
        while len(on):
            d = np.where(done[on], np.inf, dist[on])
            j = d.argmin(1)
            done[on, j] = True
            i = row_of[one[on], j]
            end[on[i < 0]] = j[i < 0]
            d, j, i, on = d[i >= 0], j[i >= 0], i[i >= 0], on[i >= 0]
            e = one[on]
            new = (d[np.arange(len(on)), j] - u[e, i])[:, None] + c[e, i] - v[e]
            better = (new < dist[on]) & ~done[on]
            dist[on] = np.where(better, new, dist[on])
            back[on] = np.where(better, j[:, None], back[on])
        far = dist[np.arange(len(one)), end]
        moved = np.where(done, far[:, None] - dist, 0.0)
        v[one] -= moved
        x, j = np.nonzero(done & (row_of[one] >= 0))
        u[one[x], row_of[one[x], j]] += moved[x, j]
        u[one, start] += far
        on = np.arange(len(one))
        while len(on):
            before = back[on, end[on]]
            row_of[one[on], end[on]] = np.where(before < 0, start[on], row_of[one[on], before])
            end[on] = before
            on = on[before >= 0]
    out = np.empty((n, k), dtype=int)
    np.put_along_axis(out, row_of, np.broadcast_to(np.arange(k), (n, k)), 1)
    return out


def axial_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between rows taken as axes."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.degrees(np.arccos(np.clip(np.abs(unit(a) @ unit(b).T), 0, 1)))


def match_axes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(match of each row of a, -1 where it has none; mean angle of the matches in degrees); -1 and NaN if either is empty."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.full(n, -1), float("nan")
    k = max(n, m)
    cost = np.full((k, k), PAD)
    cost[:n, :m] = axial_costs(np.asarray(a, float), np.asarray(b, float))
    to, total = assign(cost)
    return np.where(to[:n] < m, to[:n], -1), (total - PAD * abs(n - m)) / min(n, m)


def match_three(a: np.ndarray, b: np.ndarray, void: float) -> tuple[tuple[int, ...], float]:
    """Best of the six pairings of two sets of three axes; a zero vector on either side costs `void`."""
    cost = axial_costs(a, b)
    empty_a, empty_b = ~np.any(a, axis=1), ~np.any(b, axis=1)
    cost[empty_a, :], cost[:, empty_b] = void, void
    cost[np.ix_(empty_a, empty_b)] = 0
    best = min(permutations(range(3)), key=lambda p: sum(cost[i, p[i]] for i in range(3)))
    return best, float(sum(cost[i, best[i]] for i in range(3)))


def match_threes(a: np.ndarray, b: np.ndarray, void: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairings, angles in degrees) of match_three() for each pair of a batch, both n x 3 x 3; the angles are those without voids."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=2, keepdims=True), 1e-300)
    angles = np.degrees(np.arccos(np.clip(np.abs(unit(a) @ unit(b).swapaxes(1, 2)), 0, 1)))
    empty_a, empty_b = ~np.any(a, axis=2)[:, :, None], ~np.any(b, axis=2)[:, None]
    cost = np.where(empty_a & empty_b, 0.0, np.where(empty_a | empty_b, void, angles))
    orders = np.array(list(permutations(range(3))))
    totals = np.stack([cost[:, 0, p[0]] + cost[:, 1, p[1]] + cost[:, 2, p[2]] for p in orders], axis=1)
    return orders[totals.argmin(1)], angles


def horn_align(p: np.ndarray, reference: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(4x4 rigid transform taking p to the reference in weighted least squares, the best scale, which is not applied)."""
    p, y = np.asarray(p, float), np.asarray(reference, float)
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    mp, my = (w @ p) / w.sum(), (w @ y) / w.sum()
    s = (p - mp).T @ ((y - my) * w[:, None])
    k = np.empty((4, 4))
    k[0, 0] = np.trace(s)
    k[0, 1:] = k[1:, 0] = [s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]]
    k[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    q = np.linalg.eigh(k)[1][:, -1]
    q = -q if q[0] < 0 else q
    r = quaternion_rotation(q)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, my - r @ mp
    scale = np.sqrt((w @ ((y - my) ** 2).sum(1)) / max(w @ ((p - mp) ** 2).sum(1), 1e-300))
    return out, float(scale)


def icp(shape: np.ndarray, reference: np.ndarray, tolerance: float = 1e-8, most: int = 100) -> tuple[np.ndarray, float]:
    """(aligned shape, error): match the points, align rigidly, until the error no longer changes."""
    x, y, last = np.asarray(shape, float), np.asarray(reference, float), np.inf
    for _ in range(most):
        to, _ = assign(((x[:, None] - y[None]) ** 2).sum(2))
        t, _ = horn_align(x, y[to])
        x = x @ t[:3, :3].T + t[:3, 3]
        error = float(((x - y[to]) ** 2).sum())
        if abs(last - error) <= tolerance:
            break
        last = error
    return x, error


def axial_icp(shapes: np.ndarray, references: np.ndarray, tolerance: float = 1e-8, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(aligned shapes, errors) of icp() for a batch of point sets with each point's opposite, of which one half is given: n x k x 3.

    With both centres at the origin there is only a turn to find.  A best matching takes opposite points to opposite
    points, so it is one of the k axes, each pair with the sign that brings it nearer.
    """
    x, y = np.array(shapes, float), np.asarray(references, float)
    error, on = np.full(len(x), np.inf), np.arange(len(x) if most else 0)
    for _ in range(most):
        if not len(on):
            break
        p, q = x[on], y[on]
        products = p @ q.swapaxes(1, 2)
        to = assign_batch((p * p).sum(2)[:, :, None] + (q * q).sum(2)[:, None] - 2 * np.abs(products))
        sign = np.where(np.take_along_axis(products, to[:, :, None], 2) < 0, -1.0, 1.0)
        q = np.take_along_axis(q, to[:, :, None], 1) * sign
        s = 2 * p.swapaxes(1, 2) @ q
        k = np.empty((len(on), 4, 4))
        trace = np.trace(s, axis1=1, axis2=2)
        k[:, 0, 0] = trace
        k[:, 0, 1:] = k[:, 1:, 0] = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], axis=1)
        k[:, 1:, 1:] = s + s.swapaxes(1, 2) - trace[:, None, None] * np.eye(3)
        p = p @ quaternion_rotations(np.linalg.eigh(k)[1][:, :, -1]).swapaxes(1, 2)
        now = 2 * ((p - q) ** 2).sum((1, 2))
        x[on], last = p, error[on]
        error[on] = now
        on = on[~(np.abs(last - now) <= tolerance)]
    return x, error


def min_cost_flow(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Least cost of moving min(sum supply, sum demand), by successive shortest paths with potentials; and the flow."""
    n, m = len(supply), len(demand)
    left, want = np.array(supply, float), np.array(demand, float)
    flow, pot = np.zeros((n, m)), np.zeros(n + m)
    eps = 1e-12 * max(1.0, left.sum(), want.sum())
    total = 0.0
    while left.sum() > eps and want.sum() > eps:
        dist, back = np.full(n + m, np.inf), np.full(n + m, -1)
        heap = [(0.0, int(i)) for i in np.flatnonzero(left > eps)]
        for _, i in heap:
            dist[i] = 0.0
        heapq.heapify(heap)
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x] + 1e-15:
                continue
            if x < n:
                steps = [(n + j, cost[x, j] + pot[x] - pot[n + j]) for j in range(m)]
            else:
                steps = [(i, pot[x] - pot[i] - cost[i, x - n]) for i in range(n) if flow[i, x - n] > eps]
            for y, c in steps:
                c = max(c, 0.0)
                if d + c < dist[y] - 1e-15:
                    dist[y], back[y] = d + c, x
                    heapq.heappush(heap, (d + c, y))
        ends = [j for j in range(m) if want[j] > eps and np.isfinite(dist[n + j])]
        if not ends:
            break
        end = n + min(ends, key=lambda j: dist[n + j] + pot[n + j])
        pot = pot + np.where(np.isfinite(dist), dist, dist[np.isfinite(dist)].max())
        path, x = [], end
        while back[x] >= 0:
            path.append((int(back[x]), x))
            x = int(back[x])
        amount = min([left[x], want[end - n], *[flow[b, a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
                total += amount * cost[a, b - n]
            else:
                flow[b, a - n] -= amount
                total -= amount * cost[b, a - n]
        left[x] -= amount
        want[end - n] -= amount
    return total, flow


def emd(p: np.ndarray, q: np.ndarray, ground: np.ndarray, extra: float | None = None, metric: bool = False) -> float:
    """Earth mover's distance with a penalty for the mass that one side has more: `extra` (default: the largest ground distance) for each unit.

    metric: common mass stays where it is first, which changes nothing for a metric but saves work.
    """
    p, q, d = np.array(p, float), np.array(q, float), np.asarray(ground, float)
    more = abs(p.sum() - q.sum())
    if metric and len(p) == len(q):
        common = np.minimum(p, q)
        p, q = p - common, q - common
    i, j = np.flatnonzero(p > 0), np.flatnonzero(q > 0)
    cost = min_cost_flow(p[i], q[j], d[np.ix_(i, j)])[0] if len(i) and len(j) else 0.0
    return cost + more * (d.max() if extra is None and d.size else extra or 0.0)


def emd_with_entropy(p: np.ndarray, q: np.ndarray, ground: np.ndarray) -> float:
    """The cost of moving a unit of the common mass, a penalty of the largest distance for each unit that one side has more, and the difference of entropies, weighted by the larger mass."""
    a, b, top = float(np.sum(p)), float(np.sum(q)), float(np.max(ground))
    moved = emd(p, q, ground, extra=0.0)
    shares = [np.asarray(x, float)[np.asarray(x) > 0] / np.sum(x) for x in (p, q)]
    entropies = [-float((s * np.log(s)).sum()) for s in shares]
    return moved / min(a, b) + abs(a - b) * top + max(a, b) * abs(entropies[0] - entropies[1])
