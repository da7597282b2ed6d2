"""Matrix routines for use inside vectorised functions (numpy on one row's or one group's arrays)."""

from __future__ import annotations

import math

import numpy as np


def pseudo_inverse(a: np.ndarray, cutoff: float = 1e-10) -> np.ndarray:
    u, s, vt = np.linalg.svd(np.asarray(a, float), full_matrices=False)
    return (vt.T * np.where(s > cutoff, 1 / np.where(s > cutoff, s, 1), 0)) @ u.T


def symmetric_eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues ascending and unit eigenvectors as columns."""
    return np.linalg.eigh((np.asarray(m, float) + np.asarray(m, float).T) / 2)


def generalized_symmetric_eigen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = l B x with B positive definite, by Cholesky whitening; values ascending."""
    half = np.linalg.inv(np.linalg.cholesky(b))
    values, y = symmetric_eigen(half @ a @ half.T)
    return values, half.T @ y


def generalized_eigen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = l B x through the pseudo-inverse of B."""
    return np.linalg.eig(pseudo_inverse(b) @ a)


def project_psd(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, vectors, values) with eigenvalues below 0 set to 0."""
    values, vectors = symmetric_eigen(m)
    values = np.maximum(values, 0)
    return (vectors * values) @ vectors.T, vectors, values


def householder(x: np.ndarray, index: int = 0) -> tuple[np.ndarray, float]:
    """(v, beta) with (I - beta v v') x zero below `index`."""
    v = np.array(x, float)
    v[:index] = 0
    size = np.linalg.norm(v)
    if size == 0:
        return v, 0.0
    v[index] += math.copysign(size, v[index])
    return v, 2 / (v @ v)


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q (n x n) and R by Householder reflections."""
    r = np.array(a, float)
    n, m = r.shape
    q = np.eye(n)
    for k in range(min(n - 1, m)):
        v, beta = householder(r[:, k], k)
        r -= beta * np.outer(v, v @ r)
        q -= beta * np.outer(q @ v, v)
    return q, np.triu(r)


# Degrees of the diagonal Pade approximants to exp and the 1-norms up to which each is accurate to double precision.
PADE = {3: 1.495585217958292e-2, 5: 2.539398330063230e-1, 7: 9.504178996162932e-1, 9: 2.097847961257068, 13: 5.371920351148152}


def pade_coefficients(m: int) -> list[float]:
    """Coefficients of the numerator of the diagonal approximant of degree m, from their recurrence."""
    c = [float(math.factorial(2 * m) // math.factorial(m))]
    for k in range(1, m + 1):
        c.append(c[-1] * (m - k + 1) / (k * (2 * m - k + 1)))
    return c


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Pade approximant."""
    a = np.asarray(a, float)
    size = np.abs(a).sum(0).max() if a.size else 0.0
    degree = next((m for m, t in PADE.items() if size <= t), 13)
    squarings = max(0, math.frexp(size / PADE[13])[1]) if degree == 13 and size > PADE[13] else 0
    x = a / 2.0**squarings
    even, odd, power = np.zeros_like(x), np.zeros_like(x), np.eye(len(x))
    for k, c in enumerate(pade_coefficients(degree)):
        if k % 2:
            odd = odd + c * power
        else:
            even = even + c * power
        power = power @ x
    out = np.linalg.solve(even - odd, even + odd)
    for _ in range(squarings):
        out = out @ out
    return out


def centring(n: int) -> np.ndarray:
    return np.eye(n) - 1.0 / n


def biased_form(q: np.ndarray, v: np.ndarray, bias: np.ndarray) -> float:
    d = np.asarray(v) - bias
    return 0.5 * float(d @ q @ d)


def from_to_rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that turns unit vector a into b the short way; half a turn about a normal if they are opposite."""
    a, b = (np.asarray(x, float) / np.linalg.norm(x) for x in (a, b))
    v, c = np.cross(a, b), float(a @ b)
    if c < -1 + 1e-12:
        n = np.cross(a, np.eye(3)[np.argmin(np.abs(a))])
        n /= np.linalg.norm(n)
        return 2 * np.outer(n, n) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def rotation_from_angles(azimuth: float, zenith: float) -> np.ndarray:
    """Rotation whose third column is the direction of the two angles."""
    ca, sa, cz, sz = math.cos(azimuth), math.sin(azimuth), math.cos(zenith), math.sin(zenith)
    return np.array([[ca * cz, -sa, ca * sz], [sa * cz, ca, sa * sz], [-sz, 0, cz]])


def quaternion_rotation(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    u = np.array([x, y, z])
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return (w * w - u @ u) * np.eye(3) + 2 * np.outer(u, u) + 2 * w * k


def quaternion_rotations(q: np.ndarray) -> np.ndarray:
    """quaternion_rotation() of each row."""
    w, x, y, z = (np.asarray(q, float) / np.linalg.norm(q, axis=1, keepdims=True)).T
    u, o = np.stack([x, y, z], axis=1), np.zeros(len(w))
    k = np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)
    return (w * w - (u * u).sum(1))[:, None, None] * np.eye(3) + 2 * u[:, :, None] * u[:, None] + 2 * w[:, None, None] * k


def rotation_quaternion(r: np.ndarray) -> np.ndarray:
    """Unit quaternion (w >= 0) of a rotation: the dominant eigenvector of its 4x4 form."""
    r = np.asarray(r, float)
    k = np.empty((4, 4))
    k[0, 0] = np.trace(r)
    k[0, 1:] = k[1:, 0] = [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]
    k[1:, 1:] = r + r.T - np.trace(r) * np.eye(3)
    q = np.linalg.eigh(k)[1][:, -1]
    return -q if q[0] < 0 else q


def affine_from_quaternion(b: float, c: float, d: float, offset, sizes, qfac: float = 1.0) -> np.ndarray:
    """4x4 of quaternion parts (a from unit length), offsets and voxel sizes; the z axis turns round where qfac < 0."""
    a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    s = [x if x > 0 else 1.0 for x in sizes]
    out = np.eye(4)
    out[:3, :3] = quaternion_rotation([a, b, c, d]) * [s[0], s[1], -s[2] if qfac < 0 else s[2]]
    out[:3, 3] = offset
    return out


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to a."""
    u, _, vt = np.linalg.svd(a)
    return u @ vt


def quaternion_from_affine(m: np.ndarray) -> dict:
    """Quaternion parts, offsets, sizes and qfac of a 4x4 affine."""
    m = np.asarray(m, float)
    sizes = np.linalg.norm(m[:3, :3], axis=0)
    r = m[:3, :3] / np.where(sizes > 0, sizes, 1)
    r[:, sizes == 0] = np.eye(3)[:, sizes == 0]
    r = polar(r)
    qfac = 1.0 if np.linalg.det(r) > 0 else -1.0
    r[:, 2] *= qfac
    q = rotation_quaternion(r)
    return {"b": q[1], "c": q[2], "d": q[3], "offset": m[:3, 3], "sizes": np.where(sizes > 0, sizes, 1), "qfac": qfac}


def orthogonal_affine(rows: np.ndarray) -> np.ndarray:
    """4x4 of the rotation nearest to three rows; a zero row takes the cross product of the others or an axis."""
    r = np.array(rows, float).reshape(3, 3)
    for i in range(3):
        n = np.linalg.norm(r[i])
        r[i] = r[i] / n if n > 0 else 0
    for i in range(3):
        if not r[i].any():
            c = np.cross(r[(i + 1) % 3], r[(i + 2) % 3])
            r[i] = c if c.any() else np.eye(3)[i]
    out = np.eye(4)
    out[:3, :3] = polar(r)
    return out


def orientation_codes(m: np.ndarray) -> tuple[int, int, int]:
    """Codes 1..6 of the axes nearest to i, j and k: the signed permutation that keeps most of the trace."""
    from itertools import permutations, product

    r = polar(np.asarray(m, float)[:3, :3])
    best, found = -9.0, (0, 1, 2, 1, 1, 1)
    for p in permutations(range(3)):
        for s in product((1, -1), repeat=3):
            t = sum(s[k] * r[p[k], k] for k in range(3))
            if t > best:
                best, found = t, (*p, *s)
    return tuple(2 * found[k] + (1 if found[3 + k] > 0 else 2) for k in range(3))


def subdivide_sphere(vertices: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each triangle in four, edge midpoints pushed out to the unit sphere."""
    edges = np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1)
    each, at = np.unique(edges, axis=0, return_inverse=True)
    mid = vertices[each].mean(1)
    mid /= np.linalg.norm(mid, axis=1, keepdims=True)
    ab, bc, ca = (at.reshape(-1)[k * len(triangles) : (k + 1) * len(triangles)] + len(vertices) for k in range(3))
    a, b, c = triangles.T
    return np.concatenate([vertices, mid]), np.concatenate([np.stack(t, 1) for t in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])


def angle_matrix(d: np.ndarray, axial: bool = True) -> np.ndarray:
    """Angles between all rows of d, of axes or of directions."""
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    c = u @ u.T
    return np.arccos(np.clip(np.abs(c) if axial else c, -1, 1))
