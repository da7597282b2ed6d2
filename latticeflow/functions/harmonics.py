"""Real spherical harmonics of even order: design matrices, rotational harmonics and surfaces."""

from __future__ import annotations

import math

import numpy as np


def legendre(lmax: int, x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Normalised associated Legendre functions P(l, m) for m >= 0, by the usual upward recurrences."""
    s = np.sqrt(np.maximum(0.0, 1 - x * x))
    out = {(0, 0): np.full_like(x, math.sqrt(1 / (4 * math.pi)))}
    for m in range(lmax + 1):
        if m:
            out[m, m] = -math.sqrt((2 * m + 1) / (2 * m)) * s * out[m - 1, m - 1]
        if m < lmax:
            out[m + 1, m] = math.sqrt(2 * m + 3) * x * out[m, m]
        for l in range(m + 2, lmax + 1):
            a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            b = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
            out[l, m] = a * (x * out[l - 1, m] - b * out[l - 2, m])
    return out


def angles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(azimuth, elevation from z, amplitude) of rows."""
    v = np.atleast_2d(np.asarray(v, float))
    n = np.linalg.norm(v, axis=1)
    return np.arctan2(v[:, 1], v[:, 0]), np.arccos(np.clip(v[:, 2] / np.where(n > 0, n, 1), -1, 1)), n


def orders(lmax: int) -> list[tuple[int, int]]:
    return [(l, m) for l in range(0, lmax + 1, 2) for m in range(-l, l + 1)]


def design(directions: np.ndarray, lmax: int) -> np.ndarray:
    """One row for each direction, one column for each (l, m) of even l up to lmax."""
    azimuth, elevation, _ = angles(directions)
    p = legendre(lmax, np.cos(elevation))
    return np.stack([p[l, 0] if m == 0 else math.sqrt(2) * p[l, abs(m)] * (np.cos(m * azimuth) if m > 0 else np.sin(-m * azimuth)) for l, m in orders(lmax)], axis=1)


def value(azimuth: float, elevation: float, l: int, m: int) -> float:
    d = [math.cos(azimuth) * math.sin(elevation), math.sin(azimuth) * math.sin(elevation), math.cos(elevation)]
    return float(design(np.array([d]), l + l % 2)[0, orders(l + l % 2).index((l, m))]) if l % 2 == 0 else 0.0


def rotational(zonal: np.ndarray) -> np.ndarray:
    """Rotational harmonics of a zonal function's coefficients (one for each even l): c / Y_l0 at the pole."""
    return np.array([c / math.sqrt((4 * k + 1) / (4 * math.pi)) for k, c in enumerate(zonal)])


def amplitudes(coefs: np.ndarray, directions: np.ndarray, lmax: int) -> np.ndarray:
    return design(directions, lmax) @ coefs


def surface(coefs: np.ndarray, directions: np.ndarray, lmax: int, normals: bool = False, h: float = 1e-5):
    """Vertices r(d) d of the radial surface; with normals, also its unit normals from the angular derivatives."""
    u = np.asarray(directions, float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    r = amplitudes(coefs, u, lmax)
    if not normals:
        return u * r[:, None]
    a = np.where(np.abs(u[:, :1]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]])
    t = np.cross(u, a)
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    b = np.cross(u, t)
    dt, db = ((amplitudes(coefs, u + h * x, lmax) - amplitudes(coefs, u - h * x, lmax)) / (2 * h) for x in (t, b))
    n = r[:, None] * u - dt[:, None] * t - db[:, None] * b
    return u * r[:, None], n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
