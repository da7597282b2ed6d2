"""Column expressions on vectors held as ARRAY<DOUBLE>; everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sqr_norm(a: Column) -> Column:
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(sqr_norm(a))


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def scale(a: Column, t) -> Column:
    return F.transform(a, lambda x: x * t)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def combine(a: Column, f, b: Column, g=1.0) -> Column:
    """a * f + b * g"""
    return F.zip_with(a, b, lambda x, y: x * f + y * g)


def sqr_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sqr_distance(a, b))


def abs_cosine(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(dot(a, b)) / (norm(a) * norm(b)))


def axial_angle(a: Column, b: Column) -> Column:
    """Angle between axes, so that v and -v are the same; 0 to pi/2."""
    return F.acos(abs_cosine(a, b))


def axial_angle_degrees(a: Column, b: Column) -> Column:
    return F.degrees(axial_angle(a, b))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.element_at(v, i)
    return F.array(at(a, 2) * at(b, 3) - at(a, 3) * at(b, 2), at(a, 3) * at(b, 1) - at(a, 1) * at(b, 3), at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1))


def triangle_normal(a: Column, b: Column, c: Column) -> Column:
    return normalize(cross(subtract(b, a), subtract(c, a)))


def point_segment_sqr_distance(a: Column, b: Column, p: Column) -> Column:
    """Squared distance of p to the segment from a to b; a segment of one point counts as that point."""
    ab, ap = subtract(b, a), subtract(p, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(ap, ab) / F.nullif(sqr_norm(ab), F.lit(0.0))))
    return sqr_norm(subtract(ap, scale(ab, F.coalesce(t, F.lit(0.0)))))


def point_line_distance(p: Column, a: Column, b: Column) -> Column:
    return norm(cross(subtract(p, a), subtract(p, b))) / norm(subtract(b, a))


def fractional_anisotropy(ev: Column, mean: Column | None = None) -> Column:
    """FA of eigenvalues; 0 for null, NaN where all are 0."""
    md = mean if mean is not None else total(ev) / F.size(ev)
    spread = total(F.transform(ev, lambda x: (x - md) * (x - md)))
    size = sqr_norm(ev)
    return F.when(ev.isNull(), 0.0).when(size == 0, float("nan")).otherwise(F.sqrt(F.lit(1.5) * spread / size))


def shape_coefficients(ev: Column) -> Column:
    """struct(linear, planar, spherical, shape): shares of the sorted eigenvalues, and 1, 2 or 3 for the strictly largest.

    A tie between linear and planar is decided between planar and spherical, every other tie goes to
    spherical; eigenvalues that sum to about 0 have coefficients of 0 and shape -1.
    """
    def shares(s: Column) -> Column:
        l1, l2, l3 = (F.element_at(s, i) for i in (1, 2, 3))
        t = l1 + l2 + l3
        share = lambda x: F.when(F.abs(t) >= 1e-12, x / t).otherwise(0.0)
        return F.struct(share(l1 - l2).alias("linear"), share(2 * (l2 - l3)).alias("planar"), share(3 * l3).alias("spherical"), (F.abs(t) >= 1e-12).alias("ok"))

    def shape(c: Column) -> Column:
        linear, planar, spherical = c["linear"], c["planar"], c["spherical"]
        code = F.when(~c["ok"], -1).when(linear > planar, F.when(linear > spherical, 1).otherwise(3)).when(planar > spherical, 2).otherwise(3)
        return F.struct(linear.alias("linear"), planar.alias("planar"), spherical.alias("spherical"), code.alias("shape"))

    return let(let(F.sort_array(ev, asc=False), shares), shape)


def quadratic_form(q: Column, x: Column) -> Column:
    """x'Qx, Q row by row in one array."""
    n = F.size(x)
    rows = F.transform(x, lambda v, i: v * total(F.zip_with(F.slice(q, i * n + 1, n), x, lambda a, b: a * b)))
    return total(rows)


def project(x: Column, directions: Column) -> Column:
    """Dot products of x with each of an array of directions."""
    return F.transform(directions, lambda d: dot(x, d))


def rescale(v: Column, low=0.0, high=1.0) -> Column:
    """Array to [low, high]; a constant array gives low."""
    a, b = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda x: F.when(b > a, low + (high - low) * (x - a) / (b - a)).otherwise(F.lit(low)))


def arg_max(v: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(v, F.array_max(v)) - 1


def signal(fractions: Column, tensors: Column, g: Column, b) -> Column:
    """Sum of f * exp(-b g'Dg) over compartments; tensors: an array of 3x3 arrays of 9."""
    parts = F.zip_with(fractions, tensors, lambda f, d: f * F.exp(-b * quadratic_form(d, g)))
    return total(parts)


def azimuth_elevation(v: Column) -> Column:
    """struct(azimuth, elevation, amplitude) of a 3-vector; elevation counts from the z axis."""
    x, y, z, n = F.element_at(v, 1), F.element_at(v, 2), F.element_at(v, 3), norm(v)
    return F.struct(F.atan2(y, x).alias("azimuth"), F.acos(F.when(n > 0, z / n).otherwise(1.0)).alias("elevation"), n.alias("amplitude"))


def sorted_positive(alpha: Column, directions: Column) -> Column:
    """Array of struct(alpha, dir) with alpha > 0, largest first."""
    pairs = F.filter(F.zip_with(alpha, directions, lambda a, d: F.struct(a.alias("alpha"), d.alias("dir"))), lambda p: p["alpha"] > 0)
    return F.array_sort(pairs, lambda p, q: F.when(p["alpha"] > q["alpha"], -1).when(p["alpha"] < q["alpha"], 1).otherwise(0))


def drop_small_peaks(f: Column, share: float) -> Column:
    """Keep values of at least share * max and scale them to sum 1."""
    kept = F.filter(f, lambda x: x >= share * F.array_max(f))
    s = total(kept)
    return F.when(s != 0, F.transform(kept, lambda x: x / s)).otherwise(kept)


def big_peaks(f: Column, share: float) -> Column:
    """Keep values above share * max as they are."""
    return F.filter(f, lambda x: x > share * F.array_max(f))


def _bend(a: Column, b: Column, displacement: Column, d0: float, theta0: float, d_theta0: float, turn: float) -> Column:
    """exp(-U): squared distance, both axes' angles to the displacement (less half the turn), and their difference."""
    def weigh(p: Column) -> Column:
        along = (2 - F.cos(2 * p["a"] - turn) - F.cos(2 * p["b"] - turn)) / (1 - math.cos(2 * theta0))
        apart = (1 - F.cos(2 * (p["a"] - p["b"]))) / (1 - math.cos(2 * d_theta0))
        return F.exp(-(sqr_norm(displacement) / (d0 * d0) + along + apart))

    return let(F.struct(axial_angle(a, displacement).alias("a"), axial_angle(b, displacement).alias("b")), weigh)


def colinearity(a: Column, b: Column, displacement: Column, d0: float, theta0: float, d_theta0: float) -> Column:
    """Highest for two axes along the displacement; angles in radians."""
    return _bend(a, b, displacement, d0, theta0, d_theta0, 0.0)


def parallelity(a: Column, b: Column, displacement: Column, d0: float, theta0: float, d_theta0: float) -> Column:
    """Highest for two axes a quarter of pi off the displacement."""
    return _bend(a, b, displacement, d0, theta0, d_theta0, 0.5 * math.pi)


def combined_direction(a: Column, x: Column, b: Column, y: Column) -> Column:
    """The dominant eigenvector of a^2 xx' + b^2 yy', of length 1.

    It lies in the plane of the two, so the 2 x 2 matrix of their products gives it.
    """
    def mix(p: Column) -> Column:
        u, v, g, h, m = p["u"], p["v"], p["g"], p["h"], p["m"]
        top = (g + h + F.sqrt((g - h) * (g - h) + 4 * m * m)) / 2
        mixed = let(top, lambda t: F.when(g >= h, combine(u, t - h, v, m)).otherwise(combine(u, m, v, t - g)))
        return let(F.when(m != 0, mixed).when(g >= h, u).otherwise(v), normalize)

    pair = let(F.struct(scale(x, a).alias("u"), scale(y, b).alias("v")), lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"), sqr_norm(p["u"]).alias("g"), sqr_norm(p["v"]).alias("h"), dot(p["u"], p["v"]).alias("m")))
    return let(pair, mix)


def weighted_angular_distance(a: Column, x: Column, b: Column, y: Column) -> Column:
    """The lesser angle of two axes to their combined direction."""
    return let(combined_direction(a, x, b, y), lambda u: F.least(axial_angle(x, u), axial_angle(y, u)))


def projection_weights(tensor: Column, directions: Column, least: float = 1e-6) -> Column:
    """d'(trace I - T)d for each of an array of directions, rescaled to 0..1 where its range is over `least`.

    tensor: xx, yy, zz, xy, xz, yz.
    """
    t = [F.element_at(tensor, i + 1) for i in range(6)]
    trace = t[0] + t[1] + t[2]
    q = F.array(trace - t[0], -t[3], -t[4], -t[3], trace - t[1], -t[5], -t[4], -t[5], trace - t[2])
    def spread(w: Column) -> Column:
        low, range_ = F.array_min(w), F.array_max(w) - F.array_min(w)
        return F.when(range_ > least, F.transform(w, lambda x: (x - low) / range_)).otherwise(w)

    return let(let(q, lambda m: F.transform(directions, lambda d: quadratic_form(m, d))), spread)


def component(compartments: Column, k: int) -> Column:
    """Compartment k (from 0) of an array of compartments, null past its end."""
    return F.try_element_at(compartments, F.lit(k + 1))
