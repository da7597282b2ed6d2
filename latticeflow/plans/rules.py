"""Queries over single rules: vectors, matrices, palettes, bits, names and codes, each with SQL written from the rule's formula.

Vectors and matrices are parts of an embedding: a, b and c its first three triples, m and n its first two 3 x 3
matrices, row by row.  All of these are native: column expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import scalars, strings
from ..functions import vectors as V
from .queries import ABSCOS, NORM, VEC_SQL, embeddings, query, read

PARTS_SQL = f"p AS (SELECT vec_id, label, v, v[1:3] AS a, v[4:6] AS b, v[7:9] AS c, v[1:9] AS m, v[10:18] AS n FROM ({VEC_SQL}))"


def parts(spark, sf) -> DataFrame:
    v = V.doubles("embedding")
    cut = {"a": (1, 3), "b": (4, 3), "c": (7, 3), "m": (1, 9), "n": (10, 9)}
    return embeddings(spark, sf).select("vec_id", "label", v.alias("v"), *[F.slice(v, at, k).alias(name) for name, (at, k) in cut.items()])


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def sql6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def listed(columns: dict) -> str:
    return ", ".join(sql6(e, n) for n, e in columns.items())


class Columns(dict):
    """Columns by name, made when they are asked for: there is no session yet when this module is read."""

    def __missing__(self, name: str):
        return F.col(name)


COL = Columns()


@query(
    f"WITH {PARTS_SQL} SELECT vec_id, "
    + listed({
        "dot": "list_dot_product(a, b)", "sqr_norm": "list_dot_product(a, a)", "norm": NORM.format("a"), "sqr_distance": "(a[1]-b[1])**2 + (a[2]-b[2])**2 + (a[3]-b[3])**2", "distance": "sqrt((a[1]-b[1])**2 + (a[2]-b[2])**2 + (a[3]-b[3])**2)",
        "angle": f"acos({ABSCOS.format('a', 'b')})", "degrees_": f"degrees(acos({ABSCOS.format('a', 'b')}))", "cross1": "a[2]*b[3] - a[3]*b[2]", "cross2": "a[3]*b[1] - a[1]*b[3]", "cross3": "a[1]*b[2] - a[2]*b[1]",
        "scaled": "2.5 * a[2]", "added": "a[3] + b[3]", "subtracted": "a[1] - b[1]", "combined": "a[2] * 2 + b[2] * 3", "unit": f"a[1] / {NORM.format('a')}", "ranged": "(v[1] - list_min(v)) / (list_max(v) - list_min(v))", "ranged_to": "-1 + 3 * (v[2] - list_min(v)) / (list_max(v) - list_min(v))",
    })
    + " FROM p"
)
def vector_algebra(spark, sf):
    """Products, norms, distances, axial angles, cross products, sums and rescaling of vectors."""
    a, b, v = COL["a"], COL["b"], COL["v"]
    at = F.element_at
    return parts(spark, sf).select(
        "vec_id", r6(V.dot(a, b), "dot"), r6(V.sqr_norm(a), "sqr_norm"), r6(V.norm(a), "norm"), r6(V.sqr_distance(a, b), "sqr_distance"), r6(V.distance(a, b), "distance"), r6(V.axial_angle(a, b), "angle"), r6(V.axial_angle_degrees(a, b), "degrees_"),
        *[r6(at(V.cross(a, b), i), f"cross{i}") for i in (1, 2, 3)], r6(at(V.scale(a, 2.5), 2), "scaled"), r6(at(V.add(a, b), 3), "added"), r6(at(V.subtract(a, b), 1), "subtracted"), r6(at(V.combine(a, 2.0, b, 3.0), 2), "combined"),
        r6(at(V.normalize(a), 1), "unit"), r6(at(V.rescale(v), 1), "ranged"), r6(at(V.rescale(v, -1.0, 2.0), 2), "ranged_to"),
    )


TRIANGLE = "[(b[2]-a[2])*(c[3]-a[3]) - (b[3]-a[3])*(c[2]-a[2]), (b[3]-a[3])*(c[1]-a[1]) - (b[1]-a[1])*(c[3]-a[3]), (b[1]-a[1])*(c[2]-a[2]) - (b[2]-a[2])*(c[1]-a[1])]"
FORM = "({x}[1]*(m[1]*{x}[1]+m[2]*{x}[2]+m[3]*{x}[3]) + {x}[2]*(m[4]*{x}[1]+m[5]*{x}[2]+m[6]*{x}[3]) + {x}[3]*(m[7]*{x}[1]+m[8]*{x}[2]+m[9]*{x}[3]))"


@query(
    f"WITH {PARTS_SQL}, q AS (SELECT *, {TRIANGLE} AS t, [b[1]-a[1], b[2]-a[2], b[3]-a[3]] AS ab, [c[1]-a[1], c[2]-a[2], c[3]-a[3]] AS ac FROM p), s AS (SELECT *, greatest(0.0, least(1.0, list_dot_product(ac, ab) / list_dot_product(ab, ab))) AS k FROM q) SELECT vec_id, "
    + listed({
        "normal1": f"t[1] / {NORM.format('t')}", "normal2": f"t[2] / {NORM.format('t')}", "normal3": f"t[3] / {NORM.format('t')}", "segment": "(ac[1]-k*ab[1])**2 + (ac[2]-k*ab[2])**2 + (ac[3]-k*ab[3])**2", "line": f"{NORM.format('t')} / {NORM.format('ab')}",
        "form": FORM.format(x="b"), "biased": "0.5 * " + FORM.format(x="ab"), "azimuth": "atan2(a[2], a[1])", "elevation": f"acos(a[3] / {NORM.format('a')})", "amplitude": NORM.format("a"),
    })
    + " FROM s"
)
def geometry(spark, sf):
    """Triangle normals, distances of a point to a segment and a line, quadratic forms, and vectors as two angles and a length."""
    a, b, c, m = (COL[k] for k in "abcm")
    t, s = V.triangle_normal(a, b, c), V.azimuth_elevation(a)
    return parts(spark, sf).select(
        "vec_id", *[r6(F.element_at(t, i), f"normal{i}") for i in (1, 2, 3)], r6(V.point_segment_sqr_distance(a, b, c), "segment"), r6(V.point_line_distance(c, a, b), "line"), r6(V.quadratic_form(m, b), "form"), r6(0.5 * V.quadratic_form(m, V.subtract(b, a)), "biased"),
        *[r6(s[k], k) for k in ("azimuth", "elevation", "amplitude")],
    )


def entries(name: str, sql: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, '{name}' AS what, {i} AS place, {sql6(e, 'value')} FROM p" for i, e in enumerate(sql))


def exploded(df: DataFrame, **arrays) -> DataFrame:
    out = None
    for name, c in arrays.items():
        one = df.select("vec_id", F.lit(name).alias("what"), F.posexplode(c).alias("place", "x")).select("vec_id", "what", "place", r6(F.col("x"), "value"))
        out = one if out is None else out.unionByName(one)
    return out


MATRIX_SQL = {
    "transpose": [f"v[{(i % 2) * 3 + i // 2 + 1}]" for i in range(6)],  # of the 2 x 3 matrix v[1:6]
    "identity": ["1.0" if i % 4 == 0 else "0.0" for i in range(9)],
    "times": [" + ".join(f"m[{3 * (i // 3) + k + 1}]*n[{3 * k + i % 3 + 1}]" for k in range(3)) for i in range(9)],
    "general": [" + ".join(f"v[{3 * (i // 4) + k + 1}]*v[{6 + 4 * k + i % 4 + 1}]" for k in range(3)) for i in range(8)],  # 2 x 3 by 3 x 4
    "times_vector": [" + ".join(f"m[{3 * i + k + 1}]*b[{k + 1}]" for k in range(3)) for i in range(3)],
    "vector_times": [" + ".join(f"m[{3 * k + i + 1}]*b[{k + 1}]" for k in range(3)) for i in range(3)],
    "projected": [" + ".join(f"n[{3 * i + k + 1}]*a[{k + 1}]" for k in range(3)) for i in range(3)],
}


@query(f"WITH {PARTS_SQL} " + " UNION ALL ".join(entries(k, e) for k, e in MATRIX_SQL.items()))
def matrix_products(spark, sf):
    """Transpose, identity, products of matrices with matrices and vectors, and a vector projected on directions."""
    m, n, a, b, v = (COL[k] for k in "mnabv")
    p = parts(spark, sf)
    rows = F.array(*[F.slice(n, 3 * i + 1, 3) for i in range(3)])
    return exploded(
        p, transpose=M.transpose(F.slice(v, 1, 6), 2, 3), identity=M.identity(3), times=M.times(m, n, 3, 3, 3), general=M.times(F.slice(v, 1, 6), F.slice(v, 7, 12), 2, 3, 4),
        times_vector=M.times_vector(m, b, 3, 3), vector_times=M.vector_times(b, m, 3, 3), projected=V.project(a, rows),
    )


def cofactor(i: int, j: int) -> str:
    """Signed minor (i, j) of m, expanded along what is left when row i and column j go."""
    rows, cols = [r for r in range(3) if r != i], [c for c in range(3) if c != j]
    e = lambda r, c: f"m[{3 * r + c + 1}]"
    minor = f"({e(rows[0], cols[0])}*{e(rows[1], cols[1])} - {e(rows[0], cols[1])}*{e(rows[1], cols[0])})"
    return minor if (i + j) % 2 == 0 else f"(-{minor})"


DET = " + ".join(f"m[{j + 1}]*{cofactor(0, j)}" for j in range(3))
INVERSE = [f"{cofactor(j, i)} / d" for i in range(3) for j in range(3)]
SHIFTED = ["-(" + " + ".join(f"({cofactor(j, i)} / d)*c[{j + 1}]" for j in range(3)) + ")" for i in range(3)]
AFFINE = [x for i in range(3) for x in (*INVERSE[3 * i : 3 * i + 3], SHIFTED[i])] + ["0.0", "0.0", "0.0", "1.0"]


@query(f"WITH p0 AS (SELECT * FROM (WITH {PARTS_SQL} SELECT * FROM p)), p AS (SELECT vec_id, b, c, [m[1]+1, m[2], m[3], m[4], m[5]+1, m[6], m[7], m[8], m[9]+1] AS m0 FROM p0), p1 AS (SELECT vec_id, b, c, m0 AS m FROM p), p2 AS (SELECT *, {DET} AS d FROM p1) " + " UNION ALL ".join(entries(k, e).replace("FROM p", "FROM p2") for k, e in {"determinant": ["d"], "inverse": INVERSE, "affine": AFFINE}.items()))
def matrix_inverses(spark, sf):
    """Determinant and inverse of 3 x 3 matrices (m plus the identity) and the inverse of an affine 4 x 4 one (with c as its shift)."""
    eye = M.identity(3)
    p = parts(spark, sf).withColumn("m", V.add(COL["m"], eye))
    affine = F.array(*[x for i in range(3) for x in (*[M.at(F.col("m"), i, j, 3) for j in range(3)], F.element_at("c", i + 1))], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    return exploded(p, determinant=F.array(M.determinant3(F.col("m"))), inverse=M.inverse3(F.col("m")), affine=M.affine_inverse(affine))


@query(f"WITH {PARTS_SQL}, q AS (SELECT vec_id, v[1:16] AS x, v[17:32] AS y, v[33:48] AS z, v[1] AS a, v[2] AS b, v[3] AS c, v[4] AS d FROM p), s AS (SELECT *, list_dot_product(x, x) AS xx, list_dot_product(x, y) AS xy, list_dot_product(y, y) AS yy, list_dot_product(x, z) AS xz, list_dot_product(y, z) AS yz, a*a+b*b+c*c+d*d AS f, a*d-b*c AS det FROM q) SELECT vec_id, " + listed({"first": "(xz * yy - yz * xy) / (xx * yy - xy * xy)", "second": "(yz * xx - xz * xy) / (xx * yy - xy * xy)", "alone": "xz / xx", "s1": "sqrt((f + sqrt(greatest(f*f - 4*det*det, 0))) / 2)", "s2": "abs(det) / sqrt((f + sqrt(greatest(f*f - 4*det*det, 0))) / 2)"}) + " FROM s")
def small_systems(spark, sf):
    """Least squares on two columns and on a subset of one, and the singular values of a 2 x 2 matrix."""
    v = COL["v"]
    x, y, z = (F.slice(v, 16 * k + 1, 16) for k in range(3))
    ab, s = M.least_squares2(x, y, z), M.singular_values2(F.slice(v, 1, 4))
    return parts(spark, sf).select("vec_id", r6(ab["a"], "first"), r6(ab["b"], "second"), r6(V.dot(x, z) / V.dot(x, x), "alone"), r6(F.element_at(s, 1), "s1"), r6(F.element_at(s, 2), "s2"))


QUARTER = {
    "r": ("255 - x*255//63", "(x-63)*255//64", "255 - (x-127)*255//64", "(x-191)*255//64"),
    "g": ("x*255//63", "255", "255 - (x-127)*255//64", "0"),
    "b": ("0", "(x-63)*255//64", "255", "255 - (x-191)*255//64"),
}
RAMP = {
    "r": ("0", "0", "255*(x-128)//63", "255"),
    "g": ("(255*x)//63", "255", "255", "255 - (255*(x-192))//63"),
    "b": ("255", "255 - (255*(x-64))//63", "0", "0"),
}


def quarters(table: dict, x: str, tail: str) -> str:
    return ", ".join(f"CAST(CASE WHEN {x} < 64 THEN {q[0]} WHEN {x} < 128 THEN {q[1]} WHEN {x} < 192 THEN {q[2]} ELSE {q[3]} END AS INT) AS {k}{tail}".replace("x*", f"{x}*").replace("(x", f"({x}").replace("*x", f"*{x}") for k, q in table.items())


@query(f"WITH e AS (SELECT event_id, CAST(event_id % 256 AS BIGINT) AS y, CAST(trunc(255 * (2 * atan2(value - 50, event_id % 97 - 48.5) + pi()) / (2 * pi())) AS BIGINT) AS t FROM events WHERE isfinite(value)), f AS (SELECT event_id, y, ((t % 256) + 256) % 256 AS t FROM e) SELECT event_id, {quarters(QUARTER, 'y', '1')}, {quarters(RAMP, 'y', '2')}, {quarters(QUARTER, 't', '3')} FROM f")
def palettes(spark, sf):
    """The circular palette of a byte and of an angle, and the intensity ramp."""
    e = read(spark, sf, "events").where(scalars.is_number(F.col("value")))
    byte = F.pmod("event_id", F.lit(256))
    angle = scalars.angle_palette(F.col("value") - 50, F.pmod("event_id", F.lit(97)) - 48.5)
    found = {"1": scalars.circular_palette(byte), "2": scalars.intensity_palette(byte), "3": angle}
    return e.select("event_id", *[p[k].alias(k + tail) for tail, p in found.items() for k in "rgb"])


BITS_SQL = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 9218868437227405312 WHEN 2 THEN 9218868437227405312 + event_id ELSE 9218868437227405312 + 2251799813685248 + event_id % 3 END AS w, CASE event_id % 4 WHEN 0 THEN event_id % 1000 WHEN 1 THEN 2139095040 WHEN 2 THEN 2139095040 + event_id % 4000 + 1 ELSE 2139095040 + 4194304 + event_id % 3 END AS h FROM events"


@query(f"WITH b AS ({BITS_SQL}), k AS (SELECT event_id, (w >> 52) & 2047 = 2047 AS s, w & 4503599627370495 AS f, (h >> 23) & 255 = 255 AS s2, h & 8388607 AS f2 FROM b) SELECT event_id, NOT s AS number, s AND f = 0 AS infinite, s AND f != 0 AND f < 2251799813685248 AS signalling, s AND f >= 2251799813685248 AS quiet, NOT s2 AS number2, s2 AND f2 = 0 AS infinite2, s2 AND f2 != 0 AND f2 < 4194304 AS signalling2, s2 AND f2 >= 4194304 AS quiet2 FROM k")
def nan_kinds(spark, sf):
    """Numbers, infinities and both kinds of NaN, of 64 and 32 bits."""
    i, kind = F.col("event_id"), F.pmod("event_id", F.lit(4))
    wide, narrow = F.lit(scalars.EXPONENT64), F.lit(scalars.EXPONENT32).cast("bigint")
    w = F.when(kind == 0, i).when(kind == 1, wide).when(kind == 2, wide + i).otherwise(wide + F.lit(scalars.QUIET64) + F.pmod(i, F.lit(3)))
    h = F.when(kind == 0, F.pmod(i, F.lit(1000))).when(kind == 1, narrow).when(kind == 2, narrow + F.pmod(i, F.lit(4000)) + 1).otherwise(narrow + F.lit(scalars.QUIET32) + F.pmod(i, F.lit(3)))
    a, b = scalars.nan_kind(w), scalars.nan_kind(h, wide=False)
    return read(spark, sf, "events").select("event_id", *[x[k].alias(k + tail) for x, tail in ((a, ""), (b, "2")) for k in ("number", "infinite", "signalling", "quiet")])


@query("WITH e AS (SELECT p_partkey, CAST(p_partkey % 4 AS DOUBLE) AS a, CAST(p_partkey // 4 % 4 AS DOUBLE) AS b, CAST(p_partkey // 16 % 4 AS DOUBLE) AS c FROM part), s AS (SELECT p_partkey, list_sort([a, b, c]) AS l, a + b + c AS t FROM e), q AS (SELECT p_partkey, t, CASE WHEN t = 0 THEN 0 ELSE (l[3] - l[2]) / t END AS linear, CASE WHEN t = 0 THEN 0 ELSE 2 * (l[2] - l[1]) / t END AS planar, CASE WHEN t = 0 THEN 0 ELSE 3 * l[1] / t END AS spherical FROM s) SELECT p_partkey, round(linear, 6) AS linear, round(planar, 6) AS planar, round(spherical, 6) AS spherical, CASE WHEN t = 0 THEN -1 WHEN linear > planar AND linear > spherical THEN 1 WHEN linear > planar THEN 3 WHEN planar > spherical THEN 2 ELSE 3 END AS shape FROM q")
def shape_ties(spark, sf):
    """Shares and shape of eigenvalues among which ties are common, and of those that sum to 0."""
    p = F.col("p_partkey")
    s = V.shape_coefficients(F.array(*[F.pmod(F.floor(p / 4**k), F.lit(4)).cast("double") for k in range(3)]))
    return read(spark, sf, "part").select("p_partkey", *[F.round(s[k], 6).alias(k) for k in ("linear", "planar", "spherical")], s["shape"].alias("shape"))


TILT = "exp(-((c[1]**2+c[2]**2+c[3]**2) / 2.25 + (2 - cos(2*x {0}) - cos(2*y {0})) / (1 - cos(1.0)) + (1 - cos(2*(x - y))) / (1 - cos(1.4))))"


@query(f"WITH {PARTS_SQL}, q AS (SELECT *, acos({ABSCOS.format('a', 'c')}) AS x, acos({ABSCOS.format('b', 'c')}) AS y FROM p) SELECT vec_id, " + listed({"colinear": TILT.format(""), "parallel": TILT.format("- pi() / 2")}) + " FROM q")
def axis_relations(spark, sf):
    """Colinearity and parallelity of two axes over a displacement."""
    a, b, c = (COL[k] for k in "abc")
    return parts(spark, sf).select("vec_id", r6(V.colinearity(a, b, c, 1.5, 0.5, 0.7), "colinear"), r6(V.parallelity(a, b, c, 1.5, 0.5, 0.7), "parallel"))


# The dominant axis of f^2 aa' + g^2 bb' in the plane of unit vectors a and b that are t apart lies at half of
# atan2(q sin 2t, p + q cos 2t) from a, for p = (f |a|)^2 and q = (g |b|)^2.
@query(f"WITH {PARTS_SQL}, q AS (SELECT *, abs(v[10]) AS f, abs(v[11]) AS g, acos(list_dot_product(a, b) / ({NORM.format('a')} * {NORM.format('b')})) AS t FROM p), h AS (SELECT *, atan2(g*g*list_dot_product(b, b)*sin(2*t), f*f*list_dot_product(a, a) + g*g*list_dot_product(b, b)*cos(2*t)) / 2 AS x FROM q), k AS (SELECT vec_id, acos(least(1.0, abs(cos(x)))) AS one, acos(least(1.0, abs(cos(t - x)))) AS two FROM h) SELECT vec_id, {sql6('one', 'first')}, {sql6('two', 'second')}, {sql6('least(one, two)', 'distance')} FROM k")
def combined_axes(spark, sf):
    """The combined direction of two weighted axes, by its angles to both, and their weighted angular distance."""
    a, b, f, g = COL["a"], COL["b"], F.abs(F.element_at("v", 10)), F.abs(F.element_at("v", 11))
    u = V.combined_direction(f, a, g, b)
    return parts(spark, sf).select("vec_id", r6(V.axial_angle(a, u), "first"), r6(V.axial_angle(b, u), "second"), r6(V.weighted_angular_distance(f, a, g, b), "distance"))


WPT = [f"(t - v[{10 + 0}])*{d}[1]*{d}[1] + (t - v[11])*{d}[2]*{d}[2] + (t - v[12])*{d}[3]*{d}[3] - 2*v[13]*{d}[1]*{d}[2] - 2*v[14]*{d}[1]*{d}[3] - 2*v[15]*{d}[2]*{d}[3]" for d in "abc"]


@query(f"WITH {PARTS_SQL}, q AS (SELECT *, v[10]+v[11]+v[12] AS t FROM p), w AS (SELECT vec_id, [{', '.join(WPT)}] AS w FROM q), s AS (SELECT vec_id, w, list_min(w) AS lo, list_max(w) - list_min(w) AS d FROM w) SELECT vec_id, " + listed({f"w{i}": f"CASE WHEN d > 1e-6 THEN (w[{i}] - lo) / d ELSE w[{i}] END" for i in (1, 2, 3)}) + " FROM s")
def projection_weights(spark, sf):
    """Weights of three directions by what a tensor leaves across them."""
    w = V.projection_weights(F.slice("v", 10, 6), F.array("a", "b", "c"))
    return parts(spark, sf).select("vec_id", *[r6(F.element_at(w, i), f"w{i}") for i in (1, 2, 3)])


SIGNAL = " + ".join(f"{f} * exp(-1.5 * ({' + '.join(f'{t}[{3 * i + j + 1}]*a[{i + 1}]*a[{j + 1}]' for i in range(3) for j in range(3))}))" for f, t in (("0.6", "m"), ("0.4", "n")))
MD = "(abs(v[1]) + abs(v[2]) + abs(v[3])) / 3"


@query(f"WITH {PARTS_SQL} SELECT vec_id, " + listed({"signal": SIGNAL, "fa": f"sqrt(1.5) * sqrt((abs(v[1]) - 0.1)**2 + (abs(v[2]) - 0.1)**2 + (abs(v[3]) - 0.1)**2) / {NORM.format('a')}", "top": "list_max(v[1:9])", "positive": "coalesce(list_sum(list_filter(v[1:9], lambda x: x > 0)), 0)"}) + ", CAST(len(list_filter(v[1:9], lambda x: x > 0)) AS INT) AS n_positive FROM p")
def compartment_signals(spark, sf):
    """The signal of two compartments, FA with a given mean diffusivity, and coefficients sorted with their directions."""
    v, a = COL["v"], COL["a"]
    s = V.signal(F.array(F.lit(0.6), F.lit(0.4)), F.array("m", "n"), a, F.lit(1.5))
    kept = V.sorted_positive(F.slice(v, 1, 9), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.array(i.cast("double"))))
    alphas = F.transform(kept, lambda x: x["alpha"])
    return parts(spark, sf).select(
        "vec_id", r6(s, "signal"), r6(V.fractional_anisotropy(F.transform(a, lambda x: F.abs(x)), F.lit(0.1)), "fa"), r6(F.coalesce(F.try_element_at(alphas, F.lit(1)), F.array_max(F.slice(v, 1, 9))), "top"), r6(V.total(alphas), "positive"), F.size(kept).alias("n_positive"),
    )


def lookup(table: dict, code: str, other: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


CODES = {"datatype": (strings.DATATYPES, "**ILLEGAL**"), "units": (strings.UNITS, "Unknown"), "transform": (strings.TRANSFORMS, "Unknown"), "slices": (strings.SLICE_ORDERS, "Unknown"), "orientation": (strings.ORIENTATIONS, "Unknown"), "intent": (strings.INTENTS, "Unknown")}


@query("SELECT p_partkey, " + ", ".join(f"{lookup(t, 'p_partkey', o)} AS {k}" for k, (t, o) in CODES.items()) + f", CASE WHEN {lookup(strings.DATATYPES, 'p_partkey', '')} = '' THEN 0 ELSE p_partkey END AS code FROM part")
def header_codes(spark, sf):
    """Names of the image header's codes, and a datatype's code from its name."""
    p = F.col("p_partkey")
    name = strings.datatype_name(p)
    return read(spark, sf, "part").select("p_partkey", *[strings.coded(p, t, o).alias(k) for k, (t, o) in CODES.items()], F.when(name == "**ILLEGAL**", 0).otherwise(strings.datatype_code(name)).cast("bigint").alias("code"))


@query(r"WITH n AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'a' || page_id || '.nii.gz' WHEN 1 THEN 'b' || page_id || '.hdr' WHEN 2 THEN 'c.d' || page_id || '.img' WHEN 3 THEN 'e' || page_id || '.nia' ELSE 'f' || page_id END AS f FROM pages) SELECT page_id, regexp_replace(f, '\.[^.]*$', '') || '.txt' AS changed, coalesce(nullif(regexp_extract(f, '(\.nii\.gz|\.hdr|\.img|\.nia)$', 1), ''), '') AS image, f LIKE '%.gz' AS zipped, regexp_replace(f, '(\.nii\.gz|\.hdr|\.img|\.nia)$', '') AS base, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, url AS back, len(list_filter(string_split_regex(rtrim(url, '/:?'), '[/:?]'), lambda x: true)) AS pieces, regexp_matches(lower(f), '^.*d.*\.im.$') AS named FROM n")
def file_names(spark, sf):
    """Extensions, image names, escapes, splits at any of several marks and patterns of * and ? on file names."""
    from ..sources import files

    i = F.col("page_id")
    k = F.pmod(i, F.lit(5))
    f = F.when(k == 0, F.concat(F.lit("a"), i, F.lit(".nii.gz"))).when(k == 1, F.concat(F.lit("b"), i, F.lit(".hdr"))).when(k == 2, F.concat(F.lit("c.d"), i, F.lit(".img"))).when(k == 3, F.concat(F.lit("e"), i, F.lit(".nia"))).otherwise(F.concat(F.lit("f"), i))
    rows = read(spark, sf, "pages").withColumn("f", f)
    f = F.col("f")
    return rows.select(
        "page_id", strings.change_extension(f, ".txt").alias("changed"), F.coalesce(strings.image_extension(f), F.lit("")).alias("image"), strings.is_gzip(f).alias("zipped"), strings.image_base_name(f).alias("base"), strings.escape_xml(F.col("url")).alias("escaped"),
        strings.unescape_xml(strings.escape_xml(F.col("url"))).alias("back"), F.size(strings.split_any(F.col("url"), "/:?")).cast("bigint").alias("pieces"), files.name_matches(f, "*d*.im?").alias("named"),
    )


@query("WITH t AS (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 7 + p_partkey % 5 AS b, p_partkey % 13 AS c FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') AS numbers FROM t")
def integer_sets(spark, sf):
    """Sets of integers written as `a-b,c`."""
    p = F.col("p_partkey")
    a = F.pmod(p, F.lit(7))
    text = F.concat(a, F.lit("-"), a + F.pmod(p, F.lit(5)), F.lit(", "), F.pmod(p, F.lit(13)))
    return read(spark, sf, "part").select("p_partkey", F.array_join(strings.slice_numbers(text).cast("array<string>"), ",").alias("numbers"))


@query("SELECT event_id, CAST((event_id % 4) + CASE WHEN value > 40 THEN 4 ELSE 0 END + CASE WHEN event_id % 10 > 3 THEN 8 ELSE 0 END + CASE WHEN value < 60 THEN 16 ELSE 0 END + CASE WHEN event_id % 100 >= 50 THEN 32 ELSE 0 END AS INT) AS mask, CASE WHEN value < 25 THEN 1 ELSE 2 END AS coherence FROM events WHERE isfinite(value)")
def voxel_masks(spark, sf):
    """Bit masks of shape, S0, FA, signal and histogram peak, and classes of a coherence index."""
    e = read(spark, sf, "events").where(scalars.is_number(F.col("value")))
    i, x = F.col("event_id"), F.col("value")
    fa = F.pmod(i, F.lit(10))
    mask = scalars.voxel_mask(F.pmod(i, F.lit(4)), x, fa, x, 40.0, 3.0, 60.0, 0.0)
    with_peak = F.when(F.pmod(i, F.lit(100)) >= 50, mask).otherwise(scalars.voxel_mask(F.pmod(i, F.lit(4)), x, fa, x, 40.0, 3.0, 60.0, 1000.0))
    return e.select("event_id", with_peak.alias("mask"), scalars.coherence_class(x).alias("coherence"))
