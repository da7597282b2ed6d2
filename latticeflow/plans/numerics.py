"""Queries over the numeric routines, a row at a time, with SQL for what must hold of their results.

Where a result has no closed form, the columns are numbers that it must have: traces, determinants, norms,
residuals of 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assignment, harmonics, linalg, models, solvers
from ..functions import vectors as V
from ..operators import clustering, denoise, evaluate, fits, generate, graph, neighbours, stats, tiles
from .lattices import nations
from .queries import ABSCOS, LATTICE_SQL, NORM, VEC_SQL, embeddings, lattice, query, read, rounded
from .rules import DET, PARTS_SQL, listed


def each(spark, sf, names: list[str], f: Callable[[np.ndarray], tuple], places: int = 6) -> DataFrame:
    """(vec_id, names): f of each embedding, rounded."""

    def run(batches):
        for pdf in batches:
            rows = [f(np.asarray(v, float)) for v in pdf["v"]]
            out = pd.DataFrame(rows, columns=names).astype(float).round(places) + 0.0
            yield pd.concat([pdf[["vec_id"]].reset_index(drop=True), out], axis=1)

    e = embeddings(spark, sf).select("vec_id", V.doubles("embedding").alias("v"))
    return e.mapInPandas(run, "vec_id bigint, " + ", ".join(f"{n} double" for n in names))


def off(x) -> float:
    """The largest size, to be compared with 0."""
    return float(np.abs(x).max())


def decompose(v: np.ndarray) -> tuple:
    m = v[:9].reshape(3, 3)
    wide, s = v[:12].reshape(3, 4), m + m.T
    b = m @ m.T + np.eye(3)
    values, vectors = linalg.symmetric_eigen(s)
    gv, gx = linalg.generalized_symmetric_eigen(s, b)
    av, ax = linalg.generalized_eigen(m, b)
    psd, _, kept = linalg.project_psd(s)
    q, r = linalg.qr(m)
    h, beta = linalg.householder(m[:, 0])
    p = linalg.pseudo_inverse(wide)
    big = linalg.expm(m)
    low = linalg.expm(30 * m) @ linalg.expm(-30 * m) - np.eye(3)
    j = linalg.centring(5)
    return (
        off(wide @ p @ wide - wide), values.sum(), np.prod(values), off(s @ vectors - vectors * values), off(s @ gx - b @ gx * gv), off(m @ ax - b @ ax * av), np.trace(psd) - kept.sum(), kept.min() >= 0, np.linalg.det(big), off(low) < 1e-3,
        abs(r[0, 0]), off(q @ r - m), np.linalg.norm(m[:, 0] - beta * h * (h @ m[:, 0])), np.linalg.norm(linalg.polar(m)) ** 2, (np.linalg.svd(m, compute_uv=False) ** 2).sum(), off(linalg.pseudo_inverse(b) @ b - np.eye(3)), linalg.biased_form(m, v[:3], v[3:6]),
        off(j @ np.ones(5)) + off(j @ j - j),
    )


SYM = "[2*m[1], m[2]+m[4], m[3]+m[7], m[2]+m[4], 2*m[5], m[6]+m[8], m[3]+m[7], m[6]+m[8], 2*m[9]]"
FORM3 = " + ".join(f"m[{3 * i + j + 1}]*(a[{i + 1}]-b[{i + 1}])*(a[{j + 1}]-b[{j + 1}])" for i in range(3) for j in range(3))
DECOMPOSED = {
    "pinv_left": "0.0", "eigen_sum": "2 * (m[1] + m[5] + m[9])", "eigen_product": "sd", "eigen_left": "0.0", "general_left": "0.0", "general2_left": "0.0", "psd_left": "0.0", "psd_ok": "1.0", "exp_det": "exp(m[1] + m[5] + m[9])", "exp_back": "1.0",
    "qr_first": "sqrt(m[1]**2 + m[4]**2 + m[7]**2)", "qr_left": "0.0", "reflected": "sqrt(m[1]**2 + m[4]**2 + m[7]**2)", "polar": "3.0", "squares": "list_dot_product(m, m)", "inverse_left": "0.0", "biased": f"0.5 * ({FORM3})", "centring_left": "0.0",
}


@query(f"WITH p0 AS (SELECT * FROM (WITH {PARTS_SQL} SELECT * FROM p)), s AS (SELECT vec_id, {SYM} AS m FROM p0), d AS (SELECT vec_id, {DET} AS sd FROM s) SELECT p0.vec_id, {listed(DECOMPOSED)} FROM p0 JOIN d USING (vec_id)")
def matrix_decompositions(spark, sf):
    """Pseudo-inverses, eigenproblems (symmetric, general and of a pair), projection to semi-definite, exponentials, QR, reflections, polar parts and centring."""
    return each(spark, sf, list(DECOMPOSED), decompose)


def turn(v: np.ndarray) -> tuple:
    a, b = v[:3], v[3:6]
    r = linalg.from_to_rotation(a, b)
    to = r @ (a / np.linalg.norm(a))
    angles = linalg.rotation_from_angles(v[6], v[7])
    q = linalg.rotation_quaternion(r)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = angles * [1.5, 2.0, 2.5], v[8:11]
    p = linalg.quaternion_from_affine(m)
    back = linalg.affine_from_quaternion(p["b"], p["c"], p["d"], p["offset"], p["sizes"], p["qfac"])
    codes = linalg.orientation_codes(np.diag([1.0 if v[0] > 0 else -1.0, 1.0 if v[1] > 0 else -1.0, 1.0 if v[2] > 0 else -1.0, 1.0]))
    o = linalg.orthogonal_affine(np.array([a, b, np.zeros(3)]))
    return (*to, np.trace(r), *angles[:, 2], off(linalg.quaternion_rotation(q) - r), off(back - m), *p["sizes"], *codes, off(o[:3, :3] @ o[:3, :3].T - np.eye(3)))


TURNED = {f"to{i}": f"b[{i}] / {NORM.format('b')}" for i in (1, 2, 3)} | {
    "trace": f"1 + 2 * list_dot_product(a, b) / ({NORM.format('a')} * {NORM.format('b')})", "z1": "cos(v[7]) * sin(v[8])", "z2": "sin(v[7]) * sin(v[8])", "z3": "cos(v[8])", "quaternion_left": "0.0", "affine_left": "0.0",
    "size1": "1.5", "size2": "2.0", "size3": "2.5", "code1": "CASE WHEN v[1] > 0 THEN 1.0 ELSE 2.0 END", "code2": "CASE WHEN v[2] > 0 THEN 3.0 ELSE 4.0 END", "code3": "CASE WHEN v[3] > 0 THEN 5.0 ELSE 6.0 END", "orthogonal_left": "0.0",
}


@query(f"WITH {PARTS_SQL} SELECT vec_id, {listed(TURNED)} FROM p")
def rotations(spark, sf):
    """The rotation between two vectors, of two angles, of a quaternion; affines to quaternions and back, orientation codes and orthogonal rows."""
    return each(spark, sf, list(TURNED), turn)


def spread(v: np.ndarray) -> tuple:
    d = v[:3] / np.linalg.norm(v[:3])
    row = harmonics.design(d[None], 2)[0]
    vertex, normal = harmonics.surface(np.array([1.0, 0, 0, 0, 0, 0]), d[None], 2, normals=True)
    azimuth, elevation, size = harmonics.angles(v[:3])
    zonal = harmonics.rotational(v[3:6])
    return (*row, harmonics.value(azimuth[0], elevation[0], 2, 1), row @ v[6:12], *vertex[0], off(normal[0] - d) < 1e-4, azimuth[0], elevation[0], size[0], *zonal)


X, Y, Z = (f"(a[{i}] / {NORM.format('a')})" for i in (1, 2, 3))
SH = ["1 / sqrt(4 * pi())", f"sqrt(15 / pi()) / 2 * {X} * {Y}", f"-sqrt(15 / pi()) / 2 * {Y} * {Z}", f"sqrt(5 / pi()) / 4 * (3 * {Z} * {Z} - 1)", f"-sqrt(15 / pi()) / 2 * {X} * {Z}", f"sqrt(15 / pi()) / 4 * ({X} * {X} - {Y} * {Y})"]
HARMONIC = {f"y{i}": e for i, e in enumerate(SH)} | {
    "y21": SH[4], "amplitude": " + ".join(f"({e}) * v[{7 + i}]" for i, e in enumerate(SH)), "vx": f"{X} / sqrt(4 * pi())", "vy": f"{Y} / sqrt(4 * pi())", "vz": f"{Z} / sqrt(4 * pi())", "normal_ok": "1.0",
    "azimuth": "atan2(a[2], a[1])", "elevation": f"acos({Z})", "size": NORM.format("a"), "zonal0": "v[4] / sqrt(1 / (4 * pi()))", "zonal1": "v[5] / sqrt(5 / (4 * pi()))", "zonal2": "v[6] / sqrt(9 / (4 * pi()))",
}


@query(f"WITH {PARTS_SQL} SELECT vec_id, {listed(HARMONIC)} FROM p")
def spherical_harmonics(spark, sf):
    """Harmonics up to degree 2 in closed form, amplitudes, surfaces with normals, angles of vectors and rotational harmonics."""
    return each(spark, sf, list(HARMONIC), spread)


def simulate(v: np.ndarray) -> tuple:
    a, b, c = v[:3], v[3:6], v[6:9]
    g = np.stack([a, b])
    s = models.signal([0.7, 0.3], [models.tensor(c, 1.7, 0.3), models.tensor(a, 1.7, 0.3)], g, 0.8)
    phi = models.basis(g, np.stack([c, a]), 0.8, 1.7, 0.3)
    o = models.odf([1.0], [models.tensor(c, 1.7, 0.3)], g)
    q = models.smoothing_matrix(np.eye(3))
    return (*s, *phi.reshape(-1), *o, models.rician(s, 0.0, np.random.default_rng(0))[0], np.trace(q), np.trace(models.gini_matrix(7)), models.profile_objective((0.3, 1.4), s, g, np.stack([c, a]), np.array([0.7, 0.3]), 0.8))


def decay(g: str, d: str) -> str:
    return f"exp(-0.8 * (1.4 * (list_dot_product({g}, {d}) / {NORM.format(d)})**2 + 0.3 * list_dot_product({g}, {g})))"


def lobe(g: str) -> str:
    return f"1 / sqrt(list_dot_product({g}, {g}) / 0.3 + (1 / 1.7 - 1 / 0.3) * (list_dot_product({g}, c) / {NORM.format('c')})**2)"


SIMULATED = {
    "s0": f"0.7 * {decay('a', 'c')} + 0.3 * {decay('a', 'a')}", "s1": f"0.7 * {decay('b', 'c')} + 0.3 * {decay('b', 'a')}", "p00": decay("a", "c"), "p01": decay("a", "a"), "p10": decay("b", "c"), "p11": decay("b", "a"),
    "o0": f"{lobe('a')} / ({lobe('a')} + {lobe('b')})", "o1": f"{lobe('b')} / ({lobe('a')} + {lobe('b')})", "noiseless": f"0.7 * {decay('a', 'c')} + 0.3 * {decay('a', 'a')}", "smoothing": "3.0", "gini": "6.0", "objective": "0.0",
}


@query(f"WITH {PARTS_SQL} SELECT vec_id, {listed(SIMULATED)} FROM p")
def signal_models(spark, sf):
    """Signals of tensors, basis functions, orientation distributions, noise of none, and the matrices of the regularisers."""
    return each(spark, sf, list(SIMULATED), simulate)


def solve(v: np.ndarray) -> tuple:
    f, eye = v[:6], np.eye(6)
    plus = np.maximum(f, 0)
    half = solvers.nnls_subset(eye, f, np.array([0, 1, 2]))[0]
    x, _ = solvers.nnsls_pgs(eye, f, 0.05)
    least = solvers.ternary_search(lambda t: (t - f[0]) ** 2, -10.0, 10.0)
    found, value = solvers.bfgs(lambda t: ((t - f) ** 2).sum(), lambda t: 2 * (t - f), np.zeros(6))
    bounded = solvers.lars(eye, f, 0.1)
    scaled, k = solvers.nn_lars_scaled(eye, np.abs(f) + 0.5, 1e-9)
    fit, _, rmse = models.fit_basis(f, eye)
    return (
        solvers.nnls(eye, f)[0].sum(), solvers.nnls(eye, f)[1], half.sum(), off(half[3:]), x.sum(), solvers.nn_lars(eye, f, 0.05).sum(), np.abs(bounded).sum(), solvers.nnls_robust(eye, f, "geman")[0].sum(), off(solvers.nnsls(eye, f, 0.0)[0] - plus),
        round(least, 4), off(found - f) < 1e-4, value < 1e-6, off(scaled - k * (np.abs(f) + 0.5)) < 1e-3, fit.sum(), rmse, solvers.least_squares(eye, f).sum(), solvers.least_squares(eye, f, np.array([0, 3])).sum(),
    )


PLUS = "list_sum(list_transform(v[1:6], lambda x: greatest(x, 0)))"
MINUS = "list_sum(list_transform(v[1:6], lambda x: least(x, 0) ** 2))"
SOLVED = {
    "nnls": PLUS, "nnls_error": MINUS, "subset": "list_sum(list_transform(v[1:3], lambda x: greatest(x, 0)))", "subset_left": "0.0", "pgs": "list_sum(list_transform(v[1:6], lambda x: greatest(x - 0.05, 0)))", "nn_lars": "list_sum(list_transform(v[1:6], lambda x: greatest(x - 0.05, 0)))",
    "lars": "least(0.1, list_sum(list_transform(v[1:6], lambda x: abs(x))))", "robust": PLUS, "sparse_left": "0.0", "ternary": "round(v[1], 4)", "bfgs_ok": "1.0", "bfgs_value": "1.0", "scaled_ok": "1.0", "fit": PLUS, "rmse": f"sqrt({MINUS} / 6)", "least": "list_sum(v[1:6])", "least_of_two": "v[1] + v[4]",
}


@query(f"WITH {PARTS_SQL} SELECT vec_id, {listed(SOLVED)} FROM p")
def solver_answers(spark, sf):
    """Every solver on an identity basis, where its answer is a threshold of the signal, and both minimisers on a parabola."""
    return each(spark, sf, list(SOLVED), solve)


def group(v: np.ndarray) -> tuple:
    d = generate.sphere(60)
    x, y = abs(v[0]) + 0.01, abs(v[1]) + 0.01
    alpha = np.zeros(60)
    alpha[3], alpha[40] = x, y
    found = models.peaks(alpha, d)
    labels = models.split_by_angle(alpha, d, 0.1)
    halves = evaluate.capacity_split(np.array([x, y, 0.0]), np.eye(3), 2)
    centre, amount = models.centroid(d, alpha, [3])
    spikes = [np.eye(60)[3], np.eye(60)[40]]
    return (len(found), found[0][1], labels[3] == (0 if x >= y else 1), (labels >= 0).sum(), halves[2] == -1, amount, off(np.abs(centre @ d[3]) - 1), models.profile_distance(*spikes, d), models.entropy(np.array([x, y])), assignment.emd_with_entropy(np.array([x, 0.0]), np.array([0.0, y]), np.array([[0.0, 1.0], [1.0, 0.0]])))


FIRST, SECOND = "(abs(v[1]) + 0.01)", "(abs(v[2]) + 0.01)"
TOP, LOW = f"greatest({FIRST}, {SECOND})", f"least({FIRST}, {SECOND})"


def spot(k: int) -> list[str]:
    z = f"(1 - {k + 0.5} / 60)"
    t = f"(pi() * (1 + sqrt(5)) * {k + 0.5})"
    return [f"sqrt(1 - {z} * {z}) * cos{t}", f"sqrt(1 - {z} * {z}) * sin{t}", z]


ANGLE = "acos(abs(" + " + ".join(f"({x}) * ({y})" for x, y in zip(spot(3), spot(40), strict=True)) + "))"
GROUPED = {
    "groups": f"CASE WHEN {LOW} > 0.3 * {TOP} THEN 2.0 ELSE 1.0 END", "share": f"CASE WHEN {LOW} > 0.3 * {TOP} THEN {TOP} / ({TOP} + {LOW}) ELSE 1.0 END", "heaviest": "1.0", "labelled": "2.0", "unlabelled": "1.0", "amount": FIRST, "centre_left": "0.0", "distance": ANGLE,
    "entropy": f"-({FIRST} / ({FIRST} + {SECOND}) * ln({FIRST} / ({FIRST} + {SECOND})) + {SECOND} / ({FIRST} + {SECOND}) * ln({SECOND} / ({FIRST} + {SECOND})))", "mass": f"1 + abs({FIRST} - {SECOND})",
}


@query(f"WITH {PARTS_SQL} SELECT vec_id, {listed(GROUPED)} FROM p")
def coefficient_groups(spark, sf):
    """Grouping, splitting and centres of coefficients, and distances and entropies of their profiles."""
    return each(spark, sf, list(GROUPED), group)


@query(f"WITH e AS ({VEC_SQL}) SELECT vec_id, CAST(list_position(v[1:5], list_max(v[1:5])) - 1 AS BIGINT) AS label FROM e")
def labels_of_memberships(spark, sf):
    """The first largest membership of each row."""
    return embeddings(spark, sf).select("vec_id", clustering.labels_from_probs(F.slice(V.doubles("embedding"), 1, 5)).cast("bigint").alias("label"))


@query("SELECT 'mesh' AS what, 18.0 AS a, 32.0 AS b UNION ALL SELECT 'spread', 5.0, 1.0 UNION ALL SELECT 'near', 1.0, 1.0 UNION ALL SELECT 'geodesic', 5.0, 15.0 UNION ALL SELECT 'scaling', 0.0, 2.0 UNION ALL SELECT 'eigen', 3.0, 3.0 UNION ALL SELECT 'icp', 0.0, 12.0 UNION ALL SELECT 'discrete', 3.0, 5.0")
def small_geometry(spark, sf):
    """Meshes, directions apart and near, paths along a line, scaling of distances, leading eigenpairs, alignment and discretised axes of fixed shapes."""
    v, t = linalg.subdivide_sphere(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1.0]]), np.array([[0, 1, 2], [1, 3, 2], [3, 4, 2], [4, 0, 2], [1, 0, 5], [3, 1, 5], [4, 3, 5], [0, 4, 5]]))
    far = generate.spread_directions(generate.sphere(100), 5, 0.5)
    apart = linalg.angle_matrix(far) + 10 * np.eye(len(far))
    near = generate.direction_near(np.array([0, 0, 1.0]), 30.0, np.random.default_rng(1))
    line = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    path = clustering.geodesic(line, 2)
    x = clustering.multidimensional_scaling(line, 2)
    values, vectors = clustering.largest_eigenpairs(np.diag([1.0, 2.0, 3.0]), 2)
    shape = np.random.default_rng(2).standard_normal((12, 3))
    moved, error = assignment.icp(shape, shape @ linalg.rotation_from_angles(0.02, 0.01).T)
    label = clustering.discretize(np.eye(3)[[0, 0, 1, 2, 2]] + 1e-3)
    left = off(np.linalg.norm(x[:, None] - x[None], axis=2) - line)
    rows = [
        ("mesh", float(len(v)), float(len(t))), ("spread", float(len(far)), float(apart.min() >= 0.5)), ("near", float(abs(np.degrees(np.arccos(min(1.0, abs(near[2])))) - 30) < 1), round(float(np.linalg.norm(near)), 6)), ("geodesic", float(path[0, 5]), float(path[0].sum())),
        ("scaling", abs(round(left, 6)), float(x.shape[1] + 1 if x.shape[1] == 1 else x.shape[1])), ("eigen", float(values[0]), float(np.argmax(np.abs(vectors[:, 0])) + 1)), ("icp", abs(round(error, 6)), float(len(moved))), ("discrete", float(len(set(label.tolist()))), float(len(label))),
    ]
    return spark.createDataFrame(rows, "what string, a double, b double")


@query("WITH n AS (SELECT count(*) AS n FROM orders), l AS (SELECT count(DISTINCT label) AS k FROM embeddings) SELECT 'sample' AS what, 100 AS a, 100 AS b UNION ALL SELECT 'permutation', n, n FROM n UNION ALL SELECT 'labels', CAST(ceil((k - 1) * 0.5) AS BIGINT), k FROM l UNION ALL SELECT 'allowed', r, a FROM (SELECT x - 3 AS r, x AS a FROM range(8, 12) t(x))")
def samples(spark, sf):
    """Samples without replacement, permutations, shares of labels, and the n-th number that is allowed."""
    o = read(spark, sf, "orders").select("o_orderkey")
    count = lambda df, name: df.agg(F.count("*").alias("a"), F.count_distinct("o_orderkey").alias("b")).select(F.lit(name).alias("what"), "a", "b")
    chosen = stats.category_sample(embeddings(spark, sf), "label", 0.5).agg(F.count_distinct(F.when(F.col("chosen"), F.col("label"))).alias("a"), F.count_distinct("label").alias("b")).select(F.lit("labels").alias("what"), "a", "b")
    allowed = spark.createDataFrame([("allowed", k, stats.nth_allowed(k, {0, 3, 7})) for k in range(5, 9)], "what string, a bigint, b bigint")
    return count(stats.sample_no_replacement(o, 100, 7), "sample").unionByName(count(stats.random_permutation(o, 7), "permutation")).unionByName(chosen).unionByName(allowed)


@query("SELECT 'residual' AS what, 0.0 AS value UNION ALL SELECT 'largest', 1.0")
def eigenpairs(spark, sf):
    """The leading eigenpair of a normalised graph: its vector is the root of the degrees, its value 1."""
    g, x = nations(spark, sf)
    both = g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    m = graph.settle(graph.normalized_cut(both))
    root = graph.row_sums(both).select(F.col("src").alias("id"), F.sqrt("total").alias("v"))
    _, value = graph.power_iteration(m, x.select("id"), 30, 1.0)
    residual = graph.eigen_residual(m, root, 1.0).select(F.lit("residual").alias("what"), F.round("residual", 6).alias("value"))
    return residual.unionByName(spark.createDataFrame([("largest", round(value, 1))], "what string, value double"))


@query("WITH f AS (SELECT p_partkey AS id, p_partkey % 4 AS mask, 1.0 * (p_partkey % 7) AS l1, 0.5 * (p_partkey % 5) AS l2, 0.25 * (p_partkey % 3) AS l3 FROM part) SELECT round(avg(l1), 6) AS l1, round(avg(l2), 6) AS l2, round(avg(l3), 6) AS l3, count(*) AS n FROM f WHERE mask & 3 = 1")
def average_profile(spark, sf):
    """The mean eigenvalues of voxels that a mask picks."""
    p = F.col("p_partkey")
    ev = F.array((p % 7).cast("double"), (p % 5) * 0.5, (p % 3) * 0.25)
    return rounded(fits.average_profile(read(spark, sf, "part").select((p % 4).cast("int").alias("mask"), ev.alias("ev")), "mask", 3, 1), "l1", "l2", "l3")


@query("WITH g AS (SELECT s, r, c FROM range(9) a(s), range(9) b(r), range(9) d(c)), d AS (SELECT *, least(greatest(c, 1), 7) AS t1, least(greatest(r, 0), 8) AS t2 FROM g), h AS (SELECT s, r, c, (s - 4) ** 2 + (r - 4) ** 2 + (c - t1) ** 2 < 4.5 AS one, (s - 4) ** 2 + (c - 4) ** 2 + (r - t2) ** 2 < 4.5 AS two FROM d) SELECT CAST(s AS INT) AS slice, CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, CAST(one AS INT) + CAST(two AS INT) AS n, CASE WHEN one AND two THEN 0.5 WHEN one OR two THEN 1.0 END AS share FROM h")
def fields_of_paths(spark, sf):
    """Voxels near two crossing paths, and their compartments."""
    paths = [np.array([[4.0, 4.0, 1.0], [4.0, 4.0, 7.0]]), np.array([[4.0, 0.0, 4.0], [4.0, 8.0, 4.0]])]
    f = generate.field_from_paths(spark, paths, math.sqrt(4.5), 9)
    c = F.col("compartments")
    return f.select("slice", "row", "col", F.size(c).alias("n"), F.try_element_at(c, F.lit(1))["fraction"].alias("share"))


@query("SELECT 2 * 6 * 6 AS voxels, 2 * 6 * 6 * 2 - 36 AS compartments, TRUE AS apart, TRUE AS whole, TRUE AS unit, 24 AS places, 1.0 AS s0")
def random_fields(spark, sf):
    """What random fields must hold: counts, angles apart, fractions that sum to 1, unit axes and signals of a length."""
    from ..operators import fields

    f = generate.random_field(spark, 2, 6, 6, 30.0, seed=5, crossing=lambda s, r, c: s == 0)
    c = F.col("compartments")
    one = f.agg(
        F.count("*").alias("voxels"), F.sum(F.size(c)).alias("many"), (F.min(fields.smallest_angle(c)) >= 30).alias("apart"), (F.max(F.abs(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["fraction"]) - 1)) < 1e-9).alias("whole"),
        (F.max(F.abs(V.norm(F.element_at(c, 1)["dir"]) - 1)) < 1e-9).alias("unit"),
    )
    s = generate.simulate(f, generate.sphere(24), 1500.0, 25.0, 5).agg(F.max(F.size("dw")).alias("places"), F.max("s0").alias("s0"))
    return one.withColumnRenamed("many", "compartments").join(F.broadcast(s))


@query("SELECT CAST(k AS INT) AS k, 1.0 AS spread FROM range(4) t(k)")
def discriminant_spread(spark, sf):
    """Within the classes every discriminant direction has a mean square of 1."""
    e = embeddings(spark, sf)
    w = clustering.discriminants(e, "embedding", "label", 4)
    p = clustering.projected(e, "embedding", w).select("label", F.posexplode("projected").alias("k", "x"))
    inside = p.groupBy("label", "k").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return inside.groupBy("k").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("spread"))


KINDS = ("tv_l2", "huber_l2", "tgv_l2")


@query(f"WITH {LATTICE_SQL}, m AS (SELECT slice, round(avg(v), 4) AS mean FROM lat GROUP BY slice HAVING count(*) = 200) SELECT kind, slice, mean FROM m, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in KINDS)}) k(kind) WHERE slice < 3")
def filter_means(spark, sf):
    """The variational filters move no slice's mean."""
    rows = lattice(spark, sf).where("slice < 3")
    out = None
    for kind in KINDS:
        one = denoise.filter_slices(rows, "v", kind, 0.05).groupBy("slice").agg(F.round(F.avg("filtered"), 4).alias("mean"), F.count("*").alias("n"))
        one = one.where("n = 200").select(F.lit(kind).alias("kind"), "slice", "mean")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LATTICE_SQL}, one AS (SELECT *, v > 950 AS k FROM lat), e1 AS (SELECT p.id, p.slice, p.row_, p.col_, bool_and(q.k) AS k FROM one p JOIN one q ON abs(p.slice - q.slice) <= 1 AND abs(p.row_ - q.row_) <= 1 AND abs(p.col_ - q.col_) <= 1 GROUP BY ALL) SELECT p.slice, p.row_ AS \"row\", p.col_ AS col, bool_and(q.k) AS kept FROM e1 p JOIN e1 q ON abs(p.slice - q.slice) <= 1 AND abs(p.row_ - q.row_) <= 1 AND abs(p.col_ - q.col_) <= 1 GROUP BY ALL")
def lattice_erode_twice(spark, sf):
    """Two passes of erosion."""
    return tiles.erode(lattice(spark, sf).withColumn("on", F.col("v") > 950), "on", 2)


@query(f"WITH e AS ({VEC_SQL}) SELECT a.vec_id AS i, b.vec_id AS j, round(acos({ABSCOS.format('a.v', 'b.v')}), 6) AS axial, round(acos(greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / ({NORM.format('a.v')} * {NORM.format('b.v')})))), 6) AS plain FROM e a, e b WHERE a.vec_id < 20 AND b.vec_id < 20 AND a.vec_id != b.vec_id")
def angle_matrices(spark, sf):
    """Angles between directions, as axes and as they are, of twenty rows."""
    e = embeddings(spark, sf).where("vec_id < 20").orderBy("vec_id").select("vec_id", V.doubles("embedding")).collect()
    ids, d = [r[0] for r in e], np.array([r[1] for r in e])
    axial, plain = linalg.angle_matrix(d), linalg.angle_matrix(d, axial=False)
    rows = [(ids[i], ids[j], round(float(axial[i, j]), 6), round(float(plain[i, j]), 6)) for i in range(len(ids)) for j in range(len(ids)) if i != j]
    return spark.createDataFrame(rows, "i bigint, j bigint, axial double, plain double")
