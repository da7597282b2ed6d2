"""Clustering, discriminants, scaling and spectral methods.

Data stay distributed; what comes to the driver are means, scatter matrices and other summaries whose size
depends on the number of clusters and features only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions import vectors as V
from . import graph, krylov


def memberships(x: np.ndarray, means: np.ndarray, exponent: float, axial: bool = False) -> np.ndarray:
    """Rows of memberships; exponent 1 is hard (first of the nearest)."""
    d = 1 - (x @ means.T) ** 2 if axial else ((x[:, None] - means[None]) ** 2).sum(2)
    if exponent <= 1:
        return np.eye(len(means))[np.argmin(d, axis=1)]
    w = (1 / (1e-6 + d)) ** (1 / (exponent - 1))
    return w / w.sum(1, keepdims=True)


def seed_means(df: DataFrame, vector: str, k: int, order: str, bound: int = 20_000) -> np.ndarray:
    """Farthest-first means from a bounded sample: the first `bound` rows by a hash of the order column."""
    rows = df.select(V.doubles(vector).alias("v")).orderBy(F.xxhash64(order), order).limit(bound).collect()
    x = np.array([r[0] for r in rows])
    if not len(x):
        return x
    means = [x[0]]
    while len(means) < k:
        d = np.min([((x - m) ** 2).sum(1) for m in means], axis=0)
        means.append(x[int(np.argmax(d))])
    return np.array(means)


def fuzzy_kmeans(df: DataFrame, key: str, vector: str, k: int, exponent: float = 2.0, rounds: int = 30, tolerance: float = 1e-3, axial: bool = False, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((key, label, probs), means).  Each round sends the means out and gets k partial sums a task back.

    start: means to begin with, in place of farthest-first seeds.  Rows without a vector have no part in it.
    """
    x = df.where(F.col(vector).isNotNull()).select(key, (V.normalize(V.doubles(vector)) if axial else V.doubles(vector)).alias("v"))
    means = seed_means(x, "v", k, key) if start is None else np.array(start, float)
    if not len(means):
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, label int, probs array<double>"), means
    d = means.shape[1]

    def sums(batches: Iterator[pd.DataFrame], m=None) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            p = memberships(v, m, exponent, axial) ** max(exponent, 1.0)
            total = np.stack([(v * p[:, [j]]).T @ v if axial else np.broadcast_to(p[:, j] @ v, (1, d)) for j in range(k)])
            yield pd.DataFrame({"j": range(k), "s": [t.reshape(-1) for t in total], "w": p.sum(0)})

    for _ in range(rounds):
        parts = x.mapInPandas(lambda it, m=means: sums(it, m), "j int, s array<double>, w double")
        got = parts.select("j", "w", F.posexplode("s").alias("i", "s")).groupBy("j", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).toPandas().sort_values(["j", "i"])
        new = means.copy()
        for j, rows in got.groupby("j"):
            w = rows["w"].iloc[0]
            if w > 0:
                s = rows["s"].to_numpy()
                new[j] = linalg.symmetric_eigen(s.reshape(d, d))[1][:, -1] if axial else s / w
        moved = np.sqrt(((new - means) ** 2).sum(1)).max() if not axial else (1 - (new * means).sum(1) ** 2).max()
        means = new
        if moved < tolerance:
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = memberships(np.stack(pdf["v"].to_numpy()), means, exponent, axial)
            yield pd.DataFrame({key: pdf[key], "label": np.argmax(p, axis=1).astype(np.int32), "probs": list(p)})

    return x.mapInPandas(label, f"{key} {df.schema[key].dataType.simpleString()}, label int, probs array<double>"), means


def labels_from_probs(p):
    """First largest membership, as a column."""
    return V.arg_max(p)


def scatter(df: DataFrame, vector: str, label: str | None = None) -> tuple[np.ndarray, dict]:
    """(sum of vv', {label: (n, mean)}): one d x d matrix and one mean for each label, summed map-side."""
    df = df.where(F.col(vector).isNotNull())
    first = df.select(F.size(vector)).first()
    if first is None:
        return np.zeros((0, 0)), {}
    d = first[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, per = np.zeros((d, d)), {}
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            total += v.T @ v
            for c, at in pdf.groupby("y", dropna=False).indices.items():
                n, s = per.get(c, (0, np.zeros(d)))
                per[c] = n + len(at), s + v[at].sum(0)
        yield pd.DataFrame({"y": [None, *per], "n": [0, *[n for n, _ in per.values()]], "s": [total.reshape(-1), *[s for _, s in per.values()]]}).astype({"y": "Int64"})

    y = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
    parts = df.select(V.doubles(vector).alias("v"), y.alias("y")).mapInPandas(run, "y bigint, n bigint, s array<double>")
    sums = parts.select("y", "n", F.posexplode("s").alias("i", "s")).groupBy("y", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    total = sums[sums["y"].isna()].sort_values("i")["s"].to_numpy().reshape(d, d)
    return total, {int(c): (int(r["n"].iloc[0]), r.sort_values("i")["s"].to_numpy() / r["n"].iloc[0]) for c, r in sums[sums["y"].notna()].groupby("y")}


def discriminants(df: DataFrame, vector: str, label: str, directions: int, least: float = 1e-6, exclude: DataFrame | None = None, weight: float = 0.0) -> np.ndarray:
    """Rows w: high-dimensional LDA.  Directions between classes (eigenvalues under `least` dropped) come first,
    then those in which the within-class scatter is least.  exclude: unlabelled rows whose centred scatter
    joins the within-class one with a weight."""
    total, per = scatter(df, vector, label)
    more = 0.0
    if exclude is not None and weight:
        t, p = scatter(exclude, vector)
        k, m = p[0]
        more = weight * (t - k * np.outer(m, m))
    return discriminants_of(total, per, directions, least, more)


def discriminants_of(total: np.ndarray, per: dict, directions: int, least: float = 1e-6, more: np.ndarray | float = 0.0) -> np.ndarray:
    """discriminants() of what scatter() gives; more: joins the within-class scatter."""
    n = sum(k for k, _ in per.values())
    grand = sum(k * m for k, m in per.values()) / n
    between = sum(k * np.outer(m - grand, m - grand) for k, m in per.values())
    within = total - sum(k * np.outer(m, m) for k, m in per.values()) + more
    values, vectors = linalg.symmetric_eigen(between / n)
    keep = np.flatnonzero(values > least)[::-1]
    z = vectors[:, keep] / np.sqrt(values[keep])
    wv, wu = linalg.symmetric_eigen(z.T @ (within / n) @ z)
    w = (z @ wu) / np.sqrt(np.maximum(wv, least))
    return w.T[:directions]


def projected(df: DataFrame, vector: str, w: np.ndarray, out: str = "projected") -> DataFrame:
    d = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    return df.withColumn(out, V.project(V.doubles(vector), d))


def folds_of(df: DataFrame, key: str, folds: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def cross_validate(df: DataFrame, key: str, vector: str, label: str, directions: int, folds: int = 5) -> DataFrame:
    """(fold, error) of nearest-centroid classification in discriminant space; all folds in two scans."""
    from . import folds as over

    counts = over.discriminant_counts(df, vector, label, directions, F.pmod(F.xxhash64(key), F.lit(folds)), folds)
    return over.fold_errors(counts).select("fold", F.col("out_error").alias("error"))


def cross_validation_summary(errors: DataFrame) -> DataFrame:
    """Mean and sample sd of the folds' errors."""
    return errors.agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"))


def multidimensional_scaling(distances: np.ndarray, k: int, legacy_scale: bool = False, least: float = 1e-9) -> np.ndarray:
    """Classical scaling of one distance matrix: eigenvectors of the doubly centred squares times the root of their values."""
    j = linalg.centring(len(distances))
    values, vectors = linalg.symmetric_eigen(-0.5 * j @ (distances**2) @ j)
    keep = np.flatnonzero(values > least)[::-1][:k]
    return vectors[:, keep] * (values[keep] if legacy_scale else np.sqrt(values[keep]))


def largest_eigenpairs(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = linalg.symmetric_eigen(m)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def euclidean_scaling(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, x): classical scaling of the Euclidean distances between all rows of a table of any size.

    The doubly centred squares are the products of the centred rows, so the axes are the leading eigenvectors of
    their d x d scatter, and a row's place is its projection on them.
    """
    kind = df.schema[key].dataType.simpleString()
    df = df.where(F.col(vector).isNotNull())
    total, per = scatter(df, vector)
    if not per:
        return df.sparkSession.createDataFrame([], f"{key} {kind}, x array<double>")
    n, mean = per[0]
    values, vectors = linalg.symmetric_eigen(total - n * np.outer(mean, mean))
    axes = vectors[:, np.flatnonzero(values > 1e-9)[::-1][:k]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            yield pd.DataFrame({key: pdf[key], "x": list((v - mean) @ axes)})

    return df.select(key, V.doubles(vector).alias("v")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, x array<double>")


def spectral_embedding(edges: DataFrame, vertices: DataFrame, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """(id, x): leading eigenvectors of the normalised-cut matrix, to a tolerance."""
    return krylov.leading_eigenpairs(graph.normalized_cut(edges), vertices, dim, tolerance)[1]


def discretize(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Labels of rows of eigenvectors by alternating rotation and nearest axis."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = u.shape[1]
    r = np.zeros((k, k))
    r[:, 0], c = u[0], np.zeros(len(u))
    for j in range(1, k):
        c += np.abs(u @ r[:, j - 1])
        r[:, j] = u[int(np.argmin(c))]
    last = 0.0
    for _ in range(rounds):
        label = np.argmax(u @ r, axis=1)
        a, s, b = np.linalg.svd(np.eye(k)[label].T @ u)
        if abs(s.sum() - last) < 1e-12:
            break
        last = s.sum()
        r = b.T @ a.T
    return label


def spectral_clusters(edges: DataFrame, vertices: DataFrame, k: int, dim: int = 2) -> DataFrame:
    """(id, label): spectral embedding and hard k-means on it."""
    x = spectral_embedding(edges, vertices, dim)
    labels, _ = fuzzy_kmeans(x, "id", "x", k, exponent=1.0)
    return labels.select("id", "label")


def kernel_memberships(kernel: DataFrame, start: DataFrame, lam: float, mu: float, rounds: int = 20, tolerance: float = 1e-5) -> DataFrame:
    """(id, probs): entropy-controlled memberships on a graph kernel, Jacobi rounds.

    Each round moves a vertex to the kernel mean of its neighbours' memberships, sharpened by mu.
    """
    now = graph.settle(start.select("id", "probs"))
    sums = graph.settle(graph.row_sums(kernel).select(F.col("src").alias("id"), "total"))
    for _ in range(rounds):
        parts = kernel.join(now.withColumnRenamed("id", "dst"), "dst").select("src", "w", F.posexplode("probs").alias("k", "p"))
        near = parts.groupBy(F.col("src").alias("id"), "k").agg(F.sum(F.col("w") * F.col("p")).alias("q")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("qs"))
        rows = now.join(near, "id", "left").join(sums, "id", "left")
        mixed = F.zip_with("probs", "qs", lambda p, q: F.greatest(F.lit(0.0), (p + lam * q["q"]) / F.greatest(F.lit(1e-12), 1 + lam * F.col("total") - mu)))
        rows = rows.select("id", "probs", F.coalesce(mixed, F.col("probs")).alias("m")).withColumn("t", V.total(F.col("m")))
        new = graph.settle(rows.select("id", F.when(F.col("t") > 0, F.transform("m", lambda x: x / F.col("t"))).otherwise(F.col("probs")).alias("probs"), F.col("probs").alias("old")))
        change = new.agg(F.sqrt(F.avg(V.sqr_distance(F.col("probs"), F.col("old"))))).first()[0] or 0.0
        now = new.select("id", "probs")
        if change < tolerance:
            break
    return now


def geodesic(distances: np.ndarray, k: int) -> np.ndarray:
    """Shortest paths over the k-nearest-neighbour graph of one distance matrix; infinite where unreachable."""
    n = len(distances)
    g = np.full((n, n), np.inf)
    for i in range(n):
        near = np.argsort(distances[i], kind="stable")[: k + 1]
        g[i, near] = distances[i, near]
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0)
    for j in range(n):
        g = np.minimum(g, g[:, [j]] + g[[j]])
    return g
