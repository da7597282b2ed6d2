"""Graph seeding, same-label smoothing and kernels for segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import graph, neighbours, stats
from .neighbours import KEY, meeting, shifted


def spread_seeds(vertices: DataFrame, edges: DataFrame, k: int) -> list[int]:
    """k vertices, each farthest by path length from those before it (an unreachable one is farthest); the first is the least id.

    One shortest-path run for each seed; k ids come to the driver.
    """
    first = vertices.agg(F.min("id")).first()[0]
    if first is None:
        return []
    seeds, near = [first], None
    while len(seeds) < k:
        d = graph.shortest_paths(vertices, edges, seeds[-1]).select("id", F.when(F.col("dist") < 0, float("inf")).otherwise(F.col("dist")).alias("d"))
        near = graph.settle(d if near is None else near.withColumnRenamed("d", "e").join(d, "id").select("id", F.least("d", "e").alias("d")))
        best = near.where(~F.col("id").isin(seeds)).orderBy(F.desc("d"), "id").first()
        if best is None:
            break
        seeds.append(best["id"])
    return seeds


def seed_memberships(vertices: DataFrame, edges: DataFrame, seeds: list[int]) -> DataFrame:
    """(id, probs): inverse path lengths to the seeds, scaled to sum 1; unreachable seeds count nothing."""
    rows = vertices.select("id")
    for j, s in enumerate(seeds):
        d = graph.shortest_paths(vertices, edges, s).select("id", F.when(F.col("dist") >= 0, 1 / (F.col("dist") + 1e-6)).otherwise(0.0).alias(f"p{j}"))
        rows = rows.join(d, "id")
    p = F.array(*[F.col(f"p{j}") for j in range(len(seeds))])
    return rows.select("id", F.when(V.total(p) > 0, F.transform(p, lambda x: x / V.total(p))).otherwise(F.transform(p, lambda x: F.lit(1.0 / len(seeds)))).alias("probs"))


OFFSETS8 = [(0, r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def gaussian_kernel(voxels: DataFrame, bands: str, sigma: float, offsets=None) -> DataFrame:
    """(src, dst, w): exp(-d2 / sigma^2) of the squared distance of bands (a number or an array) between neighbours in a slice.

    The diagonal is 1; voxels needs an id.
    """
    kind = voxels.schema[bands].dataType.simpleString()
    vector = F.col(bands) if kind.startswith("array") else F.array(bands)
    rows = voxels.select(*KEY, "id", vector.cast("array<double>").alias("x"))
    near = meeting(rows, shifted(rows, ["id", "x"], offsets or OFFSETS8))
    pairs = near.select(F.col("id").alias("src"), F.col("n_id").alias("dst"), F.exp(-V.sqr_distance(F.col("x"), F.col("n_x")) / (sigma * sigma)).alias("w"))
    return pairs.unionByName(rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))


def dense_kernel(points: DataFrame, bands: str, sigma: float, queries: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """(src, dst, w): exp(-d2 / sigma^2) from each query row (all rows if none are given) to every row, rounded to places; the diagonal is 1.

    Queries go out in blocks; the other side stays distributed.
    """
    return neighbours.gaussian_weights(points if queries is None else queries, points, "id", bands, sigma, places)


def class_means(data: DataFrame, probs: DataFrame, vector: str = "v") -> DataFrame:
    """(class, pos, mean): means weighted by the squared memberships p of (id, class, p)."""
    rows = data.select("id", F.posexplode(V.doubles(vector)).alias("pos", "x")).join(probs.select("id", "class", (F.col("p") * F.col("p")).alias("w")), "id")
    return rows.groupBy("class", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def class_distances(data: DataFrame, means: DataFrame, vector: str = "v") -> DataFrame:
    """(id, class, d): squared distance of every row to every class mean (class, mean array); the means are checked to be few."""
    return stats.all_distances(data, means, "id", vector, "class", "mean")


def membership_update(near: DataFrame, distances: DataFrame, probs: DataFrame, smooth: float, entropy: float) -> DataFrame:
    """(id, class, p): one step for all sites at once of the quadratic Markov measure field.

    near (src, dst); sites without a neighbour stay as they are.  Memberships are cut to 0..1 and scaled to sum 1.
    """
    around = near.join(probs.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.sum("p").alias("s"), F.count("*").alias("m"))
    rows = distances.join(around, ["id", "class"], "left").join(probs.withColumnRenamed("p", "old"), ["id", "class"])
    n, d = smooth * F.coalesce("s", F.lit(0.0)), F.col("d") - entropy + smooth * F.coalesce("m", F.lit(0))
    rows = rows.withColumns({"n": n, "den": d})
    sums = rows.groupBy("id").agg(F.sum(F.col("n") / F.col("den")).alias("sn"), F.sum(1 / F.col("den")).alias("sd"))
    raw = rows.join(sums, "id").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - F.col("sn")) / (F.col("den") * F.col("sd")) + F.col("n") / F.col("den"))))
    total = raw.groupBy("id").agg(F.sum("p").alias("t"))
    return raw.join(total, "id").select("id", "class", F.when(F.col("m").isNull(), F.col("old")).otherwise(F.col("p") / F.col("t")).alias("p"))


def kernel_factors(kernel: DataFrame, probs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, s, sk2), (id, class, sk1)): sums of p^2, of p_x^2 p_y^2 w, and at each x of p_y^2 w; the diagonal is src = dst."""
    p2 = probs.select("id", "class", (F.col("p") * F.col("p")).alias("p2"))
    at = kernel.join(p2.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.sum(F.col("p2") * F.col("w")).alias("sk1"))
    by = p2.join(at, ["id", "class"], "left").groupBy("class").agg(F.sum("p2").alias("s"), F.sum(F.col("p2") * F.coalesce("sk1", F.lit(0.0))).alias("sk2"))
    return by, at


def smooth_axes(axes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dir): each axis replaced by the mean of itself and its same-label neighbours (id, label, dir), signs turned to its own."""
    own = axes.select(F.col("id").alias("src"), F.col("label").alias("l"), V.doubles("dir").alias("d"))
    other = axes.select(F.col("id").alias("dst"), F.col("label").alias("ml"), V.doubles("dir").alias("m"))
    pairs = edges.where("src != dst").join(own, "src").join(other, "dst").where("l = ml")
    turned = F.transform("m", lambda x: x * F.when(V.dot(F.col("d"), F.col("m")) < 0, -1.0).otherwise(1.0) * F.col("w"))
    sums = pairs.select("src", F.posexplode(turned).alias("i", "x")).groupBy("src", "i").agg(F.sum("x").alias("x")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    rows = own.join(sums, "src", "left")
    mixed = F.when(F.col("s").isNull(), F.col("d")).otherwise(F.zip_with("d", "s", lambda a, b: a + b["x"]))
    return rows.select(F.col("src").alias("id"), V.normalize(mixed).alias("dir"))


def kernel_energy(kernel: DataFrame, probs: DataFrame) -> DataFrame:
    """Sum of w * |p_src - p_dst|^2 over the kernel's edges."""
    a, b = probs.select(F.col("id").alias("src"), F.col("probs").alias("p")), probs.select(F.col("id").alias("dst"), F.col("probs").alias("q"))
    return kernel.join(a, "src").join(b, "dst").agg(F.sum(F.col("w") * V.sqr_distance(F.col("p"), F.col("q"))).alias("energy"))
