"""Verification and classification reports built from the aggregate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import clustering, graph, stats


def class_scores(df: DataFrame, vector: str, label: str, key: str, centres: DataFrame) -> DataFrame:
    """(class, key, dist, same): squared distance of every row to every class's centroid.

    The centroids go to the tasks in one row of a size that is checked.
    """
    n, d = centres.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (d or 0) * 8 > stats.CENTROID_BYTES:
        raise ValueError(f"{n} centroids are too many to send to every task")
    table = centres.agg(F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("cs"))
    rows = df.join(F.broadcast(table)).select(F.col(key), F.col(label).alias("own"), V.doubles(vector).alias("v"), F.explode("cs").alias("c"))
    return rows.select(F.col("c.label").alias("class"), key, V.sqr_distance(F.col("v"), F.col("c.centroid")).alias("dist"), (F.col("own") == F.col("c.label")).cast("int").alias("same"))


def class_thresholds(scores: DataFrame, shares: tuple[float, ...] = (0.001, 0.01, 0.1)) -> DataFrame:
    """(class, share, threshold, rate): the distance below which a share of a class's non-matches falls, and the share of matches below it.

    The threshold is the non-match of rank int(share * n) in order, found by rank over (class, distance) groups.
    """
    per = scores.groupBy("class", "dist").agg(F.sum(1 - F.col("same")).alias("f"), F.sum("same").alias("t"))
    run, every = Window.partitionBy("class").orderBy("dist"), Window.partitionBy("class")
    rows = per.select("class", "dist", F.sum("f").over(run).alias("cf"), (F.sum("t").over(run) - F.col("t")).alias("below"), F.sum("f").over(every).alias("nf"), F.sum("t").over(every).alias("nt"))
    cut = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    hit = cut.where(F.col("cf") > F.floor(F.col("share") * F.col("nf"))).groupBy("class", "share").agg(F.min("dist").alias("threshold"), F.min_by("below", "dist").alias("below"), F.first("nt").alias("nt"))
    return hit.select("class", "share", "threshold", (F.col("below") / F.nullif("nt", F.lit(0))).alias("rate"))


def side_by_side(curves: DataFrame, curve: str, ids: list, points: int = 100) -> DataFrame:
    """(far, one column of rates for each curve): verification rate at a grid of false acceptance rates."""
    grid = F.floor(F.col("far") * points) / points
    return curves.where(F.col(curve).isin(ids)).groupBy(grid.alias("far")).pivot(curve, ids).agg(F.max("vr"))


def row_percent(confusion: DataFrame, truth: str, predicted: str, n: str = "n") -> DataFrame:
    """The confusion counts with each row's share in percent."""
    return confusion.withColumn("percent", 100 * F.col(n) / F.sum(n).over(Window.partitionBy(truth))).select(truth, predicted, n, "percent")


def capped_confusion(counts: DataFrame, a: str, b: str, most: int = 4) -> DataFrame:
    """(a, b, n) of two counts, each capped at `most`."""
    cap = lambda c: F.least(F.col(c), F.lit(most)).alias(c)
    return counts.select(cap(a), cap(b)).groupBy(a, b).agg(F.count("*").alias("n"))


def label_generalization(df: DataFrame, key: str, vector: str, label: str, directions: int, proportion: float = 0.5, far: float = 0.001, seed: int = 0) -> DataFrame:
    """(k, inside, outside): verification error with the first k discriminants, on the labels they were fitted on and on the others.

    The labels are split by a hash; one plan for each k, of the two verification rates.
    """
    split = stats.category_sample(df, label, proportion, seed)
    train, test = split.where("chosen"), split.where("not chosen")
    w = clustering.discriminants(train, vector, label, directions)
    out = None
    for k in range(1, len(w) + 1):
        rates = []
        for side in (train, test):
            p = clustering.projected(side, vector, w[:k])
            rates.append(stats.verification_rate(stats.verification_scores(p, key, "projected", label), far).select((1 - F.col("rate")).alias("error")))
        one = rates[0].withColumnRenamed("error", "inside").join(F.broadcast(rates[1].withColumnRenamed("error", "outside"))).select(F.lit(k).alias("k"), "inside", "outside")
        out = one if out is None else out.unionByName(one)
    return out


def best_directions(generalization: DataFrame) -> DataFrame:
    """The k of least outside error, ties by the inside error and then the smaller k."""
    return generalization.orderBy("outside", "inside", "k").limit(1)


def monotone_breaks(voxels: DataFrame, count: str, other: str) -> DataFrame:
    """How many voxels have more of `other` than the least among voxels with a larger `count`."""
    least = voxels.groupBy(F.col(count).alias("c")).agg(F.min(other).alias("m"))
    after = least.withColumn("m", F.min("m").over(Window.orderBy("c").rowsBetween(1, Window.unboundedFollowing)))
    return voxels.join(F.broadcast(after), F.col(count) == F.col("c")).agg(F.count_if(F.col(other) > F.col("m")).alias("breaks"))


def capacity_split(alpha: np.ndarray, affinity: np.ndarray, k: int) -> np.ndarray:
    """Labels of k groups of about equal weight: seeds far apart, then the most related direction joins the lightest group."""
    live = [int(i) for i in np.flatnonzero(alpha > 0)]
    label = np.full(len(alpha), -1)
    if not live:
        return label
    seeds = [max(live, key=lambda i: alpha[i])]
    while len(seeds) < min(k, len(live)):
        seeds.append(min((i for i in live if i not in seeds), key=lambda i: (max(affinity[i, s] for s in seeds), i)))
    weight = {}
    for g, s in enumerate(seeds):
        label[s], weight[g] = g, alpha[s]
    left = [i for i in live if label[i] < 0]
    while left:
        g = min(weight, key=lambda x: (weight[x], x))
        i = max(left, key=lambda j: (affinity[j][label == g].max(), -j))
        label[i] = g
        weight[g] += alpha[i]
        left.remove(i)
    return label


def contained(tensors: list[np.ndarray], b: float, directions: np.ndarray) -> int:
    """How many tensors hold no smaller one: their signal profile lies above that of none of the others in every direction."""
    profiles = [np.exp(-b * np.einsum("ni,ij,nj->n", directions, t, directions)) for t in tensors]
    return sum(not any(i != j and (p >= q).all() and (p > q).any() for j, q in enumerate(profiles)) for i, p in enumerate(profiles))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(id, v, label) of a text matrix whose last column is the label."""
    from ..sources import files

    x = F.col("x")
    return files.read_matrix(spark, path).select(F.col("i").alias("id"), F.slice(x, 1, F.size(x) - 1).alias("v"), F.element_at(x, -1).cast("bigint").alias("label"))


def save_libsvm(df: DataFrame, key: str, vector: str, label: str, path: str) -> None:
    """Lines `label place:value ...`, places from 1, in the order of a key."""
    pairs = F.transform(V.doubles(vector), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))
    line = F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " "))
    df.repartitionByRange(key).sortWithinPartitions(key).select(line.alias("line")).write.text(path)


def discriminants_from_file(spark: SparkSession, path: str, directions: int, out: str | None = None) -> DataFrame:
    """(id, label, predicted) of the rows of a file by nearest centroid among discriminants fitted on them; projections go to `out` as libsvm lines."""
    rows = graph.settle(read_labelled(spark, path))
    w = clustering.discriminants(rows, "v", "label", directions)
    p = clustering.projected(rows, "v", w)
    if out:
        save_libsvm(p, "id", "projected", "label", out)
    return stats.nearest_centroid(p, stats.centroid_vectors(p, "projected", "label"), "projected", "label", ["id", "label"]).select("id", "label", "predicted")


def validation_from_file(spark: SparkSession, path: str, directions: int, proportion: float = 0.5) -> DataFrame:
    """label_generalization() of the rows of a file."""
    return label_generalization(graph.settle(read_labelled(spark, path)), "id", "v", "label", directions, proportion)
