"""Cross-validation of nearest-centroid and discriminant classification over all folds at once.

Sums of vectors and of their products add up, so the means and scatter that leave a fold out are those of all rows
less those of the fold: one scan gives them for every fold, another classifies every row by what has not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import clustering, graph, stats


def left_out_centroids(df: DataFrame, vector: str, label: str, fold: Column, folds: int) -> DataFrame:
    """(fold, label, centroid, n): for every fold and label the mean vector of the label's rows outside the fold, if there are any.

    Rows without a label, and null or missing elements, count nowhere.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), fold.cast("int").alias("fold"), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    sums = rows.where("x is not null").groupBy("label", "pos", "fold").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("of"))
    each = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    less = each.select("fold", "label", "pos", (F.col("s") - F.coalesce(F.col("of")[F.col("fold")]["s"], F.lit(0.0))).alias("s"), (F.col("n") - F.coalesce(F.col("of")[F.col("fold")]["n"], F.lit(0))).alias("n"))
    means = less.where("n > 0").groupBy("fold", "label").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("mean")))).alias("c"), F.max("n").alias("n"))
    return means.select("fold", F.col("label").alias(label), F.transform("c", lambda e: e["mean"]).alias("centroid"), "n")


def held_out(df: DataFrame, key: str, vector: str, label: str, fold: Column, folds: int) -> DataFrame:
    """(key, label, fold, predicted, dist) of every labelled row, by the centroids that leave its fold out."""
    rows = df.where(F.col(label).isNotNull()).withColumn("fold", fold.cast("int"))
    return stats.nearest_centroid(rows, left_out_centroids(df, vector, label, fold, folds), vector, label, [key, label, "fold"], by="fold")


def confusion_over_folds(found: DataFrame, label: str, folds: int) -> DataFrame:
    """(label, predicted, n, mean_n, sd_n): counts of all folds, and mean and sample sd of the folds' counts; folds without a count have 0."""
    counts = found.groupBy(label, "predicted", "fold").agg(F.count("*").alias("n"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.sum(F.col("n") * F.col("n")) - F.sum("n") * F.sum("n") / folds) / (folds - 1))) if folds > 1 else F.lit(None).cast("double")
    return counts.groupBy(label, "predicted").agg(F.sum("n").alias("n"), (F.sum("n") / folds).alias("mean_n"), sd.alias("sd_n"))


def error_over_folds(found: DataFrame, label: str) -> DataFrame:
    """(mean, sd, worst, best): of the folds' shares of wrong rows; sd is the sample sd."""
    wrong = found.groupBy("fold").agg(F.avg((~F.col("predicted").eqNullSafe(F.col(label))).cast("double")).alias("e"))
    return wrong.agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.max("e").alias("worst"), F.min("e").alias("best"))


def fold_scatter(df: DataFrame, vector: str, label: str, fold: Column) -> tuple[dict, dict]:
    """({fold: sum of vv'}, {(fold, label): (n, sum of v)}) of labelled rows, added up in the tasks; labels are whole numbers."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    first = rows.select(F.size(vector)).first()
    d = first[0] if first else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, per = {}, {}
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, d))
            for (f, c), at in pdf.groupby(["f", "y"]).indices.items():
                total[f] = total.get(f, 0.0) + v[at].T @ v[at]
                n, s = per.get((f, c), (0, 0.0))
                per[f, c] = n + len(at), s + v[at].sum(0)
        out = [(f, None, 0, t.reshape(-1)) for f, t in total.items()] + [(f, c, n, s) for (f, c), (n, s) in per.items()]
        yield pd.DataFrame(out, columns=["f", "y", "n", "s"]).astype({"y": "Int64"})

    parts = rows.select(V.doubles(vector).alias("v"), F.col(label).cast("bigint").alias("y"), fold.cast("int").alias("f")).mapInPandas(run, "f int, y bigint, n bigint, s array<double>")
    sums = parts.select("f", "y", "n", F.posexplode("s").alias("i", "s")).groupBy("f", "y", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    lists = sums.groupBy("f", "y").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"), F.max("n").alias("n")).select("f", "y", "n", F.col("s.s").alias("s")).collect()  # a matrix for each fold, a mean for each label and fold
    total = {r["f"]: np.array(r["s"]).reshape(d, d) for r in lists if r["y"] is None}
    return total, {(r["f"], r["y"]): (r["n"], np.array(r["s"])) for r in lists if r["y"] is not None}


def discriminant_counts(df: DataFrame, vector: str, label: str, directions: int, fold: Column, folds: int, least: float = 1e-6) -> DataFrame:
    """(fold, held, label, predicted, n): rows of each label that a fold's discriminants and centroids give each class; held: rows of the fold itself, which they have not seen.

    A fold that leaves fewer than two labels to fit, or no direction, gives the smallest label of those left.
    """
    total, per = fold_scatter(df, vector, label, fold)
    labels, models = sorted({c for _, c in per}), {}
    every = sum(total.values()) if total else None
    for f in range(folds):
        left = {}
        for c in labels:
            n, s = (sum(x) for x in zip(*[per[k] for k in per if k[1] == c and k[0] != f], strict=True)) if any(k[1] == c and k[0] != f for k in per) else (0, 0.0)
            if n:
                left[c] = n, s / n
        if left:
            w = clustering.discriminants_of(every - total.get(f, 0.0), left, directions, least) if len(left) > 1 else np.zeros((0, len(every)))
            names = np.array(sorted(left), dtype=np.int64)
            models[f] = w, names, np.stack([w @ left[c][1] for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            v, y, own = np.stack(pdf["v"].to_numpy()).astype(float), pdf["y"].to_numpy(), pdf["f"].to_numpy()
            for f, (w, names, centres) in models.items():
                p = v @ w.T
                predicted = names[((p[:, None] - centres[None]) ** 2).sum(-1).argmin(1)]
                for key, n in pd.DataFrame({"held": own == f, "y": y, "p": predicted}).value_counts().items():
                    counts[f, *key] = counts.get((f, *key), 0) + n
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["fold", "held", "label", "predicted", "n"])

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(V.doubles(vector).alias("v"), F.col(label).cast("bigint").alias("y"), fold.cast("int").alias("f"))
    found = rows.mapInPandas(run, "fold int, held boolean, label bigint, predicted bigint, n bigint")
    return graph.settle(found.groupBy("fold", "held", "label", "predicted").agg(F.sum("n").alias("n")))


def fold_errors(counts: DataFrame) -> DataFrame:
    """(fold, in_error, out_error): shares of wrong rows among those a fold's model has seen, and among those it has not."""
    wrong = F.when(F.col("predicted") != F.col("label"), F.col("n")).otherwise(0)
    share = lambda held: F.sum(F.when(F.col("held") == held, wrong)) / F.sum(F.when(F.col("held") == held, F.col("n")))
    return counts.groupBy("fold").agg(share(False).alias("in_error"), share(True).alias("out_error"))


def share_confusion(counts: DataFrame, folds: int) -> DataFrame:
    """(label, predicted, mean, sd): over folds, the share of a label's unseen rows that go to each class; a fold without rows of a label counts as all right."""
    held = counts.where("held")
    shares = held.select("fold", "label", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("fold", "label"))).alias("x"))
    labels = counts.select("label").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    right = labels.join(held.select("label", "fold").distinct(), ["label", "fold"], "left_anti").select("fold", "label", F.col("label").alias("predicted"), F.lit(1.0).alias("x"))
    both = shares.unionByName(right).groupBy("label", "predicted").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / folds) / (folds - 1))) if folds > 1 else F.lit(None).cast("double")
    return both.select("label", "predicted", (F.col("s") / folds).alias("mean"), sd.alias("sd"))
