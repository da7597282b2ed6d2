"""Aggregates, histograms, centroids and verification curves as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import graph


def scalar_stats(df: DataFrame, value: str, mask: Column | None = None) -> DataFrame:
    """n, min, max, mean and population sd of a column, of the rows where mask holds."""
    x = F.col(value) if mask is None else F.when(mask, F.col(value))
    return df.agg(F.count(x).alias("n"), F.min(x).alias("min_v"), F.max(x).alias("max_v"), F.avg(x).alias("mean_v"), F.stddev_pop(x).alias("sd_v"))


def arg_extremes(df: DataFrame, value: str, index: str) -> DataFrame:
    """Index of the first smallest and first largest value."""
    order = F.struct(F.col(value), -F.col(index))
    return df.agg(F.min_by(index, F.struct(value, index)).alias("arg_min"), F.max_by(index, order).alias("arg_max"))


def upper_median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The upper middle element of each group in order (no averaging), by rank rather than by a collected list.

    Equal values are counted together and dealt over ranges; only the range that holds a group's middle is put in order,
    so no task holds a group.
    """
    by = by or []
    every = [F.lit(0).alias("__all"), *[F.col(c) for c in by]]
    rows = df.where(F.col(value).isNotNull()).select(*every, F.col(value).alias("__x")).groupBy("__all", *by, "__x").agg(F.count("*").alias("__m"))
    rows = graph.settle(rows.repartitionByRange("__all", *by, "__x").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy("__all", *by)
    sums = rows.groupBy("__all", *by, "__part").agg(F.sum("__m").alias("__s"))
    sums = sums.withColumns({"__upto": F.sum("__s").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__s").over(group)})
    middle = F.floor(F.col("__n") / 2)
    here = sums.where((F.col("__upto") > middle) & (F.col("__upto") - F.col("__s") <= middle)).select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__part").alias("__p"), (middle - (F.col("__upto") - F.col("__s"))).alias("__rank"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
    near = rows.join(here, [F.col("__part") == F.col("__p"), *same])
    upto = F.sum("__m").over(group.orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__upto", upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__m") <= F.col("__rank")))
    return near.select(*by, F.col("__x").alias("median"))


def column_bounds(df: DataFrame, vector: str) -> DataFrame:
    """Smallest and largest element at each place of a vector column."""
    return df.select(F.posexplode(V.doubles(vector)).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("min_v"), F.max("x").alias("max_v"))


def histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, centre, freq) of equal width over finite values; empty buckets have freq 0.

    The range is one scalar row, checked to be one, and joined by broadcast.
    """
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bounds = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(buckets * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).cast("int")
    place = F.when(F.col("hi") - F.col("lo") >= 1e-9, place).otherwise(0)
    counts = rows.join(F.broadcast(bounds)).groupBy(place.alias("bucket")).agg(F.count("*").alias("freq"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(bounds))
    centre = F.col("lo") + (F.col("bucket") + 0.5) * (F.col("hi") - F.col("lo")) / buckets
    return every.join(counts, "bucket", "left").select("bucket", centre.alias("centre"), F.coalesce("freq", F.lit(0)).alias("freq"))


def histogram_last_peak(hist: DataFrame, window: int, by: list[str] | None = None) -> DataFrame:
    """Centre of the last bucket that is not below any of its `window` neighbours on either side and not empty; one histogram for each group of `by`."""
    by = by or []
    near = Window.partitionBy(*by).orderBy("bucket").rowsBetween(-window, window)
    rows = hist.withColumn("top", F.max("freq").over(near)).where("freq = top and freq > 0")
    return rows.groupBy(*by).agg(F.max_by("centre", "bucket").alias("peak"), F.max("bucket").alias("bucket"))


def histogram_local_min(hist: DataFrame, buckets: int) -> DataFrame:
    """Beyond the reference: the first bucket after the first peak that is a least one within buckets / 20 to either side."""
    half = max(1, buckets // 20)
    near = Window.orderBy("bucket").rowsBetween(-half, half)
    rows = hist.withColumns({"top": F.max("freq").over(near), "low": F.min("freq").over(near)})
    first = rows.where("freq = top and freq > 0").agg(F.min("bucket").alias("first_peak"))
    return rows.join(F.broadcast(first)).where("bucket > first_peak and freq = low").agg(F.min_by("centre", "bucket").alias("valley"), F.min("bucket").alias("bucket"))


def histogram_first_min(hist: DataFrame, buckets: int) -> DataFrame:
    """(valley, bucket): the first least bucket among the buckets / 20 from the first highest of the first buckets / 20 on.

    The first bucket where all of those are empty or there are fewer than 20.
    """
    step = buckets // 20
    peak = hist.where((F.col("bucket") < step) & (F.col("freq") > 0)).agg(F.coalesce(F.min_by("bucket", F.struct(-F.col("freq"), "bucket")), F.lit(0)).alias("peak"))
    rows = hist.join(F.broadcast(peak)).where((F.col("bucket") >= F.col("peak")) & (F.col("bucket") < F.col("peak") + max(step, 1)))
    order = F.struct("freq", "bucket")
    return rows.agg(F.min_by("centre", order).alias("valley"), F.min_by("bucket", order).alias("bucket"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, pos, mean, n): the mean vector of each label, one row for each place."""
    rows = df.select(label, F.posexplode(V.doubles(vector)).alias("pos", "x"))
    return rows.groupBy(label, "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def centroid_vectors(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid, n), the centroid as an array; one row for each label."""
    c = centroids(df, vector, label).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c"), F.max("n").alias("n"))
    return c.select(label, F.transform("c", lambda s: s["mean"]).alias("centroid"), "n")


CENTROID_BYTES = 32 << 20


def nearest_centroid(df: DataFrame, centres: DataFrame, vector: str, label: str, keep: list[str], prior: str | None = None, by: str | None = None) -> DataFrame:
    """keep and (predicted, dist): the centroid of least squared distance (less its prior), ties to the smaller label.

    With `by`, a column of both sides, a row meets the centroids of its own group only.  Centroids are dealt over blocks
    of about CENTROID_BYTES by a hash; each row is compared with block after block in place, without a shuffle, and
    carries its best so far, so any number of them works.
    """
    size = centres.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    blocks = max(1, -(-size["n"] * (size["d"] or 0) * 8 // CENTROID_BYTES))
    bias = F.col(prior) if prior else F.lit(0.0)
    group = [F.col(by).alias("__by")] if by else []
    entry = F.struct(F.col(label).alias("label"), "centroid", bias.alias("prior"))
    rows = df.select(*keep, V.doubles(vector).alias("__v"), *group).withColumn("__best", F.lit(None))
    for k in range(blocks):
        part = centres.where(F.pmod(F.xxhash64(label, *([by] if by else [])), F.lit(blocks)) == k).select(entry.alias("e"), *group)
        table = part.groupBy(*(["__by"] if by else [])).agg(F.array_sort(F.collect_list("e")).alias("__cs"))
        rows = rows.join(F.broadcast(table), "__by", "left") if by else rows.join(F.broadcast(table))
        found = F.array_min(F.transform("__cs", lambda c: F.struct((V.sqr_distance(F.col("__v"), c["centroid"]) - c["prior"]).alias("dist"), c["label"].alias("label"))))
        rows = rows.withColumn("__best", F.least("__best", found) if k else found).drop("__cs")
    return rows.select(*keep, F.col("__best.label").alias("predicted"), F.col("__best.dist").alias("dist"))


def products(df: DataFrame, vector: str, origin: np.ndarray | float = 0.0) -> DataFrame:
    """(i, j, n, p, si, sj): rows, and sums of x_i x_j, x_i and x_j from an origin, for every two places; one d x d part a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()) - origin
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            i, j = np.divmod(np.arange(p.size), len(p))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "p": p.reshape(-1), "si": s[i], "sj": s[j]})

    rows = df.select(V.doubles(vector).alias("v")).where("v is not null")
    parts = rows.mapInPandas(run, "i int, j int, n bigint, p double, si double, sj double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "p", "si", "sj")])


def raw_second_moment(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, s): sum of products over n - 1, not centred, for every two places; null of a single row."""
    return products(df, vector).select("i", "j", F.when(F.col("n") > 1, F.col("p") / (F.col("n") - 1)).alias("s"))


def centred_covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, s): the sample covariance of every two places, in one pass; null of a single row.

    Sums run from one of the rows, so a mean that is far from 0 costs no digits.
    """
    first = df.select(V.doubles(vector).alias("v")).where("v is not null").first()
    sums = products(df, vector, np.array(first["v"]) if first else 0.0)
    return sums.select("i", "j", F.when(F.col("n") > 1, (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("s"))


def column_summaries(df: DataFrame, vector: str, target: str) -> DataFrame:
    """(pos, mean, norm, correlation): of each column its mean, the norm of what is left without it, and its product with the target."""
    rows = df.select(F.posexplode(V.doubles(vector)).alias("pos", "x"), F.col(target).cast("double").alias("y"))
    norm = F.sqrt(F.var_pop("x") * F.count("x"))
    return rows.groupBy("pos").agg(F.avg("x").alias("mean"), norm.alias("norm"), F.sum(F.col("x") * F.col("y")).alias("correlation"))


def standardize(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centred, scaled): each column less its mean, and over the norm of that; a constant column stays 0."""
    s = column_summaries(df.withColumn("__y", F.lit(0.0)), vector, "__y")
    table = s.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "norm"))).alias("s"))
    centred = F.zip_with(V.doubles(vector), "s", lambda x, c: x - c["mean"])
    scaled = F.zip_with(V.doubles(vector), "s", lambda x, c: F.when(c["norm"] > 0, (x - c["mean"]) / c["norm"]).otherwise(0.0))
    return df.join(F.broadcast(table)).select(key, centred.alias("centred"), scaled.alias("scaled"))


def entropy(df: DataFrame, category: str) -> DataFrame:
    """Natural-log entropy of a category's shares."""
    counts = df.groupBy(category).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"))


def categories(df: DataFrame, label: str) -> DataFrame:
    """One row: how many different labels there are."""
    return df.agg(F.count_distinct(label).alias("n"))


def unique(df: DataFrame, label: str) -> DataFrame:
    """The different labels, each once; sort the result where an order is wanted."""
    return df.select(label).distinct()


def all_distances(df: DataFrame, centres: DataFrame, key: str, vector: str, label: str, mean: str) -> DataFrame:
    """(key, label, d): squared distance of every row to each of a few centres, whose size is checked."""
    n, d = centres.agg(F.count("*"), F.max(F.size(mean))).first()
    if n * (d or 0) * 8 > CENTROID_BYTES:
        raise ValueError(f"{n} centres of {d} numbers are too many to send to every task")
    table = centres.agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col(mean).alias("m"))).alias("cs"))
    rows = df.join(F.broadcast(table)).select(key, V.doubles(vector).alias("v"), F.explode("cs").alias("e"))
    return rows.select(key, F.col("e.c").alias(label), V.sqr_distance(F.col("v"), F.col("e.m")).alias("d"))


def nth_smallest(df: DataFrame, value: str, n: int) -> float | None:
    """The value of rank n (from 0); None past the end.  Only one of the ranges that the rows are dealt over is sorted."""
    rows = graph.settle(df.select(F.col(value).alias("x")).where("x is not null").repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    before = 0
    for r in sorted(rows.groupBy("part").agg(F.count("*").alias("m")).collect(), key=lambda r: r["part"]):
        if n < before + r["m"]:
            ranked = rows.where(F.col("part") == r["part"]).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1)
            return ranked.where(F.col("r") == n - before).first()["x"]
        before += r["m"]
    return None


def rate_at_rank(scores: DataFrame, rank: int, score: str = "dist", match: str = "same") -> DataFrame:
    """(threshold, rate): the non-match of a rank in order, and the share of matches strictly below it; null without either."""
    threshold = nth_smallest(scores.where(F.col(match) == 0), score, rank)
    t = F.lit(threshold).cast("double")
    hits = F.count_if((F.col(match) == 1) & (F.col(score) < t))
    return scores.agg(F.first(t).alias("threshold"), (hits / F.nullif(F.count_if(F.col(match) == 1), F.lit(0))).alias("rate"))


def verification_all_pairs(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(threshold, rate) over every pair of rows: equal labels match, the threshold is the non-match of rank n / 1000."""
    from . import pairs

    return pairs.rate_of_pairs(df, None, key, vector, label, pairs.equal_labels, lambda n: n // 1000)


# The codes of a pair mask.
IGNORED, NON_MATCH, MATCH = 0x00, 0x7F, 0xFF


def verification_masked(distances: DataFrame, mask: DataFrame, far: float) -> DataFrame:
    """(threshold, rate) of distances (i, j, d) by a pair mask (i, j, code); the threshold is the non-match of rank int(far * n)."""
    rows = distances.join(mask.where(F.col("code").isin(NON_MATCH, MATCH)), ["i", "j"]).select(F.col("d").alias("dist"), (F.col("code") == MATCH).cast("int").alias("same"))
    rows = graph.settle(rows)
    return rate_at_rank(rows, int(far * rows.where("same = 0").count()))


def verification_ruled(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, ignored: Callable[[np.ndarray, np.ndarray], np.ndarray], far: float) -> DataFrame:
    """verification_masked() of each query and the rows after it, for a mask that a rule gives: pairs that ignored(i, j) leaves match by equal labels."""
    from . import pairs

    return pairs.rate_of_pairs(queries, base, key, vector, label, pairs.masked(ignored), lambda n: int(far * n))


def mask_counts(mask: DataFrame) -> DataFrame:
    """Pairs, and how many are ignored, match, don't match, or count at all."""
    c = F.col("code")
    return mask.agg(F.count("*").alias("pairs"), F.count_if(c == IGNORED).alias("zeroes"), F.count_if(c == MATCH).alias("positives"), F.count_if(c == NON_MATCH).alias("negatives"), F.count_if(c != IGNORED).alias("counted"))


def by_label_order(df: DataFrame, key: str, label: str, order: DataFrame) -> DataFrame:
    """(key, place): rows of one label together, labels in the order of (label, rank), rows within a label by key.

    Places come from the labels' sizes, so no task sorts more than one label.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("m")).join(order, label)
    base = sizes.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1 + F.col("base")
    return df.join(base.select(label, "base"), label).select(key, place.cast("bigint").alias("place"))


def permute_by_label(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """by_label_order() with the labels in a random order of the seed."""
    draw = df.select(label).distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64(F.col(label), F.lit(seed)), label)))
    return by_label_order(df, key, label, draw)


def apply_permutation(df: DataFrame, key: str, permutation: DataFrame) -> DataFrame:
    """Rows of df under new keys: row `place` of the result is row `key` of df, for a permutation (key, place)."""
    return df.join(permutation, key).drop(key).withColumnRenamed("place", key)


def running_total(df: DataFrame, order: str, value: str, out: str = "running") -> DataFrame:
    """df and the sum of value up to and with each row in order, over ranges with offsets."""
    ranged = graph.settle(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))
    sums = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__base"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(F.broadcast(sums), "__part").withColumn(out, F.col("__base") + own).drop("__part", "__base")


def draw(df: DataFrame, key: str, weight: str, shares: DataFrame) -> DataFrame:
    """(share, key): for each share of 0..1 the first row, by key, up to which the weights sum to more than that share of all.

    The last row where none does.  Shares are few; their number is checked.
    """
    total = df.agg(F.sum(weight).alias("__t"))
    cum = running_total(df, key, weight).select(key, "running")
    asked = shares.select("share").join(F.broadcast(total)).select("share", (F.col("share") * F.col("__t")).alias("__r"))
    last = df.agg(F.max(key).alias("__last"))
    n = asked.count()
    if n * 16 > CENTROID_BYTES:
        raise ValueError(f"{n} draws are too many for one pass")
    hit = cum.join(F.broadcast(asked), F.col("running") > F.col("__r")).groupBy("share").agg(F.min(key).alias(key))
    return shares.join(hit, "share", "left").join(F.broadcast(last)).select("share", F.coalesce(key, "__last").alias(key))


def first_of_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """The gallery: for each label its first row by key."""
    w = Window.partitionBy(label).orderBy(key)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def verification_scores(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(probe, gallery, dist, same) of every probe against the first sample of each label.

    The gallery has one row for each label and is sent to every task in one array of a checked size.
    """
    gallery = first_of_label(df, key, label).select(F.col(key).alias("gallery"), V.doubles(vector).alias("centroid"), F.col(label).alias("glabel"))
    n, d = gallery.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (d or 0) * 8 > CENTROID_BYTES:
        raise ValueError(f"a gallery of {n} vectors is too large to send to every task")
    table = gallery.agg(F.collect_list(F.struct("gallery", "centroid", "glabel")).alias("g"))
    probes = df.join(gallery.select(F.col("gallery").alias(key)), key, "left_anti")
    rows = probes.join(F.broadcast(table)).select(F.col(key).alias("probe"), F.col(label).alias("plabel"), V.doubles(vector).alias("v"), F.explode("g").alias("g"))
    return rows.select("probe", F.col("g.gallery").alias("gallery"), V.sqr_distance(F.col("v"), F.col("g.centroid")).alias("dist"), (F.col("plabel") == F.col("g.glabel")).cast("int").alias("same"))


def roc_curve(scores: DataFrame, score: str = "dist", match: str = "same") -> DataFrame:
    """(score, far, vr): accepted shares of all scores and of matches at each distinct score.

    A global running sum: scores are aggregated per value first, then buckets of a range partition are
    summed and offset, so no single task sorts all rows.
    """
    per = scores.groupBy(F.col(score).alias("score")).agg(F.sum(1 - F.col(match)).alias("f"), F.sum(match).alias("t"))
    ranged = graph.settle(per.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("f").alias("pf"), F.sum("t").alias("pt"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("part", F.coalesce(F.sum("pf").over(before), F.lit(0)).alias("bf"), F.coalesce(F.sum("pt").over(before), F.lit(0)).alias("bt"), F.sum("pf").over(every).alias("nf"), F.sum("pt").over(every).alias("nt"))
    run = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(F.broadcast(sums), "part")
    far = (F.col("bf") + F.sum("f").over(run)) / (F.col("nf") + F.col("nt"))
    vr = (F.col("bt") + F.sum("t").over(run)) / F.col("nt")
    return rows.select("score", far.alias("far"), vr.alias("vr"))


def verification_rate(scores: DataFrame, far: float = 0.001, score: str = "dist", match: str = "same") -> DataFrame:
    """(threshold, rate): the verification rate at the first score whose false acceptance reaches far; 1 if none does."""
    hit = roc_curve(scores, score, match).where(F.col("far") >= far).agg(F.min("score").alias("threshold"), F.min_by("vr", "score").alias("rate"))
    return hit.select("threshold", F.coalesce("rate", F.lit(1.0)).alias("rate"))


def greatest_at_most(df: DataFrame, value: str, limit) -> DataFrame:
    """Largest index (from 0, in the order of value) whose value is at most limit; -1 if none."""
    return df.agg((F.count_if(F.col(value) <= limit) - 1).alias("idx"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def minmax_scale(df: DataFrame, value: str, low: float, high: float, out: str) -> DataFrame:
    """Rescale a column to [low, high]; a constant column gives low."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = F.col(value).cast("double")
    y = F.when(F.col("__hi") > F.col("__lo"), low + (high - low) * (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(low))
    return df.join(F.broadcast(bounds)).withColumn(out, y).drop("__lo", "__hi")


def consecutive_ids(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, new_id): values numbered 0..k-1 in the order in which they are first seen.

    Only the distinct values are numbered, over a range partition with offsets, not in one task.
    """
    first = df.groupBy(value).agg(F.min(order).alias("seen"))
    ranged = graph.settle(first.repartitionByRange("seen").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("m"))
    sizes = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("seen", value)) - 1 + F.col("base")
    return ranged.join(F.broadcast(sizes), "part").select(value, number.cast("bigint").alias("new_id"))


def drop_small_groups(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels with at least `least` rows."""
    big = df.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label)
    return df.join(big, label, "left_semi")


def top_coefficients(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, rank, idx, value): the k largest positive elements of each vector, ties to the smaller index; no shuffle."""
    pairs = F.filter(F.transform(V.doubles(vector), lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"))), lambda s: s["neg"] < 0)
    top = F.slice(F.array_sort(pairs), 1, k)
    return df.select(key, F.posexplode(top).alias("rank", "e")).select(key, "rank", F.col("e.idx").alias("idx"), (-F.col("e.neg")).alias("value"))


def sample_replacement(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n rows drawn with replacement."""
    total = df.count()
    return df.sample(withReplacement=True, fraction=n / total, seed=seed) if total else df


def sample_no_replacement(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all) drawn without replacement, by the n least of a seeded random number."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def random_permutation(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").drop("__r")


def category_sample(df: DataFrame, label: str, proportion: float, seed: int = 0) -> DataFrame:
    """df and `chosen`: whether the row's label is among a random share of the labels."""
    draw = F.xxhash64(F.col(label), F.lit(seed))
    rank = F.percent_rank().over(Window.orderBy(draw))
    labels = df.select(label).distinct().withColumn("chosen", rank < proportion)
    return df.join(labels, label)


def nth_allowed(n: int, forbidden: set[int]) -> int:
    """The n-th (from 0) integer that is not forbidden."""
    at = n
    for x in sorted(forbidden):
        if x <= at:
            at += 1
    return at
