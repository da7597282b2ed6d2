"""Multi-tensor fields: one row for each voxel, compartments as an array of structs.

compartments: ARRAY<STRUCT<fraction DOUBLE, dir ARRAY<DOUBLE>, lambda ARRAY<DOUBLE>, grp INT>>; dir is the
principal axis.  Two fields meet in an equi-join on their key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import assignment
from ..functions import vectors as V
from .neighbours import KEY, OFFSETS26, meeting, shifted

COMPARTMENT = "struct<fraction:double,dir:array<double>,lambda:array<double>,grp:int>"


def select_slices(field: DataFrame, axis: str, keep: list[int]) -> DataFrame:
    """Voxels whose index along an axis is kept, re-indexed densely from 0 (the kept list is the driver's own)."""
    order = {v: i for i, v in enumerate(sorted(set(keep)))}
    index = F.create_map(*[F.lit(x) for kv in order.items() for x in kv]) if order else F.lit(None)
    return field.where(F.col(axis).isin(list(order))).withColumn(axis, index[F.col(axis)].cast("int"))


def voxel(field: DataFrame, s: int, r: int, c: int) -> DataFrame:
    return field.where((F.col("slice") == s) & (F.col("row") == r) & (F.col("col") == c))


def split_slice(field: DataFrame, s: int) -> DataFrame:
    """One slice's compartments as a stack: slice becomes the compartment's index."""
    rows = field.where(F.col("slice") == s).select("row", "col", F.posexplode("compartments").alias("slice", "c"))
    return rows.select("slice", "row", "col", F.array("c").alias("compartments"))


def tensor_list(field: DataFrame) -> DataFrame:
    """One row for each compartment with its voxel."""
    return field.select(*KEY, F.posexplode("compartments").alias("k", "c")).select(*KEY, "k", "c.fraction", "c.dir", "c.lambda")


def angle_volume(field: DataFrame, s: int, tolerance: float = 0.1) -> DataFrame:
    """tensor_list of one slice with `angle_bin`: distinct angles to (1, 1, 0), in degrees, to a tolerance; bins count up from the least angle."""
    rows = tensor_list(field.where(F.col("slice") == s))
    angle = V.axial_angle_degrees(F.col("dir"), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    return rows.withColumn("angle", angle).withColumn("angle_bin", F.floor(F.col("angle") / tolerance))


def drop_small(field: DataFrame, share: float) -> DataFrame:
    """Compartments of at least share * the largest fraction; fractions scaled to sum 1."""
    top = F.array_max(F.transform("compartments", lambda c: c["fraction"]))
    kept = F.filter("compartments", lambda c: c["fraction"] >= share * top)
    total = F.aggregate(kept, F.lit(0.0), lambda a, c: a + c["fraction"])
    return field.withColumn("compartments", F.transform(kept, lambda c: c.withField("fraction", c["fraction"] / total)))


def counts(field: DataFrame, slices: list[int] | None = None) -> DataFrame:
    """(most, total) compartments, of some slices or all."""
    rows = field if slices is None else field.where(F.col("slice").isin(slices))
    n = F.size("compartments")
    return rows.agg(F.max(n).alias("most"), F.sum(n).alias("total"))


def count_errors(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """over_count and under_count (null where truth has none), missing and extra, from a count n on either side."""
    both = truth.select(*key, F.col("n").alias("a")).join(found.select(*key, F.col("n").alias("b")), key, "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    some = a > 0
    return both.select(*key, F.when(some, F.greatest(b - a, F.lit(0))).alias("over_count"), F.when(some, F.greatest(a - b, F.lit(0))).alias("under_count"), (some & (b == 0)).cast("int").alias("missing"), (~some & (b > 0)).cast("int").alias("extra"))


def directions(c: Column) -> Column:
    return F.transform(c, lambda x: x["dir"])


@F.pandas_udf(DoubleType())
def matched_angle(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean angle in degrees of the best matching of two sets of axes; 90 if only the second is empty, null if the first is."""
    out = []
    for x, y in zip(a, b, strict=True):
        n, m = 0 if x is None else len(x), 0 if y is None else len(y)
        out.append(None if not n else 90.0 if not m else assignment.match_axes(np.stack(x), np.stack(y))[1])
    return pd.Series(out, dtype="float64")


def angular_error(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(voxel, angle) of voxels that hold something in truth."""
    both = truth.select(*KEY, directions(F.col("compartments")).alias("a")).join(found.select(*KEY, directions(F.col("compartments")).alias("b")), KEY, "left")
    return both.where(F.size("a") > 0).select(*KEY, matched_angle("a", F.coalesce("b", F.array().cast("array<array<double>>"))).alias("angle"))


def odf_error(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(voxel, error): squared difference of ODF arrays relative to truth's; null where that is zero."""
    both = truth.select(*KEY, F.col("odf").alias("a")).join(found.select(*KEY, F.col("odf").alias("b")), KEY)
    return both.select(*KEY, (V.sqr_distance(F.col("a"), F.col("b")) / F.nullif(V.sqr_norm(F.col("a")), F.lit(0.0))).alias("error"))


def coherence(field: DataFrame, void: float) -> DataFrame:
    """(voxel, lci): mean angle of the matched compartments over all neighbours; NaN for an empty voxel, 0 without a match.

    The first three compartments of a voxel are matched with those of each neighbour, a missing one at the
    cost `void`; only matches of two that are there count, each as one term.
    """
    @F.pandas_udf("total double, terms int")
    def matched(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"total": np.zeros(0), "terms": np.zeros(0, dtype=np.int32)})
        p, q = (np.stack(x.to_numpy()).astype(float).reshape(-1, 3, 3) for x in (a, b))
        to, angles = assignment.match_threes(p, q, void)
        there = (np.arange(3) < n.to_numpy()[:, None]) & (to < m.to_numpy()[:, None])
        found = np.where(there, np.take_along_axis(angles, to[..., None], 2)[..., 0], 0.0)
        return pd.DataFrame({"total": found[:, 0] + found[:, 1] + found[:, 2], "terms": there.sum(1).astype(np.int32)})

    rows = field.select(*KEY, directions(F.col("compartments")).alias("d"))
    none = F.array(*[F.array(*[F.lit(0.0)] * 3)] * 3)
    full = rows.where(F.size("d") > 0).select(*KEY, F.flatten(F.slice(F.concat("d", none), 1, 3)).alias("d"), F.least(F.size("d"), F.lit(3)).alias("n"))
    each = meeting(full, shifted(full, ["d", "n"], OFFSETS26)).select(*KEY, matched("d", "n", "n_d", "n_n").alias("m"))
    near = each.groupBy(*KEY).agg((F.sum("m.total") / F.nullif(F.sum("m.terms"), F.lit(0))).alias("lci"))
    return rows.join(near, KEY, "left").select(*KEY, F.when(F.size("d") == 0, float("nan")).otherwise(F.coalesce("lci", F.lit(0.0))).alias("lci"))


def error_summary(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Mean and population sd of the per-voxel errors, one row."""
    n = lambda f: f.select(*KEY, F.size("compartments").alias("n"))
    e = count_errors(n(truth), n(found), KEY).join(angular_error(truth, found), KEY, "left")
    return e.agg(*[f(c).alias(f"{c}_{s}") for c in ("over_count", "under_count", "missing", "extra", "angle") for f, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


def error_by_crossing(truth: DataFrame, errors: DataFrame, value: str) -> DataFrame:
    """Mean error by the truth's smallest crossing angle, rounded to a degree; the voxel key is carried along."""
    return truth.select(*KEY, F.round(smallest_angle(F.col("compartments"))).alias("crossing")).join(errors, KEY).groupBy("crossing").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def pair_angles(c: Column) -> Column:
    return F.flatten(F.transform(c, lambda x, i: F.transform(F.filter(c, lambda y, j: j > i), lambda y: V.axial_angle_degrees(x["dir"], y["dir"]))))


def smallest_angle(c: Column) -> Column:
    """Smallest angle between compartments in degrees, 180 with fewer than two."""
    return F.coalesce(F.array_min(pair_angles(c)), F.lit(180.0))


def largest_intra_angle(c: Column) -> Column:
    """Largest angle within a group, -1 without groups."""
    same = F.flatten(F.transform(c, lambda x, i: F.transform(F.filter(c, lambda y, j: (j > i) & (y["grp"] == x["grp"])), lambda y: V.axial_angle_degrees(x["dir"], y["dir"]))))
    return F.coalesce(F.array_max(same), F.lit(-1.0))


def compare(truth: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Where two reconstructions have truth's count, how often each does, and the mean gain in angle of the first."""
    n = lambda f, name: f.select(*KEY, F.size("compartments").alias(name))
    rows = n(truth, "t").join(n(first, "a"), KEY).join(n(second, "b"), KEY)
    rows = rows.join(angular_error(truth, first).withColumnRenamed("angle", "ea"), KEY, "left").join(angular_error(truth, second).withColumnRenamed("angle", "eb"), KEY, "left")
    both = (F.col("a") == F.col("t")) & (F.col("b") == F.col("t"))
    return rows.agg(F.count_if(F.col("a") == F.col("t")).alias("first_right"), F.count_if(F.col("b") == F.col("t")).alias("second_right"), F.avg(F.when(both, F.col("eb") - F.col("ea"))).alias("mean_gain"))


def signal_variance(signals: DataFrame) -> DataFrame:
    """(voxel, variance) of each voxel's signal over its s0."""
    x = F.transform("dw", lambda v: v / F.nullif(F.col("s0"), F.lit(0.0)))
    m = V.total(x) / F.size(x)
    return signals.select(*KEY, (V.total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)).alias("variance"))


def alpha_differences(voxels: DataFrame) -> DataFrame:
    """(voxel, neighbour, w): 1 - d / max over lattice edges of the distance of coefficient arrays `alpha`."""
    at = voxels.withColumn("__at", F.struct(*KEY))
    near = meeting(voxels.select(*KEY, "alpha"), shifted(at, ["alpha", "__at"], OFFSETS26))
    d = near.select(*KEY, F.col("n___at").alias("neighbour"), V.distance(F.col("alpha"), F.col("n_alpha")).alias("d"))
    return d.join(F.broadcast(d.agg(F.max("d").alias("top")))).select(*KEY, "neighbour", (1 - F.coalesce(F.col("d") / F.nullif("top", F.lit(0.0)), F.lit(0.0))).alias("w"))


def normalized_separations(edges: DataFrame, value: str, least: float = 1e-6) -> DataFrame:
    """Edge values on a common scale from 0 to 1; left as they are where their range is below `least`."""
    b = edges.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    x = F.when(F.col("__b") - F.col("__a") >= least, (F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(F.col(value))
    return edges.join(F.broadcast(b)).withColumn(value, x).drop("__a", "__b")
