"""Neighbour joins: directions by angle, lattice offsets, and the filters built on them.

A lattice is a table keyed by (slice, row, col).  Neighbours are found by exploding the offsets of each
voxel and joining on the key, which costs 26 rows a voxel and never compares all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assignment
from ..functions import vectors as V
from . import graph

KEY = ["slice", "row", "col"]
OFFSETS26 = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
OFFSETS6 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
PASS_BYTES = 32 << 20
TILE = 1 << 17  # pairs compared at once
RUN = 256


def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), V.doubles(vector).alias("v"))


def blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, vectors) of all query rows, in blocks of at most about PASS_BYTES."""
    keys, rows, size = [], [], 0
    for k, x in keyed(queries, key, vector).toLocalIterator():
        keys.append(k)
        rows.append(np.array(x, dtype=float))
        size += 8 * (len(x) + 2)
        if size >= PASS_BYTES:
            yield pd.Series(keys).to_numpy(), np.stack(rows)
            keys, rows, size = [], [], 0
    if keys:
        yield pd.Series(keys).to_numpy(), np.stack(rows)


def compared(queries: DataFrame, base: DataFrame, key: str, vector: str, spec: str, run: Callable, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """finish(rows of `spec` from run(keys, vectors, batches of base)) for each block of queries.

    The base stays distributed and may have any size; one block at a time is sent to its tasks, and a pass
    is settled before the next begins.  Rows without a key or a vector have no part in it.
    """
    rows = keyed(base, key, vector)
    parts, sent = [], None
    for block in blocks(queries, key, vector):
        if parts:
            parts[-1] = graph.settle(parts[-1])
            sent.unpersist()
        sent = base.sparkSession.sparkContext.broadcast(block)
        parts.append(finish(rows.mapInPandas(lambda it, s=sent: run(*s.value, it), spec)))
    if not parts:
        return finish(base.sparkSession.createDataFrame([], spec))
    return reduce(DataFrame.unionByName, parts)


def tiles(q: np.ndarray, batches: Iterator[pd.DataFrame], term: Callable, prepare: Callable = np.asarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, ids, sums): term summed over the places, for the queries [lo, hi) and a batch of base rows.

    Places are added from first to last, as V.total does, so equal vectors have equal sums wherever they stand.
    """
    q = prepare(q)
    for pdf in batches:
        if len(pdf):
            ids, x = pdf["id"].to_numpy(), np.ascontiguousarray(prepare(np.stack(pdf["v"].to_numpy()).astype(float)).T)
            step = max(1, TILE // len(ids))
            for lo in range(0, len(q), step):
                own = q[lo : lo + step]
                sums = np.zeros((len(own), len(ids)))
                for a, b in zip(own.T, x, strict=True):
                    sums += term(a[:, None], b)
                yield lo, lo + len(own), ids, sums


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, as V.normalize gives them; zero rows stay as they are."""
    n = np.zeros(len(x))
    for a in x.T:
        n += a * a
    n = np.sqrt(n)[:, None]
    return np.divide(x, n, out=x.copy(), where=n != 0)


def axial(q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, ids, dots in tiles(q, batches, np.multiply, unit):
        yield lo, hi, ids, np.arccos(np.fmin(1.0, np.abs(dots)))


def first_k(q: np.ndarray, angle: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, angle, q))
    q, angle, ids = q[order], angle[order], ids[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], angle[keep], ids[keep]


def nearest_axes(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """(key, rank, neighbour, angle): the k base axes nearest to each query, ties to the smaller key.

    A task keeps the k nearest of its own base rows for each query; only those are shuffled.
    """
    kind = base.schema[key].dataType.simpleString()

    def run(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, fresh = None, []
        for lo, hi, ids, angle in axial(q, batches):
            angle = np.round(angle, 9)
            if not itself:
                angle[keys[lo:hi, None] == ids] = np.inf
            kth = np.partition(angle, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) else np.inf
            i, j = np.nonzero((angle <= kth) & (angle < np.inf))
            fresh.append(first_k(i + lo, angle[i, j], ids[j], k))
            if hi == len(q):
                best = first_k(*[np.concatenate(x) for x in zip(*([best] if best else []), *fresh, strict=True)], k)
                fresh = []
        if best:
            yield pd.DataFrame({"q": best[0], key: keys[best[0]], "angle": best[1], "neighbour": best[2]})

    def finish(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy("angle", "neighbour")) - 1
        return rows.withColumn("rank", rank).where(F.col("rank") < k).select(key, "rank", "neighbour", "angle")

    return compared(queries, base, key, vector, f"q bigint, {key} {kind}, angle double, neighbour {kind}", run, finish)


def axes_within(queries: DataFrame, base: DataFrame, key: str, vector: str, most: float) -> DataFrame:
    """(key, neighbour, angle) of base axes at most `most` radians from each query, itself left out."""
    kind = base.schema[key].dataType.simpleString()

    def run(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lo, hi, ids, angle in axial(q, batches):
            i, j = np.nonzero((angle <= most) & (keys[lo:hi, None] != ids))
            yield pd.DataFrame({key: keys[lo:hi][i], "neighbour": ids[j], "angle": angle[i, j]})

    return compared(queries, base, key, vector, f"{key} {kind}, neighbour {kind}, angle double", run, lambda rows: rows)


def codify(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, neighbour, weight): dot products with the k nearest base axes, scaled to sum 1."""
    near = nearest_axes(queries, base, key, vector, k, itself=True).withColumn("c", F.cos("angle"))
    return near.withColumn("weight", F.col("c") / F.sum("c").over(Window.partitionBy(key))).select(key, "neighbour", "weight")


def pair_sqr_distances(queries: DataFrame, base: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, d) with i < j: squared distance of each query to the base rows after it."""
    kind = base.schema[key].dataType.simpleString()

    def run(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lo, hi, ids, d in tiles(q, batches, lambda a, b: (a - b) ** 2):
            i, j = np.nonzero(keys[lo:hi, None] < ids)
            yield pd.DataFrame({"i": keys[lo:hi][i], "j": ids[j], "d": d[i, j]})

    return compared(queries, base, key, vector, f"i {kind}, j {kind}, d double", run, lambda rows: rows)


def shifted(voxels: DataFrame, values: list[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(slice, row, col, n_*): each value at the voxels that see it as a neighbour."""
    o = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("ds", "dr", "dc"), strict=True)]) for p in offsets])).alias("o")
    rows = voxels.select(*KEY, *[F.col(v).alias(f"n_{v}") for v in values], o)
    return rows.select((F.col("slice") + F.col("o.ds")).alias("slice"), (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), *[f"n_{v}" for v in values])


def meeting(voxels: DataFrame, others: DataFrame) -> DataFrame:
    """voxels joined with what shifted() gives, both sides shuffled: neither goes through the driver, however small its files are."""
    return voxels.join(others.hint("merge"), KEY)


def neighbours(voxels: DataFrame, values: list[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    """voxels joined with their neighbours' values."""
    return meeting(voxels, shifted(voxels, values, offsets))


def difference(voxels: DataFrame, value: str, axis: str, forward: bool = True, boundary: str = "neumann") -> DataFrame:
    """Forward or backward difference along an axis.

    boundary: "circular" goes round, "dirichlet" takes 0 beyond the edge, "neumann" gives 0 at the edge.
    """
    others = [k for k in KEY if k != axis]
    w = Window.partitionBy(*others).orderBy(axis)
    every = Window.partitionBy(*others).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = F.lead(value).over(w) if forward else F.lag(value).over(w)
    edge = {"circular": F.first(value).over(every) if forward else F.last(value).over(every), "dirichlet": F.lit(0.0), "neumann": F.col(value)}[boundary]
    beyond = F.coalesce(beyond, edge)
    return voxels.withColumn(f"d_{axis}", beyond - F.col(value) if forward else F.col(value) - beyond)


def gradient(voxels: DataFrame, value: str, forward: bool = True, boundary: str = "neumann") -> DataFrame:
    """Differences along row and col."""
    return difference(difference(voxels, value, "row", forward, boundary), value, "col", forward, boundary)


def divergence(voxels: DataFrame, along_row: str, along_col: str, forward: bool = False, boundary: str = "dirichlet") -> DataFrame:
    """Sum of the differences of two components along their own axes."""
    r = difference(voxels, along_row, "row", forward, boundary)
    c = difference(r, along_col, "col", forward, boundary)
    return c.withColumn("div", F.col("d_row") + F.col("d_col")).drop("d_row", "d_col")


def gaussian_weights(queries: DataFrame, base: DataFrame, key: str, vector: str, sigma: float, places: int | None = None) -> DataFrame:
    """(src, dst, w): exp(-d2 / sigma^2) from each query to every base row, rounded in the tasks if places are given.

    The base is dealt over all tasks, a small file too, in the order of its vectors, and goes through them in runs
    of RUN rows.  Python gets a weight for each distinct vector of the queries and each row of a run; what is
    written out are lists, which the JVM opens: a run of targets for one source after another.  So sources and weights
    stand still for long and targets repeat in short cycles, and the table takes little room in a columnar file.
    """
    kind = base.schema[key].dataType.simpleString()
    scale = None if places is None else 10.0**places

    def run(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.lexsort(q.T[::-1]) if q.shape[1] else np.arange(len(q))
        keys, q = keys[order], q[order]
        first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]).any(1)))
        first = np.concatenate([np.arange(lo, hi, RUN) for lo, hi in zip(first, np.append(first[1:], len(q)), strict=True)])
        same = np.split(keys, first[1:])
        runs = (pdf.iloc[lo : lo + RUN] for pdf in batches for lo in range(0, len(pdf), RUN))
        for lo, hi, ids, d in tiles(q[first], runs, lambda a, b: (a - b) ** 2):
            w = np.exp(np.divide(d, -(sigma**2), out=d), out=d)
            if scale is not None:
                w *= scale
                w += 0.5
                np.floor(w, out=w)
                w /= scale
            yield pd.DataFrame({"srcs": same[lo:hi], "dsts": [ids] * (hi - lo), "ws": list(w)})

    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(tasks, F.col(vector), F.xxhash64(key)).sortWithinPartitions(vector, key)
    lists = compared(queries, dealt, key, vector, f"srcs array<{kind}>, dsts array<{kind}>, ws array<double>", run, lambda rows: rows)
    opened = lists.select(F.explode("srcs").alias("src"), "dsts", "ws").select("src", F.posexplode("dsts").alias("at", "dst"), "ws")
    return opened.select("src", "dst", F.get("ws", F.col("at")).alias("w"))


def compartments_of(field: DataFrame) -> DataFrame:
    """(voxel, k, id, dir) of each compartment; id is k of the voxel's place in the lattice, with room for the most compartments of any."""
    bounds = field.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.max(F.size("compartments")).alias("k")).first()
    if bounds["r"] is None:
        bounds = {"r": 0, "c": 0, "k": 0}
    place = (F.col("slice").cast("bigint") * (bounds["r"] + 1) + F.col("row")) * (bounds["c"] + 1) + F.col("col")
    rows = field.select(*KEY, place.alias("p"), F.posexplode("compartments").alias("k", "x"))
    return rows.select(*KEY, "k", (F.col("p") * bounds["k"] + F.col("k")).alias("id"), F.col("x.dir").alias("dir"))


def normalized(edges: DataFrame, offset: float) -> DataFrame:
    """Weights over the root of both ends' sums of |w|, to each of which twice the offset is added; the diagonal is src = dst."""
    d = graph.row_sums(edges, absolute=True).select(F.col("src").alias("id"), (1 / F.sqrt(F.col("total") + 2 * offset)).alias("v"))
    return graph.scaled(edges, d, d)


def compartment_graph(field: DataFrame, d0: float, theta0: float, most: float, offset: float) -> DataFrame:
    """(src, dst, w): the normalised-cut matrix of all compartments.

    Compartments of neighbouring voxels at most `most` degrees apart weigh exp(-(d2 / d0^2 + angle / (1 -
    cos 2 theta0))), angle in radians and theta0 in degrees; each has a 1 on the diagonal; then normalized().
    """
    rows = compartments_of(field)
    near = meeting(rows, shifted(rows.withColumn("at", F.struct(*KEY)), ["id", "dir", "at"], OFFSETS26))
    near = near.withColumn("angle", V.axial_angle(F.col("dir"), F.col("n_dir"))).where(F.col("angle") < math.radians(most))
    d2 = sum(F.pow(F.col(k) - F.col(f"n_at.{k}"), 2) for k in KEY)
    w = F.exp(-(d2 / (d0 * d0) + F.col("angle") / (1 - math.cos(2 * math.radians(theta0)))))
    return normalized(near.select(F.col("id").alias("src"), F.col("n_id").alias("dst"), w.alias("w")).unionByName(diagonal(rows)), offset)


def diagonal(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))


def assigned_graph(field: DataFrame, d0: float, theta0: float, most: float, offset: float) -> DataFrame:
    """The matrix of compartment_graph() with an edge only between compartments that the best matching of two voxels pairs.

    Weights are exp(-(d2 / d0^2 + angle / theta0)), angle and theta0 in radians; a voxel is matched with each
    neighbour before it in the lattice, and the edge stands in both directions.
    """
    rows = compartments_of(field)
    voxels = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "id", "dir"))).alias("cs"))
    voxels = voxels.select(*KEY, F.col("cs.id").alias("ids"), F.col("cs.dir").alias("dirs"), F.struct(*KEY).alias("at"))
    # A neighbour before a voxel sees it at the opposite offset.
    near = meeting(voxels, shifted(voxels, ["ids", "dirs", "at"], [o for o in OFFSETS26 if o > (0, 0, 0)]))

    @F.pandas_udf("array<int>")
    def matching(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([assignment.match_axes(np.stack(x), np.stack(y))[0].astype(np.int32) for x, y in zip(a, b, strict=True)])

    d2 = sum(F.pow(F.col(k) - F.col(f"n_at.{k}"), 2) for k in KEY)
    pairs = near.select("ids", "dirs", "n_ids", "n_dirs", d2.alias("d2"), F.posexplode(matching("dirs", "n_dirs")).alias("k", "to")).where("to >= 0")
    entry = lambda c, i: F.element_at(c, F.col(i) + 1)
    pairs = pairs.select(entry("ids", "k").alias("src"), entry("n_ids", "to").alias("dst"), V.axial_angle(entry("dirs", "k"), entry("n_dirs", "to")).alias("angle"), "d2")
    pairs = pairs.where(F.col("angle") < math.radians(most)).select("src", "dst", F.exp(-(F.col("d2") / (d0 * d0) + F.col("angle") / theta0)).alias("w"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return normalized(both.unionByName(diagonal(rows)), offset)


def full_distances(field: DataFrame, weight: float, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, d) with i < j of all compartments: 90 * weight within a voxel, else the distance of the voxels plus weight times
    the larger angle, in degrees, of the two axes to the line between them.

    One side goes out in blocks, as many passes as it needs.
    """
    rows = compartments_of(field).select("id", F.concat(F.array(*[F.col(k).cast("double") for k in ("col", "row", "slice")]), V.doubles("dir")).alias("v"))

    def run(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, x = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float)
            for lo in range(0, len(q), step := max(1, TILE // max(1, len(x)))):
                a = q[lo : lo + step, None]
                line = (a[..., :3] - x[None, :, :3]) * [1, -1, 1]  # rows count downwards
                far = np.sqrt((line**2).sum(-1))
                angle = lambda d: np.degrees(np.arccos(np.fmin(1.0, np.abs((line * d).sum(-1)) / np.where(far > 0, far * np.linalg.norm(d, axis=-1), 1))))  # noqa: B023, E731
                d = np.where(far > 0, far + weight * np.maximum(angle(a[..., 3:]), angle(x[None, :, 3:])), 90.0 * weight)
                i, j = np.nonzero(keys[lo : lo + step, None] < ids)
                yield pd.DataFrame({"i": keys[lo : lo + step][i], "j": ids[j], "d": d[i, j]})

    own = rows if queries is None else queries
    return compared(own, rows, "id", "v", "i bigint, j bigint, d double", run, lambda found: found)


def dual_lattice(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """(vox, axis, value) of edges (a, b, value) between voxel places: the lower place, and the axis along which they are neighbours.

    Pairs that are no neighbours along an axis are left out; of an edge that is given twice the larger value stays.
    """
    low, step = F.least("a", "b"), F.abs(F.col("a") - F.col("b"))
    axis = F.when(step == 1, "col").when(step == cols, "row").when(step == rows * cols, "slice")
    return edges.select(low.alias("vox"), axis.alias("axis"), "value").where("axis is not null").groupBy("vox", "axis").agg(F.max("value").alias("value"))


def lattice_weights(voxels: DataFrame, vector: str, d0: float, theta0: float, most: float) -> DataFrame:
    """(src, dst, w): axis neighbours within `most` radians, weighted exp(-(d2 / d0^2 + angle / (1 - cos 2 theta0))).

    For voxels with one axis each and an id column; the edges come in both directions, without a diagonal.
    """
    near = meeting(voxels.select(*KEY, "id", vector), shifted(voxels.withColumn("__at", F.struct(*KEY)), ["id", vector, "__at"], OFFSETS26))
    angle = V.axial_angle(V.doubles(vector), V.doubles(f"n_{vector}"))
    d2 = sum(F.pow(F.col(k) - F.col(f"n___at.{k}"), 2) for k in KEY)
    w = F.exp(-(d2 / (d0 * d0) + angle / (1 - math.cos(2 * theta0))))
    return near.withColumn("__angle", angle).where(F.col("__angle") < most).select(F.col("id").alias("src"), F.col("n_id").alias("dst"), w.alias("w"))
