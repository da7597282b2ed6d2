"""Nearest vectors by cosine through a forest of random-projection trees and one queue over all its leaves.

Every tree has one random direction a level, all directions of a tree at right angles, and parts the vectors
of a node at the median of their projections.  Cells above 2 * LEAF vectors are parted further, up to STEP
levels a round, whatever the number of vectors: thresholds come from a bounded sample of each cell (SAMPLE,
by a hash), and every vector is sent down to its leaf.

The queue holds nodes of all trees by the chance that a neighbour at distance r lies below them.  A random
direction sees a difference of length r as a normal variate of deviation r / sqrt(dim), so that chance is a
product over levels, with r the query's distance to the k-th of its own leaves.  Nodes leave the queue, the
likeliest first, until the expected number of trees that find a neighbour passes HITS, whatever the number of
leaves that takes: few where neighbours are near, many where all vectors are equally far.  Queues are tables
here: a level of cells is expanded for all queries at once, and of each query's nodes the likeliest stay.
What is in the chosen leaves is ranked by the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, spread_join, tidy

NEAREST, QUERY_STEP = 5, 50
TREES, FIRST = 8, 4
LEAF, SAMPLE, STEP = 128, 8192, 10
HITS, INNER_HITS = 4.75, 7.0
BLOCK = 4096
CHANCES = 1 << 18
BINS = 40
SEED = 11


@lru_cache(maxsize=64)
def directions(dim: int, tree: int, levels: int) -> np.ndarray:
    """dim x levels unit columns, at right angles to one another in runs of at most dim."""
    rng = np.random.default_rng([SEED, tree, dim])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-levels // dim)))]
    return np.hstack(parts)[:, :levels]


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thresholds(p: np.ndarray) -> np.ndarray:
    """Medians of a full tree in heap order: level l parts by column l of the projections p."""
    node, out = np.zeros(len(p), dtype=np.int64), []
    for level in range(p.shape[1]):
        order = np.lexsort((p[:, level], node))
        ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
        n = np.diff(ends)
        last = max(len(p) - 1, 0)
        mid = p[order, level][[np.minimum(ends[:-1] + (n - 1).clip(0) // 2, last), np.minimum(ends[:-1] + n // 2, last)]].mean(axis=0)
        cut = np.where(n > 0, mid, 0.0)
        out.append(cut)
        node = 2 * node + (p[:, level] > cut[node])
    return np.concatenate(out) if out else np.zeros(0)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Phi(z) to 1e-7, by the rational approximation of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def leaf_chances(p: np.ndarray, cut: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Chance of each leaf of a heap of thresholds, for rows of projections p (rows x levels); cut: one heap for all rows, or one for each."""
    cut = np.atleast_2d(cut)
    chance = np.ones((len(p), 1))
    for level in range(p.shape[1]):
        first = (1 << level) - 1
        up = normal_cdf((p[:, level, None] - cut[:, first : 2 * first + 1]) / sigma[:, None])
        chance = np.stack([chance * (1 - up), chance * up], axis=2).reshape(len(p), -1)
    return chance


def best_of(x: np.ndarray, y: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine) of the k largest cosines of each unit row of x that reach its `least`, and all that tie with the last.

    The products of whole blocks choose; what is returned is summed anew row by row, so that a pair has the
    same value wherever it meets.
    """
    rough = x @ y.T
    k = min(k, rough.shape[1])
    last = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    i, j = np.nonzero(rough >= np.maximum(last, least)[:, None] - 1e-12)
    return i, j, np.clip((x[i] * y[j]).sum(axis=1), -1.0, 1.0)


class Forest:
    """The index of one table of distinct vectors (v, embedding), all of length dim.

    places: v, tree, cell, depth, proj, on disk.  splits: a table of thresholds for each round, keyed by tree and cell.
    """

    def __init__(self, vectors: DataFrame, dim: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, step: int = STEP):
        self.dim, self.trees, self.leaf = dim, trees, leaf
        self.n = vectors.count()
        self.levels = max(0, math.ceil(math.log2(max(self.n, 1) / leaf))) + 2 if self.n > 2 * leaf else 0
        self.vectors, self.splits, self.fronts = vectors, [], []
        self.places = materialise(self.projected(vectors), "places")
        while True:
            big = self.places.groupBy("tree", "cell", "depth").agg(F.count("*").alias("n")).where((F.col("n") > 2 * leaf) & (F.col("depth") < self.levels))
            big = materialise(big.withColumn("d", F.least(F.lit(step), self.levels - F.col("depth"), F.ceil(F.log2(F.col("n") / leaf)).cast("int"))), "cells")
            if big.isEmpty():
                discard(big)
                return
            share = F.pmod(F.xxhash64(F.lit("sample"), "tree", "v"), F.lit(1 << 30)) / float(1 << 30)
            rows = self.places.join(self._small(big), ["tree", "cell", "depth"]).where(share < F.lit(sample) / F.col("n"))
            cuts = materialise(rows.select("tree", "cell", "depth", "d", "proj").groupBy("tree", "cell").applyInPandas(self._fit, "tree int, cell bigint, d int, cuts array<double>"), "splits")
            i = F.aggregate(F.sequence(F.lit(0), F.col("d") - 1), F.lit(0), lambda at, k: (2 * at + 1 + (F.get("proj", F.col("depth") + k) > F.get("cuts", at)).cast("int")).cast("int"))
            parted = self.places.join(self._small(cuts), ["tree", "cell"], "left").withColumn("under", F.coalesce(i, F.lit(0)))
            width = F.pow(F.lit(2), F.coalesce("d", F.lit(0))).cast("bigint")
            parted = parted.select("v", "tree", (F.col("cell") * width + F.when(F.col("d").isNotNull(), F.col("under") - width + 1).otherwise(0)).alias("cell"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), "proj")
            old, self.places = self.places, materialise(parted, "places")
            self.splits.append(cuts)
            discard(old, big)

    def _small(self, table: DataFrame) -> DataFrame:
        """Cells of the first round are one a tree, which is a proven bound: these are broadcast."""
        return table if self.splits else F.broadcast(table)

    def projected(self, vectors: DataFrame) -> DataFrame:
        """v, tree, cell, depth, proj of the root cells: proj holds the projections of all levels."""
        dim, trees, levels = self.dim, self.trees, self.levels

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, v = unit(pdf["embedding"]), pdf["v"]
                    for t in range(trees):
                        yield pd.DataFrame({"v": v, "tree": np.int32(t), "proj": list(x @ directions(dim, t, levels))})

        return vectors.select("v", "embedding").mapInPandas(tidy(run), "v bigint, tree int, proj array<double>").select("v", "tree", F.lit(1).cast("bigint").alias("cell"), F.lit(0).alias("depth"), "proj")

    @staticmethod
    def _fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, cell = key
        depth, d = int(pdf["depth"].iloc[0]), int(pdf["d"].iloc[0])
        p = np.stack(pdf["proj"].to_numpy())[:, depth : depth + d]
        return pd.DataFrame({"tree": np.int32([tree]), "cell": [cell], "d": np.int32([d]), "cuts": [thresholds(p)]})

    def own_leaves(self, queries: DataFrame, first: int) -> DataFrame:
        """q, tree, cell, least of the leaves in which queries (v) themselves lie, in the first trees."""
        own = queries.select("v")
        return self.places.where(F.col("tree") < first).join(own, "v", "left_semi").select(F.col("v").alias("q"), "tree", "cell", F.lit(-1.0).alias("least"))

    def likely_leaves(self, reach: DataFrame, hits: float, inner: float) -> DataFrame:
        """q, tree, cell, least of the leaves that leave the queue of each query; reach: q, the cosine (least) and distance of its k-th so far."""
        dim = self.dim
        roots = materialise(self.projected(self.vectors.join(reach.select(F.col("q").alias("v")), "v", "left_semi")).withColumnRenamed("v", "q").join(reach, "q"), "roots")
        self.fronts.append(roots)
        front = roots.withColumn("chance", F.lit(1.0))

        def chances(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, int]]:
            """(rows, chance of each leaf below, levels), for at most CHANCES chances at a time, whatever cells their rows are of."""
            for (depth, d), rows in pdf.groupby(["depth", "d"]):
                step = max(1, CHANCES >> d)
                for lo in range(0, len(rows), step):
                    some = rows.iloc[lo : lo + step]
                    own = np.stack(some["proj"].to_numpy())[:, depth : depth + d]
                    sigma = np.maximum(some["reach"].to_numpy() / math.sqrt(dim), 1e-9)
                    yield some, leaf_chances(own, np.stack(some["cuts"].to_numpy()), sigma) * some["chance"].to_numpy()[:, None], d

        def masses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for some, c, _ in chances(pdf):
                    of = np.clip(-np.log2(np.maximum(c, 1e-300)), 0, BINS - 1).astype(np.int64) + BINS * np.arange(len(c))[:, None]
                    total = np.bincount(of.reshape(-1), weights=c.reshape(-1), minlength=BINS * len(c)).reshape(len(c), BINS)
                    yield pd.DataFrame({"q": some["q"].to_numpy(), **{f"m{k}": total[:, k] for k in range(BINS)}})

        def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for some, c, d in chances(pdf):
                    i, leaf = np.nonzero(c >= some["floor"].to_numpy()[:, None])
                    yield pd.DataFrame({"q": some["q"].to_numpy()[i], "tree": some["tree"].to_numpy()[i], "cell": some["cell"].to_numpy()[i] * (1 << d) + leaf, "depth": (some["depth"].to_numpy()[i] + d).astype(np.int32), "chance": c[i, leaf]})

        likeliest = Window.partitionBy("q").orderBy(F.desc("chance"), "tree", "cell").rowsBetween(Window.unboundedPreceding, -1)
        for k, cuts in enumerate(self.splits):
            last = k + 1 == len(self.splits)
            enough = hits if last else inner
            joined = front.join(cuts if k else F.broadcast(cuts), ["tree", "cell"], "left")
            done, open_ = joined.where("d is null"), joined.where("d is not null").select("q", "tree", "cell", "depth", "d", "cuts", "proj", "reach", "chance")
            # How likely a node must be at least: masses in powers of two, so that only about what stays leaves the tasks.
            names = [f"m{i}" for i in range(BINS)]
            spread = open_.mapInPandas(tidy(masses), "q bigint, " + ", ".join(f"{m} double" for m in names))
            bin_of = F.least(F.lit(BINS - 1), F.floor(-F.log2("chance")))
            spread = spread.unionByName(done.select("q", *[F.when(bin_of == i, F.col("chance")).otherwise(0.0).alias(m) for i, m in enumerate(names)]))
            sums = F.array(*[F.sum(m) for m in names])
            below = F.aggregate(sums, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")), lambda s, m: F.struct((s["total"] + m).alias("total"), (s["n"] + (s["total"] + m < enough).cast("int")).alias("n")))
            floors = materialise(spread.groupBy("q").agg(below["n"].alias("n")).select("q", F.when(F.col("n") < BINS - 1, F.pow(F.lit(2.0), -(F.col("n") + 1.0))).otherwise(0.0).alias("floor")), "floors")
            self.fronts.append(floors)
            done = done.select("q", "tree", "cell", "depth", "chance")
            more = open_.join(floors, "q").mapInPandas(tidy(expand), "q bigint, tree int, cell bigint, depth int, chance double")
            nodes = done.unionByName(more)
            nodes = nodes.withColumn("before", F.coalesce(F.sum("chance").over(likeliest), F.lit(0.0))).where(F.col("before") < enough).drop("before")
            nodes = materialise(nodes, "front")
            self.fronts.append(nodes)
            front = nodes if last else nodes.join(roots.select("q", "tree", "proj", "reach"), ["q", "tree"])
        if not self.splits:  # every tree is one leaf, so one of them holds all
            front = front.where("tree = 0")
        return front.select("q", "tree", "cell").join(reach.select("q", "least"), "q")

    def ranked(self, asked: DataFrame, k: int) -> DataFrame:
        """q, v, score: of the vectors in the asked leaves (q, tree, cell) the k of largest cosine, each class once, the query's own included.

        least is what is known already: only cosines that reach it leave a leaf.
        """
        asked = materialise(asked, "asked")
        load = asked.groupBy("tree", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        sizes = self.places.groupBy("tree", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slabs"))
        load = materialise(load.join(sizes, ["tree", "cell"]), "load")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        queries = asked.join(load, ["tree", "cell"]).join(self.vectors.select(F.col("v").alias("q"), "embedding"), "q")
        queries = queries.select("tree", "cell", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), upto("slabs").alias("slab"), "q", "least", "embedding")
        members = self.places.select("v", "tree", "cell").join(load, ["tree", "cell"]).join(self.vectors.select("v", F.col("embedding").alias("vector")), "v")
        members = members.select("tree", "cell", upto("parts").alias("part"), F.pmod(F.xxhash64(F.lit("slab"), "v"), F.col("slabs")).cast("int").alias("slab"), "v", "vector")

        def rank(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(other):
                return pd.DataFrame({"q": np.int64([]), "v": np.int64([]), "score": np.float64([])})
            x, y, q, v, least = unit(own["embedding"]), unit(other["vector"]), own["q"].to_numpy(), other["v"].to_numpy(), own["least"].to_numpy()
            found = [(q[lo + i], v[j], s) for lo in range(0, len(x), 512) for i, j, s in [best_of(x[lo : lo + 512], y, k, least[lo : lo + 512])]]
            return pd.DataFrame(dict(zip(("q", "v", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        keys = ["tree", "cell", "part", "slab"]
        pairs = queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(rank, "q bigint, v bigint, score double")
        pairs = pairs.groupBy("q", "v").agg(F.max("score").alias("score"))
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
        out = materialise(pairs.withColumn("o", order).where(F.col("o") <= k).drop("o"), "ranked")
        discard(asked, load)
        return out


def usable(embedding: str) -> Column:
    """Vectors with a direction: not null, not empty or zero, without null or non-finite components."""
    e = F.col(embedding)
    return F.coalesce(F.exists(e, lambda x: F.coalesce(x, F.lit(0.0)) != 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def nearest(source: DataFrame, k: int = NEAREST, every: int = QUERY_STEP, trees: int = TREES, leaf: int = LEAF, hits: float = HITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors nearest by cosine to each vector whose vec_id is divisible by `every`.

    Nearest first, ties to the smaller vec_id; a query with fewer than k candidates gets all.  Rows with the
    query's own vec_id are no candidates.  Vectors that are null, empty or zero or hold a null or non-finite
    component, and rows with a null vec_id, take no part; vectors of different lengths are never compared.
    Rows equal in vec_id and vector count once; a vec_id with several vectors is a candidate with each, and
    asks with each.  Other columns, whatever their names, are not read.  Nothing usable: no rows.

    Equal vectors are one entry of the index and name their k + 1 smallest vec_ids, so copies in any number
    cost no more than one, and their ties come out in order.
    """
    rows = source.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("v", F.xxhash64("embedding"))
    ids = rows.select("v", "vec_id").distinct()
    classes = rows.groupBy("v").agg(F.first("embedding").alias("embedding"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks"))
    classes = materialise(classes.withColumn("dim", F.size("embedding")), "vectors")
    found = None
    for dim in sorted(r[0] for r in classes.where("asks = 1").select("dim").distinct().collect()):
        own = classes.where(F.col("dim") == dim)
        forest = Forest(own, dim, trees, leaf)
        asking = own.where("asks = 1")
        near = forest.ranked(forest.own_leaves(asking, FIRST), k + 1)
        if forest.splits:
            last = near.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            least = F.when(F.col("n") > k, F.col("least")).otherwise(-1.0)  # too few in its leaves: any distance
            last = last.select("q", least.alias("least"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * least)).alias("reach"))
            first, reach = near, materialise(last, "reach")
            near = forest.ranked(forest.likely_leaves(reach, hits, max(INNER_HITS, hits)), k + 1)
            discard(first, reach)
        discard(forest.places, *forest.splits, *forest.fronts)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    names = ids.join(found.select("v").distinct(), "v", "left_semi").withColumn("o", least).where(F.col("o") <= k + 1).select("v", "vec_id")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    pairs = found.join(names, "v").withColumn("o", order).where(F.col("o") <= k + 1)
    lists = pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("o", "vec_id", "score"))).alias("near")).withColumnRenamed("q", "v")
    asked = spread_join(ids.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), materialise(lists, "lists"), "v")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("rank", "e")).select("query_id", (F.col("rank") + 1).alias("rank"), "e.vec_id", "e.score")
