"""Near-duplicate vectors through an inverted index of nearest pivots.

A vector is described by its PREFIX nearest reference points in order of nearness.  Every pivot has an
inverted list of the vectors that name it; two vectors of a list are candidates if they share at least
SHARED pivots, and candidates are verified by their cosine in double precision.

A list is cut into blocks and each pair of blocks is a task of bounded size, so no list has to fit
anywhere whole and none is cut short.  A pair is handled only in the list of its smallest shared pivot.
A block pair tells of each vector's links as a count, and of the links themselves only a spanning
forest, which has the same components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join, tidy
from .components import connected_components, forest

COSINE = 0.9
PREFIX = 8
SHARED = 2
PIVOTS_LEAST, PIVOTS_MOST = 32, 1024
SPREAD = 0.8
BLOCK = 1024


def choose_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` unit vectors in the order given, each with cosine below SPREAD to all before it."""
    kept = np.zeros((0, vectors.shape[1]))
    for v in vectors:
        if len(kept) >= most:
            break
        if not len(kept) or (kept @ v).max() < SPREAD:
            kept = np.vstack([kept, v])
    return kept


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each unit vector, nearest first, ties to the lower number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_blocks(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, pivot: int, n_pivots: int, least: float, shared: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in x, j in y) of the linked pairs that belong to this pivot's list."""
    a, b = (np.zeros((len(p), n_pivots), dtype=np.float32) for p in (px, py))
    np.put_along_axis(a, px, 1, 1)
    np.put_along_axis(b, py, 1, 1)
    lower = a[:, :pivot] @ b[:, :pivot].T
    found = (lower == 0) & (a[:, pivot:] @ b[:, pivot:].T >= shared)
    if same:
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    if len(i) * 20 > found.size:
        cosine = (x @ y.T)[i, j]
    else:
        cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    near = cosine >= least
    return i[near], j[near]


def links_of(classes: DataFrame, dim: int, least: float, prefix: int, shared: int) -> DataFrame | None:
    """Rows (a, b, w): with b null, w links of class a; with b given, an edge of the components."""
    spark = classes.sparkSession
    own = classes.where(F.size("embedding") == dim)
    n = own.count()
    if n < 2:
        return None
    most = min(PIVOTS_MOST, max(PIVOTS_LEAST, 1 << round(math.log2(math.sqrt(n)))), n)
    seen = own.orderBy("v").limit(4 * most).select("embedding").collect()
    pivots = choose_pivots(unit([r[0] for r in seen]), most)
    k, need = min(prefix, len(pivots)), min(shared, len(pivots))
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = nearest(unit(pdf["embedding"]), shared_pivots.value, k) if len(pdf) else []
            yield pdf.assign(near=list(np.asarray(near, dtype=np.int32)))

    described = materialise(own.select("v", "size", "embedding").mapInPandas(tidy(describe), "v bigint, size bigint, embedding array<double>, near array<int>"), "permutations")
    lengths = {r["p"]: r["m"] for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count("*").alias("m")).collect()}
    blocks = np.ones(len(pivots), dtype=np.int32)
    for p, m in lengths.items():
        blocks[p] = -(-m // BLOCK)
    many = F.array(*[F.lit(int(b)) for b in blocks])
    posted = described.select("v", "size", "embedding", "near", F.explode("near").alias("p"))
    posted = posted.withColumn("of", F.element_at(many, F.col("p") + 1)).withColumn("blk", F.pmod(F.xxhash64("v"), F.col("of")).cast("int"))
    other = F.sequence(F.lit(0), F.col("of") - 1)
    tasks = posted.withColumn("o", F.explode(other)).withColumn("lo", F.least("blk", "o")).withColumn("hi", F.greatest("blk", "o")).drop("o", "of")

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, lo, hi = key
        x, px = unit(pdf["embedding"]), np.stack(pdf["near"].to_numpy()).astype(np.int64)
        v, size, blk = pdf["v"].to_numpy(), pdf["size"].to_numpy(), pdf["blk"].to_numpy()
        first, second = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        i, j = link_blocks(x[first], px[first], x[second], px[second], int(pivot), len(pivots), least, need, lo == hi)
        i, j = first[i], second[j]
        count = np.bincount(i, weights=size[j], minlength=len(v)) + np.bincount(j, weights=size[i], minlength=len(v))
        hit = np.flatnonzero(count)
        edges = forest(zip(v[i].tolist(), v[j].tolist(), strict=True))
        return pd.DataFrame({
            "a": pd.array([*v[hit].tolist(), *[e[0] for e in edges]], dtype="Int64"),
            "b": pd.array([*[None] * len(hit), *[e[1] for e in edges]], dtype="Int64"),
            "w": pd.array([*count[hit].astype(np.int64).tolist(), *[0] * len(edges)], dtype="Int64"),
        })

    return tasks.groupBy("p", "lo", "hi").applyInPandas(link, "a bigint, b bigint, w bigint")


def near_vectors(source: DataFrame, least: float = COSINE, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector.

    Equal vectors are one class with its size, so copies are never paired.  Vectors that are null, empty
    or zero, or hold a null or non-finite component, and vectors of different lengths, link with
    nothing.  Rows equal in vec_id and embedding are one vector with a result each.  A null vec_id counts
    as an id of its own that is never the smallest, unless a component has no other.

    The pivots are the only sample: at most PIVOTS_MOST vectors, in the order of a hash of the vector.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = source.select("vec_id", e.alias("embedding"))
    fine = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: F.coalesce(x, F.lit(0.0)) != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("v", F.xxhash64(F.when(F.col("fine"), F.transform("embedding", lambda x: x + F.lit(0.0)))))
    good = rows.where("fine").drop("fine")
    distinct = good.groupBy("v", "vec_id").agg(F.first("embedding").alias("embedding"))
    classes = materialise(distinct.groupBy("v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")), "classes")
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    found = [x for d in sorted(dims) if (x := links_of(classes, d, least, prefix, shared)) is not None]
    if found:
        links = found[0]
        for x in found[1:]:
            links = links.unionByName(x)
        links = materialise(links, "links")
        degrees = links.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("w"))
        comps = connected_components(links.where("b is not null").select("a", "b"))
        classes = classes.join(degrees, "v", "left").join(comps, "v", "left")
    else:
        classes = classes.withColumn("w", F.lit(0)).withColumn("comp", F.col("v"))
    classes = classes.select("v", "size", "least", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("comp", "v").alias("comp"))
    several = classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("m")).where("m > 1").drop("m")
    classes = materialise(spread_join(classes, several, "comp").withColumn("component_id", F.coalesce("component_id", "least")), "classes")
    named = spread_join(good.select("vec_id", "v"), classes, "v").select("vec_id", (F.col("size") - 1 + F.col("w")).cast("bigint").alias("n_links"), "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
