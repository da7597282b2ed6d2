"""Verification over pairs of rows that are counted where they are compared and never written.

Rows are dealt into blocks, and a task holds two of them.  Passes of counts narrow the range that holds the threshold;
they take distances from one matrix product, whose error has a bound.  The last pass sums the distances that the bound
leaves open place by place, as V.sqr_distance does, so that ties are told as over written pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

BLOCK = 32768  # rows of one side of a task
FEW = 12  # blocks of a table that is smaller
TILE = 1 << 21  # pairs compared at once
BINS = 1 << 16
OPEN = 1 << 18  # pairs of the last pass, but for those within the bound
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def blocks_of(n: int) -> int:
    return max(1, -(-n // BLOCK), min(FEW, -(-n // 1024)))


def equal_labels(i: np.ndarray, j: np.ndarray, same: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 for pairs of one label, 0 for those of two, -1 where a label is missing."""
    return np.where(known, same.astype(np.int8), np.int8(-1))


def masked(ignored: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Rule:
    """equal_labels() but for the pairs that ignored(i, j) leaves out; a missing label matches none."""
    return lambda i, j, same, known: np.where(ignored(i, j), np.int8(-1), (same & known).astype(np.int8))


def placewise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed from the first place to the last."""
    s = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        s += (a - b) ** 2
    return s


def rate_of_pairs(queries: DataFrame, base: DataFrame | None, key: str, vector: str, label: str, rule: Rule, rank: Callable[[int], int]) -> DataFrame:
    """(threshold, rate) over the pairs i < j of a query and a base row (of two queries, without a base).

    rule(i, j, same label, labels known) says 1 for a match, 0 for a non-match and -1 for neither; the threshold is the
    squared distance of the non-match of rank(number of non-matches), the rate the share of matches strictly below it.
    Keys differ; rows without a key or a vector have no part.
    """
    spark, alone = queries.sparkSession, base is None
    rows = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    left, right = rows(queries), rows(queries if base is None else base)
    norm = F.aggregate(V.doubles("v"), F.lit(0.0), lambda s, x: s + x * x)
    size = lambda d: d.agg(F.count("*"), F.max(F.when(~F.isnan(norm) & (norm < float("inf")), norm)), F.max(F.size("v"))).first()
    n, top, places = size(right)
    m, most = (n, top) if alone else size(left)[:2]
    top = max(top or 0.0, most or 0.0)
    slack = (2 * (places or 0) + 16) * np.finfo(float).eps * 4 * top
    a, b = blocks_of(m), blocks_of(n)
    deal = lambda d, k: d.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    least = F.col("blk") if alone else F.lit(0)
    left = deal(left, a).withColumn("with", F.explode(F.sequence(least, F.lit(b - 1))))
    right = deal(right, b).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blk") if alone else F.lit(a - 1))))
    left = left.select(F.col("blk").alias("p"), F.col("with").alias("q"), "id", "v", "l").groupBy("p", "q")
    right = right.select(F.col("with").alias("p"), F.col("blk").alias("q"), "id", "v", "l").groupBy("p", "q")

    def compared(task: tuple, one: pd.DataFrame, two: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, codes, distances), a tile at a time; distances that are not finite are summed place by place."""
        if not len(one) or not len(two):
            return
        x, y = (np.stack(p["v"].to_numpy()).astype(float) for p in (one, two))
        i, j, k, l = (p[c].to_numpy() for c in ("id", "l") for p in (one, two))
        known, ordered = (~pd.isna(k), ~pd.isna(l)), alone and task[0] != task[1]
        with np.errstate(all="ignore"):
            nx, ny = (x * x).sum(1), (y * y).sum(1)
            for lo in range(0, len(x), step := max(1, TILE // len(y))):
                own, p, q = x[lo : lo + step], i[lo : lo + step, None], j[None]
                d = own @ y.T
                d *= -2
                d += nx[lo : lo + step, None]
                d += ny
                first, last = (np.minimum(p, q), np.maximum(p, q)) if ordered else (p, q)
                code = rule(first, last, k[lo : lo + step, None] == l, known[0][lo : lo + step, None] & known[1])
                if not ordered:
                    code = np.where(p < q, code, np.int8(-1))
                if not np.isfinite(d.sum()):
                    s, t = np.nonzero(~np.isfinite(d))
                    d[s, t] = placewise(own[s], y[t])
                yield own, y, code, d

    def counts(lo: float, hi: float) -> np.ndarray:
        """(2, BINS + 4): non-matches and matches below lo, in each bin, above hi, infinite and without a distance."""

        def run(task: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((3, BINS + 4), dtype=np.int64)
            for _, _, code, d in compared(task, one, two):
                odd = None if np.isfinite(d.sum()) else ~np.isfinite(d)
                if odd is not None:
                    code = code.astype(np.int8)
                    kept, d = d, np.where(odd, 0.0, d)
                    for c in (0, 1):
                        here = odd & (code == c)
                        total[c + 1, BINS + 2] += np.isposinf(kept[here]).sum()
                        total[c + 1, BINS + 3] += np.isnan(kept[here]).sum()
                    code[odd] = -1
                d = (d - lo) * (BINS / (hi - lo))
                d += 1
                at = np.clip(d, 0, BINS + 1, out=d).astype(np.int32)
                at += (code.astype(np.int32) + 1) * (BINS + 4)
                total += np.bincount(at.ravel(), minlength=total.size).reshape(total.shape)
            c, at = np.nonzero(total[1:])
            return pd.DataFrame({"code": c.astype(np.int32), "bin": at.astype(np.int32), "n": total[1:][c, at]})

        found = left.cogroup(right).applyInPandas(run, "code int, bin int, n bigint").groupBy("code", "bin").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((2, BINS + 4), dtype=np.int64)
        for f in found:
            out[f["code"], f["bin"]] = f["n"]
        return out

    def answer(threshold: float | None, below: int) -> DataFrame:
        return spark.createDataFrame([(threshold, below / matches if matches else None)], "threshold double, rate double")

    lo, hi = -slack, 4 * top * (1 + 1e-9) + slack + 1e-300
    found = counts(lo, hi)
    others, matches = (int(x) for x in found.sum(1))
    r, finite = rank(others), int(found[0, : BINS + 2].sum())
    if r >= finite + found[0, BINS + 2]:
        return answer(None, 0)
    if r >= finite:
        return answer(math.inf, int(found[1, : BINS + 2].sum()))
    while True:
        at, width = int(np.searchsorted(np.cumsum(found[0]), r, side="right")) - 1, (hi - lo) / BINS
        if not 0 <= at < BINS:
            break
        lo, hi = lo + at * width, lo + (at + 1) * width
        if found[:, at + 1].sum() <= OPEN or width <= 8 * slack:
            break
        lo, hi = lo - 2 * slack, hi + 2 * slack
        found = counts(lo, hi)
    lo, hi = lo - 4 * slack, hi + 4 * slack

    def settled(task: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """(d, code, n): the pairs of each distance within the range; those below it stand at -1."""
        out = [pd.DataFrame({"d": np.zeros(0), "code": np.zeros(0, dtype=np.int32), "n": np.zeros(0, dtype=np.int64)})]
        for own, y, code, d in compared(task, one, two):
            below = np.bincount(code[(d < lo) & (code >= 0)], minlength=2)
            s, t = np.nonzero((d >= lo) & (d <= hi) & (code >= 0))
            near = pd.DataFrame({"d": placewise(own[s], y[t]), "code": code[s, t].astype(np.int32), "n": np.int64(1)})
            out += [pd.DataFrame({"d": -1.0, "code": np.array([0, 1], dtype=np.int32), "n": below}), near.groupby(["d", "code"], as_index=False)["n"].sum()]
        return pd.concat(out).groupby(["d", "code"], as_index=False)["n"].sum()

    each = left.cogroup(right).applyInPandas(settled, "d double, code int, n bigint").groupBy("d", "code").agg(F.sum("n").alias("n")).orderBy("d", "code").collect()
    before, threshold = 0, None
    for e in each:
        if e["code"] == 0:
            before += e["n"]
            if before > r:
                threshold = e["d"]
                break
    hits = sum(e["n"] for e in each if e["code"] == 1 and e["d"] < threshold)
    return answer(threshold, hits)
