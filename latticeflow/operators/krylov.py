"""Leading eigenpairs of a symmetric edge table to a tolerance.

A basis grows by the residuals of the wanted pairs, a block at a time, which spans what Lanczos steps of a block span;
every block is made orthogonal to all before it twice over.  When the basis is full it starts again from its best
vectors, so nothing grows with the number of steps.  What stops it is the norm of the residuals, summed row by row.

A vertex's row holds its entries of the basis and of the matrix times the basis; only matrices of the size of the
basis come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def summed(rows: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over batches of run(q, mq), an array of fixed shape, added up in the tasks first."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = run(np.stack(pdf["q"].to_numpy()), np.stack(pdf["mq"].to_numpy()))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"n": np.int32(total.shape[-1]), "s": [total.reshape(-1)]})

    parts = rows.select("q", "mq").mapInPandas(each, "n int, s array<double>").select("n", F.posexplode("s").alias("i", "x"))
    found = sorted((r["i"], r["n"], r["x"]) for r in parts.groupBy("i", "n").agg(F.sum("x").alias("x")).collect())
    return np.array([x for _, _, x in found]).reshape(-1, found[0][1])


def times(m: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """(id, y): the matrix times a block of `width` columns (id, x)."""
    parts = m.join(block.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id"))
    return parts.agg(*[F.sum(F.col("w") * F.element_at("x", k + 1)).alias(f"y{k}") for k in range(width)]).select("id", F.array(*[f"y{k}" for k in range(width)]).alias("y"))


def leading_eigenpairs(m: DataFrame, vertices: DataFrame, k: int, tolerance: float = 1e-6, most: int = 48, extra: int = 2, rounds: int = 500) -> tuple[np.ndarray, DataFrame]:
    """(values, (id, x)): the k largest eigenvalues, largest first, and each vertex's entries of their vectors.

    m: src, dst, w, symmetric; vertices: id, each once.  Pairs whose residual |Mx - vx| is not under the tolerance times
    the largest value's size (1 at least) after `rounds` blocks raise.  Fewer vertices than k: as many pairs as there are.
    """
    n = vertices.count()
    k, width = min(k, n), min(k + extra, n)
    if not n:
        return np.zeros(0), vertices.select("id", F.array().cast("array<double>").alias("x"))
    m = graph.settle(m.select("src", "dst", "w"))
    start = F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000003)) / 1000003.0 - 0.5 for j in range(width)])
    fresh = graph.settle(vertices.select("id", start.alias("q"), F.array().cast("array<double>").alias("mq")))
    gram = summed(fresh, lambda q, mq: q.T @ q)
    first = np.linalg.inv(np.linalg.cholesky(gram)).T
    kind = vertices.schema["id"].dataType.simpleString()

    def applied(rows: DataFrame, old: np.ndarray, new: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
        """Rows whose basis is q @ old and the block new(q, mq), the matrix times it made anew for the block only."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    q, mq = np.stack(pdf["q"].to_numpy()), np.stack(pdf["mq"].to_numpy())
                    yield pd.DataFrame({"id": pdf["id"], "q": list(q @ old if old.size else q[:, :0]), "mq": list(mq @ old if old.size else mq[:, :0]), "x": list(new(q, mq))})

        made = graph.settle(rows.mapInPandas(run, f"id {kind}, q array<double>, mq array<double>, x array<double>"))
        zero = F.array_repeat(F.lit(0.0), width)
        out = graph.settle(made.join(times(m, made, width), "id", "left").select("id", F.concat("q", "x").alias("q"), F.concat("mq", F.coalesce("y", zero)).alias("mq")))
        graph.discard(made)
        return out

    rows = applied(fresh, np.zeros((0, 0)), lambda q, mq: q @ first, width)
    graph.discard(fresh)
    for _ in range(rounds):
        t = summed(rows, lambda q, mq: q.T @ mq)
        values, s = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)[:width]
        theta, s = values[order], s[:, order]
        residual = lambda q, mq: mq @ s - (q @ s) * theta  # noqa: B023, E731
        both = summed(rows, lambda q, mq: np.hstack([q, residual(q, mq)]).T @ residual(q, mq))  # noqa: B023
        c, size = both[: len(t)], np.sqrt(np.maximum(np.diag(both[len(t) :]), 0.0))
        done = size[:k].max() < tolerance * max(1.0, abs(theta[0]))
        again = lambda q, mq: residual(q, mq) - q @ c  # noqa: B023, E731
        if not done:
            both = summed(rows, lambda q, mq: np.hstack([q, again(q, mq)]).T @ again(q, mq))  # noqa: B023
            c2, g = both[: len(t)], both[len(t) :] - both[: len(t)].T @ both[: len(t)]
            w, u = np.linalg.eigh((g + g.T) / 2)
            keep = w > max(1e-28, 1e-12 * w.max())
            done = not keep.any() or len(t) >= n  # the basis holds an invariant space
        if done:
            table = F.array(*[F.array(*[F.lit(float(x)) for x in col]) for col in s[:, :k].T])
            x = F.transform(table, lambda col: F.aggregate(F.zip_with("q", col, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
            out = graph.settle(rows.select("id", x.alias("x")))
            graph.discard(rows, m)
            return theta[:k], out
        turn = (u[:, keep] / np.sqrt(w[keep]))[:, : max(1, n - len(t))]
        block = lambda q, mq: (again(q, mq) - q @ c2) @ turn  # noqa: B023, E731
        full = len(t) + turn.shape[1] > most
        old, rows = rows, applied(rows, s if full else np.eye(len(t)), block, turn.shape[1])
        graph.discard(old)
    raise RuntimeError(f"residuals of {size[:k].max():.2g} after {rounds} blocks")
