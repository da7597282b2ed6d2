"""Synthetic fields and signals, generated where they are used: each voxel's numbers come from a hash of its place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from . import graph
from .neighbours import KEY

FIELD = "slice int, row int, col int, compartments array<struct<fraction:double,dir:array<double>,lambda:array<double>,grp:int>>"


def grid(spark: SparkSession, slices: int, rows: int, cols: int) -> DataFrame:
    n = F.col("id")
    return spark.range(slices * rows * cols).select(F.floor(n / (rows * cols)).cast("int").alias("slice"), F.pmod(F.floor(n / cols), F.lit(rows)).cast("int").alias("row"), F.pmod(n, F.lit(cols)).cast("int").alias("col"))


def axis(rng: np.random.Generator) -> np.ndarray:
    v = rng.standard_normal(3)
    return v / np.linalg.norm(v)


def random_field(spark: SparkSession, slices: int, rows: int, cols: int, least_angle: float = 30.0, longitudinal: float = 1.7e-3, transversal: float = 3e-4, seed: int = 0, crossing=None) -> DataFrame:
    """A field of two compartments a voxel (of one where crossing(slice, row, col) is false), fractions 0.4 to 0.6, at least an angle apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, r, c in zip(pdf["slice"], pdf["row"], pdf["col"], strict=True):
                rng = np.random.default_rng([seed, s, r, c])
                two = crossing is None or crossing(s, r, c)
                a, b = axis(rng), axis(rng)
                while two and np.degrees(np.arccos(min(1.0, abs(a @ b)))) < least_angle:
                    b = axis(rng)
                f = rng.uniform(0.4, 0.6) if two else 1.0
                out.append([{"fraction": x, "dir": d.tolist(), "lambda": [transversal, transversal, longitudinal], "grp": k} for k, (x, d) in enumerate([(f, a), (1 - f, b)][: 2 if two else 1])])
            yield pdf.assign(compartments=out)

    return grid(spark, slices, rows, cols).mapInPandas(run, FIELD)


def simulate(field: DataFrame, gradients: np.ndarray, b, snr: float = 0.0, seed: int = 0) -> DataFrame:
    """(voxel, s0 = 1, dw): signals of each voxel's tensors with Rician noise of sigma 1 / snr (none for snr <= 0).

    Voxels are dealt over all tasks: a small file has work for as many.
    """
    g = np.asarray(gradients, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, r, c, cs in zip(pdf["slice"], pdf["row"], pdf["col"], pdf["compartments"], strict=True):
                y = models.signal([x["fraction"] for x in cs], [models.tensor(np.asarray(x["dir"]), x["lambda"][2], x["lambda"][0]) for x in cs], g, b) if len(cs) else np.zeros(len(g))
                out.append(models.rician(y, 1 / snr, np.random.default_rng([seed, s, r, c])) if snr > 0 else y)
            yield pdf[KEY].assign(s0=1.0, dw=out)

    return graph.spread(field.select(*KEY, "compartments"), *KEY).mapInPandas(run, "slice int, row int, col int, s0 double, dw array<double>")


def field_from_paths(spark: SparkSession, paths: list[np.ndarray], radius: float, size: int = 50, longitudinal: float = 1.7e-3, transversal: float = 3e-4) -> DataFrame:
    """Voxels of a cube and the direction of each path's nearest segment within radius; the few paths go to every task."""
    segments = [(k, p[i], p[i + 1]) for k, p in enumerate(paths) for i in range(len(p) - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[KEY].to_numpy(float)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for k, a, b in segments:
                ab = b - a
                t = np.clip(((x - a) @ ab) / max(ab @ ab, 1e-300), 0, 1)
                d = ((x - a - t[:, None] * ab) ** 2).sum(1)
                u = ab / max(np.linalg.norm(ab), 1e-300)
                old = best.get(k)
                if old is None:
                    best[k] = d, np.tile(u, (len(x), 1))
                else:
                    near = d < old[0]
                    best[k] = np.where(near, d, old[0]), np.where(near[:, None], u, old[1])
            out = []
            for i in range(len(x)):
                hit = [v[i] for d, v in best.values() if d[i] < radius**2]
                out.append([{"fraction": 1 / len(hit), "dir": v.tolist(), "lambda": [transversal, transversal, longitudinal], "grp": k} for k, v in enumerate(hit)])
            yield pdf.assign(compartments=out)

    return grid(spark, size, size, size).mapInPandas(run, FIELD)


def sphere(n: int) -> np.ndarray:
    """n directions spread evenly over the half sphere, by the golden angle."""
    k = np.arange(n) + 0.5
    z, a = 1 - k / n, np.pi * (1 + 5**0.5) * k
    s = np.sqrt(1 - z * z)
    return np.stack([s * np.cos(a), s * np.sin(a), z], 1)


def spread_directions(directions: np.ndarray, k: int, least: float) -> np.ndarray:
    """The first k axes in order that are pairwise at least `least` radians apart."""
    out: list[np.ndarray] = []
    for d in directions:
        if len(out) == k:
            break
        if all(np.arccos(min(1.0, abs(d @ o))) >= least for o in out):
            out.append(d)
    return np.array(out)


def direction_near(reference: np.ndarray, degrees: float, rng: np.random.Generator, draws: int = 1000) -> np.ndarray:
    """Of random axes the one whose angle to the reference is nearest to a target."""
    v = rng.standard_normal((draws, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v[np.argmin(np.abs(np.degrees(np.arccos(np.clip(np.abs(v @ reference), 0, 1))) - degrees))]
