"""Per-voxel model fits as vectorised functions over Arrow batches: no shuffle, one voxel's arrays at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models, solvers
from . import graph
from .neighbours import KEY, OFFSETS26, shifted


def fit_tensor(signals: DataFrame, gradients: np.ndarray, b: float, keys: list[str] = KEY) -> DataFrame:
    """keys and ev, pdd, md, fa of (s0, dw); NaN where a signal is too small."""
    model = models.TensorModel(b, np.asarray(gradients, float))
    spec = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = model.voxels(pdf["s0"].to_numpy(float), np.stack(pdf["dw"].to_numpy()).astype(float))
                yield pdf[keys].reset_index(drop=True).assign(ev=list(found["ev"]), pdd=list(found["pdd"]), md=found["md"], fa=found["fa"])

    return signals.select(*keys, "s0", "dw").mapInPandas(run, f"{spec}, ev array<double>, pdd array<double>, md double, fa double")


def average_profile(fits: DataFrame, mask: str, bits: int, value: int) -> DataFrame:
    """(l1, l2, l3, n): mean eigenvalues of voxels where mask & bits = value."""
    rows = fits.where(F.col(mask).bitwiseAND(F.lit(bits)) == value)
    return rows.agg(*[F.avg(F.element_at("ev", i)).alias(f"l{i}") for i in (1, 2, 3)], F.count("*").alias("n"))


def fit_orientations(signals: DataFrame, gradients: np.ndarray, directions: np.ndarray, b: float, longitudinal: float, transversal: float, solver: str = "nnls", sparsity: float = 0.0, refit: bool = False, keys: list[str] = KEY, grouped: bool = True) -> DataFrame:
    """keys and alpha, sse, rmse and compartments (grouped peaks; none are looked for unless grouped) of each voxel."""
    if solver not in solvers.SOLVERS:
        raise ValueError(f"no solver {solver}; there are {sorted(solvers.SOLVERS)}")
    phi = models.basis(gradients, directions, b, longitudinal, transversal)
    axes = np.asarray(directions, float)
    near = models.neighbourhoods(axes, k=min(16, len(axes) - 1))
    spec = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s0 = pdf["s0"].to_numpy(float)
            y = np.stack(pdf["dw"].to_numpy()).astype(float) / np.where(np.isnan(s0) | (s0 == 0), 1.0, s0)[:, None]
            alpha, sse, rmse = models.fit_bases(y, phi, solver, sparsity, refit)
            parts = []
            for x in alpha:
                found = models.peaks(x, axes, near=near) if grouped and (x > 0).any() else []
                parts.append([{"fraction": float(f), "dir": d.tolist(), "lambda": [transversal, transversal, longitudinal], "grp": k} for k, (d, f) in enumerate(found)])
            yield pdf[keys].reset_index(drop=True).assign(alpha=list(alpha), sse=sse, rmse=rmse, compartments=parts)

    return signals.select(*keys, "s0", "dw").mapInPandas(run, f"{spec}, alpha array<double>, sse double, rmse double, compartments array<struct<fraction:double,dir:array<double>,lambda:array<double>,grp:int>>")


def fit_deconvolution(signals: DataFrame, gradients: np.ndarray, response: np.ndarray, constraints: np.ndarray, lmax: int = 6, keys: list[str] = KEY) -> DataFrame:
    """keys and sh: the fibre orientation's harmonic coefficients."""
    model = models.Deconvolution(response, np.asarray(gradients, float), np.asarray(constraints, float), lmax)
    spec = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keys].assign(sh=[model.solve(s0, dw) for s0, dw in zip(pdf["s0"], pdf["dw"], strict=True)])

    return signals.select(*keys, "s0", "dw").mapInPandas(run, f"{spec}, sh array<double>")


def smooth_coefficients(voxels: DataFrame, weight: float, rounds: int = 5) -> DataFrame:
    """Coefficients pulled to their neighbours' mean: Jacobi rounds of (a + weight * sum of neighbours) / (1 + weight * n)."""
    now = voxels.select(*KEY, "alpha", F.col("alpha").alias("data"))
    for _ in range(rounds):
        near = shifted(now, ["alpha"], OFFSETS26).select(*KEY, F.posexplode("n_alpha").alias("i", "x"))
        sums = near.groupBy(*KEY, "i").agg(F.sum("x").alias("x"), F.count("*").alias("m")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"), F.max("m").alias("m"))
        joined = now.join(sums, KEY, "left")
        now = graph.settle(joined.select(*KEY, F.when(F.col("m").isNull(), F.col("data")).otherwise(F.zip_with("data", "xs", lambda d, x: F.greatest(F.lit(0.0), (d + weight * x["x"]) / (1 + weight * F.col("m"))))).alias("alpha"), "data"))
    return now.select(*KEY, "alpha")
