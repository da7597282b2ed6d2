"""Whole experiments: load, simulate, denoise, reconstruct, regularise, evaluate and write, as one plan each.

Every step is an operator of this package; what is here is their order, the settings that bind them, and the
command line (`python -m latticeflow.operators.experiment --help`).
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, fields as dataclass_fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import scalars
from ..sources import fields as field_images
from ..sources import files, images, texts
from . import denoise, fields, fits, generate, graph, regularize, tiles
from .neighbours import KEY


@dataclass(frozen=True)
class Settings:
    """What an experiment runs with; names are those of a settings file's lines."""

    truth: str = ""
    truth_kind: str = "text"  # text, set, peaks or none
    signals: str = ""  # an image; simulated from the truth if empty
    scheme: str = ""
    basis: str = ""
    odf: str = ""
    output: str = ""
    b: float = 1500.0
    units: str = "s/mm^2"
    snr: float = 0.0
    samplings: int = 1
    longitudinal: float = 1.7e-3
    transversal: float = 3e-4
    estimate: bool = False
    solver: str = "nnls"
    sparsity: float = 0.0
    refit: bool = False
    smoothing: str = "none"  # none, mean, median, selective, tv, tgv or aligned
    strength: float = 0.05
    regularization: str = "none"  # none, nnls, robust or mixed
    regularization_weight: float = 4.5e-2
    least_fa: float = 0.3
    least_s0: float = -1.0
    most_signal: float = -1.0
    least_peak: float = 0.3
    seed: int = 0

    @property
    def weighting(self) -> float:
        """b in the units of the diffusivities."""
        return self.b * 1e6 if self.units == "s/m^2" else self.b


def parse(text: str) -> Settings:
    """Settings of a file's text; unknown names and values that are none raise ValueError."""
    kinds = {f.name: {"str": str, "int": int, "float": float, "bool": bool}[f.type] for f in dataclass_fields(Settings)}
    values, warnings = texts.parse_settings(text, kinds)
    if warnings:
        raise ValueError("; ".join(warnings))
    return Settings(**values)


def describe(settings: Settings) -> str:
    """The settings as lines that parse() reads back."""
    return texts.format_settings({f.name: getattr(settings, f.name) for f in dataclass_fields(settings) if getattr(settings, f.name) != ""})


class Clock:
    """Seconds since the last tic()."""

    def tic(self) -> Clock:
        self.began = time.perf_counter()
        return self

    def toc(self) -> float:
        return time.perf_counter() - self.began


def directions(spark: SparkSession, path: str, otherwise: int) -> np.ndarray:
    """Directions of a file in order, or that many spread over a sphere."""
    if not path:
        return generate.sphere(otherwise)
    return np.array([tuple(r) for r in texts.read_directions(spark, path).orderBy("path", "idx").select("x", "y", "z").collect()])


def read_truth(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """The field to compare with, or None."""
    if settings.truth_kind == "none" or not settings.truth:
        return None
    if settings.truth_kind == "set":
        return field_images.read_field_set(spark, *[f"{settings.truth}_{p}.nii" for p in ("counts", "fractions", "axes")])
    if settings.truth_kind == "peaks":
        return field_images.read_peaks(spark, settings.truth)
    axis = lambda r: F.array(*[F.element_at(r, i) for i in (3, 6, 9)])
    made = F.transform("compartments", lambda c, k: F.struct(c["fraction"].alias("fraction"), axis(c["rotation"]).alias("dir"), c["lambda"].alias("lambda"), k.cast("int").alias("grp")))
    return texts.read_field(spark, settings.truth).select(*KEY, made.alias("compartments"))


def load(spark: SparkSession, settings: Settings) -> dict:
    """{truth, signals, gradients, basis, odf}: tables and directions of the settings; a file that isn't there raises."""
    for name in ("truth", "signals", "scheme", "basis", "odf"):
        path = getattr(settings, name)
        if path and not (name == "truth" and settings.truth_kind == "set") and not files.exists(spark, path):
            raise FileNotFoundError(path)
    scheme = texts.read_scheme(spark, settings.scheme).orderBy("path", "idx").collect() if settings.scheme else []
    gradients = np.array([(r["x"], r["y"], r["z"]) for r in scheme if not r["is_s0"]]) if scheme else generate.sphere(48)
    truth = read_truth(spark, settings)
    if settings.signals:
        signals = images.split_baseline(images.read_nifti(spark, settings.signals), [r["idx"] for r in scheme if r["is_s0"]] or [0])
    else:
        signals = None if truth is None else simulated(truth, gradients, settings)
    return {"truth": truth, "signals": signals, "gradients": gradients, "basis": directions(spark, settings.basis, 129), "odf": directions(spark, settings.odf, 162)}


def simulated(truth: DataFrame, gradients: np.ndarray, settings: Settings) -> DataFrame:
    """(voxel, s0, dw): the mean of as many noisy acquisitions as the settings ask for."""
    each = [generate.simulate(truth, gradients, settings.weighting, settings.snr, settings.seed + k).select(*KEY, "s0", "dw") for k in range(max(1, settings.samplings))]
    if len(each) == 1:
        return each[0]
    rows = each[0]
    for one in each[1:]:
        rows = rows.unionByName(one)
    places = rows.select(*KEY, "s0", F.posexplode("dw").alias("i", "x")).groupBy(*KEY, "i").agg(F.avg("x").alias("x"), F.avg("s0").alias("s0"))
    return places.groupBy(*KEY).agg(F.max("s0").alias("s0"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(*KEY, "s0", F.col("v.x").alias("dw"))


def tensor_mask(signals: DataFrame, gradients: np.ndarray, settings: Settings) -> DataFrame:
    """(voxel, ev, pdd, md, fa, mask): tensor fits and the bits of shape, S0, FA and mean signal."""
    from ..functions import vectors as V

    rows = signals.join(fits.fit_tensor(signals, gradients, settings.weighting), KEY)
    shape = V.shape_coefficients(F.col("ev"))["shape"]
    mean = V.total(F.col("dw")) / F.size("dw")
    mask = scalars.voxel_mask(shape, F.col("s0"), F.col("fa"), mean, settings.least_s0, settings.least_fa, settings.most_signal, 0.9)
    return rows.select(*KEY, "ev", "pdd", "md", "fa", mask.alias("mask"))


def profile(masked: DataFrame, settings: Settings) -> tuple[float, float]:
    """(longitudinal, transversal): the mean profile of elongated tensors, else of those at the FA histogram's peak; the settings' own without either."""
    for bits, value in ((3, 1), (scalars.HISTOGRAM_BIT, scalars.HISTOGRAM_BIT)):
        r = fits.average_profile(masked, "mask", bits, value).first()
        if r["n"]:
            return float(r["l3"]), float(r["l1"] + r["l2"]) / 2
    return settings.longitudinal, settings.transversal


def smoothed(signals: DataFrame, gradients: np.ndarray, settings: Settings) -> DataFrame:
    """(voxel, s0, dw) with each gradient's volume smoothed as the settings say."""
    kind = settings.smoothing
    if kind == "none":
        return signals
    if kind == "aligned":
        return signals.select(*KEY, "s0").join(regularize.denoise_aligned(signals, gradients).select(*KEY, "dw"), KEY)
    places = graph.settle(signals.select(*KEY, F.posexplode("dw").alias("i", "x")))
    if kind in ("tv", "tgv"):
        name = {"tv": "tv_l2", "tgv": "tgv_l2"}[kind]
        done = denoise.filter_slices(places, "x", name, settings.strength, ["i", "slice"]).withColumnRenamed("filtered", "x")
    else:
        one = {"mean": lambda v: tiles.mean(v, "x", by=("i",)), "median": lambda v: tiles.median(v, "x", by=("i",)).withColumnRenamed("median", "mean"), "selective": lambda v: tiles.selective_mean(v, "x", "x", settings.strength, by=("i",)).drop("dropped")}[kind]
        done = one(places).withColumnRenamed("mean", "x")
    dw = done.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(*KEY, F.col("v.x").alias("dw"))
    return signals.select(*KEY, "s0").join(dw, KEY)


def reconstruct(signals: DataFrame, gradients: np.ndarray, basis: np.ndarray, settings: Settings, callback: regularize.Progress | None = None) -> DataFrame:
    """(voxel, alpha, compartments) of signals: smoothed, fitted with a basis, regularised and grouped, small compartments dropped.

    callback(round, voxels) is told of every round of a regularisation.
    """
    signals = graph.settle(smoothed(signals, gradients, settings))
    longitudinal, transversal = settings.longitudinal, settings.transversal
    if settings.estimate:
        longitudinal, transversal = profile(graph.settle(tensor_mask(signals, gradients, settings)), settings)
    b = settings.weighting
    found = fits.fit_orientations(signals, gradients, basis, b, longitudinal, transversal, settings.solver, settings.sparsity, settings.refit)
    if settings.regularization != "none":
        phi = models.basis(gradients, basis, b, longitudinal, transversal)
        model = models.TensorModel(b, np.asarray(gradients, float))
        rows = signals.join(found.select(*KEY, "alpha"), KEY)
        how = settings.regularization
        if how == "nnls":
            alpha = regularize.regularize(rows, phi, basis, 0.0, settings.regularization_weight, callback=callback)
        else:
            alpha = regularize.regularize_in_steps(with_tensor(rows, model), phi, basis, "tensor", settings.regularization_weight, mixed=how == "mixed", callback=callback)
        found = grouped(alpha, basis, longitudinal, transversal)
    return fields.drop_small(found.select(*KEY, "alpha", "compartments"), settings.least_peak)


def with_tensor(rows: DataFrame, model: models.TensorModel) -> DataFrame:
    """rows and tensor: xx, yy, zz, xy, xz, yz of each voxel's fit."""
    at = [model.powers.index(p) for p in ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1))]

    @F.pandas_udf("array<double>")
    def coefficients(s0: pd.Series, dw: pd.Series) -> pd.Series:
        return pd.Series([model.solve(s, np.asarray(y, float))[at] for s, y in zip(s0, dw, strict=True)])

    return rows.withColumn("tensor", coefficients("s0", "dw"))


def grouped(voxels: DataFrame, basis: np.ndarray, longitudinal: float, transversal: float) -> DataFrame:
    """(voxel, alpha, compartments): coefficients grouped in up to three compartments."""
    axes = np.asarray(basis, float)

    def run(batches):
        for pdf in batches:
            out = []
            for a in pdf["alpha"]:
                x = np.asarray(a, float)
                found = models.peaks(x, axes, k=min(16, len(axes) - 1)) if (x > 0).any() else []
                out.append([{"fraction": float(f), "dir": d.tolist(), "lambda": [transversal, transversal, longitudinal], "grp": k} for k, (d, f) in enumerate(found)])
            yield pd.concat([pdf[[*KEY, "alpha"]].reset_index(drop=True), pd.DataFrame({"compartments": out})], axis=1)

    return voxels.select(*KEY, "alpha").mapInPandas(run, "slice int, row int, col int, alpha array<double>, compartments array<struct<fraction:double,dir:array<double>,lambda:array<double>,grp:int>>")


def evaluate(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: means and deviations of the errors in counts and angles."""
    return fields.error_summary(truth, found)


def evaluate_list(truth: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """evaluate() of several fields, a row for each name."""
    out = None
    for name, f in found.items():
        one = evaluate(truth, f).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def cropped(truth: DataFrame, found: DataFrame) -> DataFrame:
    """found without the compartments of voxels that hold nothing in truth."""
    rows = found.join(truth.select(*KEY, (F.size("compartments") > 0).alias("__some")), KEY, "left")
    c = F.col("compartments")
    return rows.withColumn("compartments", F.when(F.col("__some"), c).otherwise(F.slice(c, 1, 0))).drop("__some")


def training_set(truth: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """(voxel, truth_count, found_count, fractions, angles): for learning the count from a fit, fractions largest first and angles of neighbours in that order."""
    from ..functions import vectors as V

    order = F.array_sort(found["compartments"], lambda a, b: F.when(a["fraction"] > b["fraction"], -1).when(a["fraction"] < b["fraction"], 1).otherwise(0))
    rows = truth.select(*KEY, F.size("compartments").alias("truth_count")).join(found.select(*KEY, F.slice(order, 1, most).alias("c"), F.size("compartments").alias("found_count")), KEY)
    angles = F.when(F.size("c") > 1, F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: V.axial_angle_degrees(F.element_at("c", i)["dir"], F.element_at("c", i + 1)["dir"]))).otherwise(F.array().cast("array<double>"))
    return rows.select(*KEY, "truth_count", "found_count", F.transform("c", lambda x: x["fraction"]).alias("fractions"), angles.alias("angles"))


def snr_sweep(truth: DataFrame, gradients: np.ndarray, basis: np.ndarray, settings: Settings, levels: tuple[int, ...] = (5, 10, 15, 20, 25, 30, 35, 40)) -> DataFrame:
    """evaluate() of a reconstruction at each signal-to-noise ratio, a row for each."""
    out = None
    for snr in levels:
        own = replace(settings, snr=float(snr))
        one = evaluate(truth, reconstruct(simulated(truth, gradients, own), gradients, basis, own)).withColumn("snr", F.lit(snr))
        out = one if out is None else out.unionByName(one)
    return out


def cumulative_averages(truth: DataFrame, gradients: np.ndarray, settings: Settings, levels: tuple[int, ...] = (40, 35, 30, 25, 20, 15, 10, 5)) -> DataFrame:
    """(snr, voxel, s0, dw): at each level the mean of the acquisitions of it and of all levels before."""
    from ..functions import vectors as V

    total, out = None, None
    for k, snr in enumerate(levels, 1):
        one = generate.simulate(truth, gradients, settings.weighting, float(snr), settings.seed + k).select(*KEY, "s0", F.col("dw").alias("y"))
        total = one if total is None else total.join(one.select(*KEY, F.col("y").alias("z")), KEY).select(*KEY, "s0", V.add(F.col("y"), F.col("z")).alias("y"))
        total = graph.settle(total)
        mean = total.select(F.lit(snr).alias("snr"), *KEY, "s0", V.scale(F.col("y"), 1.0 / k).alias("dw"))
        out = mean if out is None else out.unionByName(mean)
    return out


def signal_rmse(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One number: the root of the mean squared difference of two tables of signals."""
    from ..functions import vectors as V

    rows = truth.select(*KEY, F.col("dw").alias("a")).join(found.select(*KEY, F.col("dw").alias("b")), KEY)
    return rows.agg(F.sqrt(F.sum(V.sqr_distance(F.col("a"), F.col("b"))) / F.sum(F.size("a"))).alias("rmse"))


def denoising_grid(truth: DataFrame, gradients: np.ndarray, settings: Settings, strengths: np.ndarray, kinds: tuple[str, ...] = ("tv", "tgv")) -> DataFrame:
    """(kind, strength, rmse) of denoising simulated signals in each way with each strength, and of doing nothing."""
    clean = graph.settle(generate.simulate(truth, gradients, settings.weighting))
    noisy = graph.settle(simulated(truth, gradients, settings))
    out = signal_rmse(clean, noisy).select(F.lit("none").alias("kind"), F.lit(0.0).alias("strength"), "rmse")
    for kind in kinds:
        for s in strengths:
            done = smoothed(noisy, gradients, replace(settings, smoothing=kind, strength=float(s)))
            out = out.unionByName(signal_rmse(clean, done).select(F.lit(kind).alias("kind"), F.lit(float(s)).alias("strength"), "rmse"))
    return out


def parameter_study(spark: SparkSession, side: int = 30, most_angle: float = 90.0) -> DataFrame:
    """A field of side x side voxels: along rows the second compartment's fraction grows, along columns the angle between both."""
    share, angle = (F.col("row") + 0.5) / (2 * side), F.radians((F.col("col") + 1) * F.lit(most_angle / side))
    profile_ = F.array(F.lit(3e-4), F.lit(3e-4), F.lit(1.7e-3))
    one = lambda f, d, k: F.struct(f.alias("fraction"), d.alias("dir"), profile_.alias("lambda"), F.lit(k).alias("grp"))
    zero = F.lit(0.0)
    return generate.grid(spark, 1, side, side).select(*KEY, F.array(one(1 - share, F.array(F.lit(1.0), zero, zero), 0), one(share, F.array(F.cos(angle), F.sin(angle), zero), 1)).alias("compartments"))


def coherence_images(field: DataFrame, folder: str, void: float = 60.0) -> DataFrame:
    """Write the local coherence of a field as an image, empty voxels as 0; returns (name, bytes)."""
    lci = fields.coherence(field, void)
    rows = lci.select(F.lit("lci").alias("volume"), *KEY, F.when(F.isnan("lci"), 0.0).otherwise(F.col("lci")).alias("v"))
    return images.write_volumes(rows, "v", folder, "mif")


def observed(df: DataFrame, name: str):
    """(df, observation): the observation holds how many rows the next action of df made; the rows don't wait for it."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def run(spark: SparkSession, settings: Settings, mode: str = "reconstruct", tell: Callable[[str], None] = print) -> DataFrame:
    """One mode: reconstruct (and evaluate where there is a truth), evaluate (a field of images as `output` against the truth), denoise or sweep."""
    clock, parts = Clock().tic(), load(spark, settings)
    if mode == "sweep":
        out = snr_sweep(parts["truth"], parts["gradients"], parts["basis"], settings)
    elif mode == "denoise":
        out = denoising_grid(parts["truth"], parts["gradients"], settings, np.linspace(0.001, 0.1, 4))
    elif mode == "evaluate":
        found = field_images.read_field_set(spark, *[f"{settings.output}/field_{p}.nii" for p in ("counts", "fractions", "axes")])
        out = evaluate(parts["truth"], cropped(parts["truth"], found))
    elif mode == "reconstruct":
        if parts["signals"] is None:
            raise ValueError("neither signals nor a truth to make them from")
        found = graph.settle(reconstruct(parts["signals"], parts["gradients"], parts["basis"], settings))
        if settings.output:
            field_images.write_field_set(found, settings.output)
            coherence_images(found, settings.output)
        out = found if parts["truth"] is None else evaluate(parts["truth"], found)
    else:
        raise ValueError(f"no mode {mode}")
    tell(f"{mode}: planned in {clock.toc():.1f} s")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Reconstruct, evaluate or sweep a field of orientations.")
    p.add_argument("mode", choices=["reconstruct", "evaluate", "denoise", "sweep"])
    p.add_argument("--settings", help="a file of lines `name value`")
    for f in dataclass_fields(Settings):
        p.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, default=None)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    text = "\n".join(r[0] for r in spark.read.text(args.settings).collect()) if args.settings else ""
    text += "".join(f"\n{f.name} {getattr(args, f.name)}" for f in dataclass_fields(Settings) if getattr(args, f.name) is not None)
    run(spark, parse(text), args.mode).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

