"""Multi-tensor fields as sets of images: counts, fractions and axes, or one image of peaks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph
from ..operators.neighbours import KEY
from . import files, images, texts

# The diffusivities of a field that is read from images, which hold none.
PROFILE = (0.001393979, 0.001393979, 0.001974300)
LEAST_PEAKS = 3


def _pad(values, n: int):
    return F.concat(values, F.array_repeat(F.lit(0.0), n - F.size(values)))


def write_field_set(field: DataFrame, folder: str, name: str = "field") -> DataFrame:
    """Three images of a field in a folder: <name>_counts, <name>_fractions and <name>_axes; returns (name, bytes).

    Counts are 3D, fractions 4D and axes 5D (place of the compartment, then x, y, z), with room for the most
    compartments of any voxel and for three at least.
    """
    most = max(LEAST_PEAKS, field.agg(F.max(F.size("compartments"))).first()[0] or 0)
    c = F.col("compartments")
    at = lambda k: _pad(F.transform(c, lambda x: F.element_at(x["dir"], k)), most)
    parts = [
        (f"{name}_counts", F.array(F.size(c).cast("double")), None),
        (f"{name}_fractions", _pad(F.transform(c, lambda x: x["fraction"]), most), (most,)),
        (f"{name}_axes", F.concat(at(1), at(2), at(3)), (most, 3)),
    ]
    out = None
    for volume, values, shape in parts:
        one = images.write_volumes(field.select(F.lit(volume).alias("volume"), *KEY, values.alias("v")), "v", folder, shape=shape, centred=True)
        out = one if out is None else out.unionByName(one)
    return out


def _compartments(n, fraction, axis):
    """n compartments from functions of their place."""
    profile = F.array(*[F.lit(x) for x in PROFILE])
    one = lambda k: F.struct(fraction(k).alias("fraction"), axis(k).alias("dir"), profile.alias("lambda"), k.cast("int").alias("grp"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<fraction:double,dir:array<double>,lambda:array<double>,grp:int>>"))


def read_field_set(spark: SparkSession, counts: str, fractions: str, axes: str) -> DataFrame:
    """(voxel, compartments) of the three images of a field."""
    n = images.read_nifti(spark, counts).select(*KEY, F.element_at("values", 1).cast("int").alias("n"))
    f = images.read_nifti(spark, fractions).select(*KEY, F.col("values").alias("f"))
    d = images.read_nifti(spark, axes).select(*KEY, F.col("values").alias("d"))
    most = F.floor(F.size("d") / 3).cast("int")
    axis = lambda k: F.array(*[F.element_at("d", (k + most * u + 1).cast("int")) for u in range(3)])
    made = _compartments(F.col("n"), lambda k: F.element_at("f", (k + 1).cast("int")), axis)
    return n.join(f, KEY).join(d, KEY).select(*KEY, made.alias("compartments"))


def write_peaks(field: DataFrame, folder: str, name: str = "peaks", most: int | None = None) -> DataFrame:
    """One image of x, y, z of each compartment in turn, as long as its fraction; compartments past `most` have no room."""
    most = most or max(1, field.agg(F.max(F.size("compartments"))).first()[0] or 0)
    peaks = F.flatten(F.transform(F.slice("compartments", 1, most), lambda x: V.scale(V.normalize(x["dir"]), x["fraction"])))
    return images.write_volumes(field.select(F.lit(name).alias("volume"), *KEY, _pad(peaks, 3 * most).alias("v")), "v", folder, shape=(3 * most,), centred=True)


def read_peaks(spark: SparkSession, path: str, legacy: bool = False, least: float = 1e-9) -> DataFrame:
    """(voxel, compartments) of a peaks image: peaks that are not finite or about 0 long are left out, the rest are as large as they are long.

    legacy: the length counts y twice and leaves z out.
    """
    rows = images.read_nifti(spark, path)
    peaks = F.transform(F.sequence(F.lit(0), (F.size("values") / 3 - 1).cast("int")), lambda k: F.slice("values", (3 * k + 1).cast("int"), 3))
    at = lambda p, i: F.element_at(p, i)
    size = lambda p: F.sqrt(at(p, 1) ** 2 + at(p, 2) ** 2 + at(p, 2 if legacy else 3) ** 2)
    fine = F.filter(peaks, lambda p: F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & (size(p) >= least))
    rows = rows.select(*KEY, fine.alias("p"))
    made = _compartments(F.size("p"), lambda k: size(F.element_at("p", (k + 1).cast("int"))), lambda k: V.normalize(F.element_at("p", (k + 1).cast("int"))))
    return rows.select(*KEY, made.alias("compartments"))


def write_field(field: DataFrame, folder: str, binary: bool = False) -> DataFrame:
    """Write (name, voxel, compartments, atoms) as field files of their names; returns (name, bytes) of each.

    Records are made in all tasks, put in order by Spark, and one task for each file passes them on a batch at a
    time.  Voxels without a row are empty.
    """
    record = texts.voxel_bytes if binary else lambda c, a: texts.voxel_text(c, a).encode()
    empty = record([], [])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["name", *KEY]].assign(content=[record(c, a) for c, a in zip(pdf["compartments"], pdf["atoms"], strict=True)])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in zip(pdf["name"], *[pdf[k].tolist() for k in KEY], pdf["content"], strict=True))
        for name, own in groupby(rows, key=lambda r: r[0]):
            _, _, nr, nc, ns = next(own)  # sorted first
            ns, at = int(ns), 0
            with files.whole_file(folder, name) as f:
                size = f.write(struct.pack("<3i", ns, nr, nc) if binary else f"3\n{ns} {nr} {nc}\n".encode())
                for _, s, r, c, content in chain(own, [(name, ns, 0 if binary else nr - 1, 0, b"")]):
                    to = (s * nr + (r if binary else nr - 1 - r)) * nc + c
                    while at < to:
                        n = min(to - at, 4096)
                        size += f.write(empty * n)
                        at += n
                    if at == to and s < ns:
                        size += f.write(content)
                        at += 1
            yield pd.DataFrame({"name": [name], "bytes": [size]})

    spec = "name string, slice int, row int, col int, content binary"
    rows = graph.spread(field.select("name", *KEY, "compartments", "atoms"), *KEY).mapInPandas(records, spec)
    size = lambda k: (F.max(k) + 1).alias(k)
    heads = field.groupBy("name").agg(*[size(k) for k in KEY]).select("name", F.lit(-1).alias("slice"), "row", "col", F.encode(F.col("slice").cast("string"), "UTF-8").alias("content"))
    order = F.col("row") if binary else -F.col("row")
    return graph.settle(heads.unionByName(rows).repartition("name").sortWithinPartitions("name", "slice", order, "col").mapInPandas(write, "name string, bytes bigint"))


def write_slice_text(field: DataFrame, s: int, folder: str, name: str) -> DataFrame:
    """One slice of a field as a text field of its own."""
    rows = field.where(F.col("slice") == s).select(F.lit(f"{name}.txt").alias("name"), F.lit(0).alias("slice"), "row", "col", "compartments", "atoms")
    return write_field(rows, folder)


def odf_of_alpha(voxels: DataFrame, directions, basis, profile=(3e-4, 3e-4, 1.7e-3), share: float = 0.2) -> DataFrame:
    """(voxel, odf): the orientation distribution on directions of the coefficients over share * the largest, scaled to sum 1.

    A voxel without coefficients has zeros.  Basis tensors are turned from z to each basis direction.
    """
    import numpy as np
    import pandas as pd

    from ..functions import linalg

    d, z = np.asarray(directions, float), np.array([0, 0, 1.0])
    turns = [linalg.from_to_rotation(z, np.asarray(x, float)) for x in basis]
    forms = np.stack([np.einsum("ni,ij,nj->n", d, r @ np.diag(1 / np.array(profile)) @ r.T, d) for r in turns], axis=1)
    kernel = forms**-1.5 / (4 * np.pi * np.sqrt(np.prod(profile)))

    def run(batches):
        for pdf in batches:
            out = []
            for a in pdf["alpha"]:
                if a is None:
                    out.append(np.zeros(len(d)))
                    continue
                x = np.asarray(a, float)
                y = kernel @ np.where(x > share * x.max(), x, 0)
                out.append(y / y.sum() if y.sum() else y)
            yield pd.concat([pdf[KEY].reset_index(drop=True), pd.DataFrame({"odf": out})], axis=1)

    return voxels.select(*KEY, "alpha").mapInPandas(run, "slice int, row int, col int, odf array<double>")
