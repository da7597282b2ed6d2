"""Registered queries that SQL cannot express: fits, matching, clustering.  Tested against direct formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assignment, linalg, models
from ..functions import vectors as V
from ..operators import clustering, denoise, fields, fits, folds, generate

QUERIES: dict = {}
B = 1500.0
LONGITUDINAL, TRANSVERSAL = 1.7e-3, 3e-4


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axes(e: DataFrame, first: int, n: int):
    """n unit 3-vectors from the elements of an embedding."""
    v = V.doubles("embedding")
    return F.array(*[V.normalize(F.slice(v, first + 3 * k, 3)) for k in range(n)])


def truth(spark, sf) -> DataFrame:
    """A field with a voxel for each embedding: two compartments along its first six elements."""
    c = lambda k, f: F.struct(F.lit(f).alias("fraction"), F.element_at("ax", k).alias("dir"), F.array(F.lit(TRANSVERSAL), F.lit(TRANSVERSAL), F.lit(LONGITUDINAL)).alias("lambda"), F.lit(k - 1).alias("grp"))
    e = read(spark, sf, "embeddings").withColumn("ax", axes(None, 1, 2))
    return e.select(F.lit(0).alias("slice"), F.floor(F.col("vec_id") / 100).cast("int").alias("row"), F.pmod("vec_id", F.lit(100)).cast("int").alias("col"), F.array(c(1, 0.6), c(2, 0.4)).alias("compartments"))


def signals(spark, sf, snr: float = 0.0) -> DataFrame:
    return generate.simulate(truth(spark, sf), generate.sphere(32), B, snr)


@query
def tensor_fit(spark, sf):
    return fits.fit_tensor(signals(spark, sf), generate.sphere(32), B)


@query
def nnls_fit(spark, sf):
    return fits.fit_orientations(signals(spark, sf), generate.sphere(32), generate.sphere(64), B, LONGITUDINAL, TRANSVERSAL)


@query
def sparse_fit(spark, sf):
    return fits.fit_orientations(signals(spark, sf, 20.0), generate.sphere(32), generate.sphere(64), B, LONGITUDINAL, TRANSVERSAL, solver="nnsls", sparsity=0.01, refit=True)


@query
def deconvolution(spark, sf):
    g = generate.sphere(64)
    z = models.tensor(np.array([0, 0, 1.0]), LONGITUDINAL, TRANSVERSAL)
    r, _ = models.response([(1.0, models.signal([1.0], [z], g, B), np.array([0, 0, 1.0]))], g, 6)
    return fits.fit_deconvolution(generate.simulate(truth(spark, sf), g, B), g, r, generate.sphere(128), 6)


@query
def field_errors(spark, sf):
    return fields.error_summary(truth(spark, sf), nnls_fit(spark, sf).select("slice", "row", "col", "compartments"))


@query
def local_coherence(spark, sf):
    return fields.coherence(truth(spark, sf), 45.0)


@query
def hungarian(spark, sf):
    """(vec_id, cost, assignment) of a 6 x 6 cost matrix in each embedding's first 36 elements."""
    def run(batches):
        for pdf in batches:
            found = [assignment.assign(np.asarray(v, float)[:36].reshape(6, 6)) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cost": [c for _, c in found], "assignment": [a.tolist() for a, _ in found]})

    return read(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, cost double, assignment array<int>")


@query
def emd(spark, sf):
    """(vec_id, emd) between the positive parts of each embedding's first and second 16 elements, on a line."""
    def run(batches):
        ground = np.abs(np.subtract.outer(np.arange(16.0), np.arange(16.0)))
        for pdf in batches:
            v = [np.maximum(np.asarray(x, float), 0) for x in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "emd": [assignment.emd(x[:16], x[16:32], ground) for x in v]})

    return read(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, emd double")


@query
def horn_alignment(spark, sf):
    """(vec_id, error): ten points of each embedding, turned and moved, aligned back."""
    def run(batches):
        turn = linalg.rotation_from_angles(0.5, 0.8)
        for pdf in batches:
            p = [np.asarray(x, float)[:30].reshape(10, 3) for x in pdf["embedding"]]
            out = []
            for x in p:
                t, _ = assignment.horn_align(x @ turn.T + 1.0, x)
                out.append(float(np.abs((x @ turn.T + 1.0) @ t[:3, :3].T + t[:3, 3] - x).max()))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "error": np.round(out, 9)})

    return read(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, error double")


@query
def fuzzy_kmeans(spark, sf):
    return clustering.fuzzy_kmeans(read(spark, sf, "embeddings"), "vec_id", "embedding", 5, 1.5, rounds=10)[0]


@query
def axial_kmeans(spark, sf):
    return clustering.fuzzy_kmeans(read(spark, sf, "embeddings"), "vec_id", "embedding", 4, 1.0, rounds=10, axial=True)[0]


@query
def lda_projection(spark, sf):
    e = read(spark, sf, "embeddings")
    return clustering.projected(e, "embedding", clustering.discriminants(e, "embedding", "label", 4)).select("vec_id", "label", "projected")


@query
def lda_cross_validation(spark, sf):
    return clustering.cross_validation_summary(clustering.cross_validate(read(spark, sf, "embeddings"), "vec_id", "embedding", "label", 4, folds=3))


@query
def discriminant_validation(spark, sf):
    """Mean and sd over folds of the shares of each label's unseen vectors that discriminants give each class."""
    counts = folds.discriminant_counts(read(spark, sf, "embeddings"), "embedding", "label", 4, F.pmod("vec_id", F.lit(5)), 5)
    return folds.share_confusion(counts, 5)


@query
def mds(spark, sf):
    return clustering.euclidean_scaling(read(spark, sf, "embeddings"), "vec_id", "embedding", 3)


@query
def spectral_clusters(spark, sf):
    from .queries import knn_graph

    g = knn_graph(spark, sf)
    return clustering.spectral_clusters(g, g.select(F.col("src").alias("id")).distinct(), 3)


def lattice(spark, sf) -> DataFrame:
    from .queries import lattice

    return lattice(spark, sf)


@query
def total_variation(spark, sf):
    return denoise.filter_slices(lattice(spark, sf), "v", "tv_l2", 0.05)


@query
def generalized_variation(spark, sf):
    return denoise.filter_slices(lattice(spark, sf), "v", "tgv_l2", 0.05)


@query
def robust_denoising(spark, sf):
    return denoise.filter_slices(lattice(spark, sf), "v", "robust", 1.0)


@query
def synthetic_field(spark, sf):
    return generate.simulate(generate.random_field(spark, 2, 8, 8, seed=7), generate.sphere(24), B, 25.0, seed=7)
