"""Scaling of a table against scaling of its whole distance matrix."""

import numpy as np

from latticeflow.operators import clustering
from latticeflow.plans import queries as plans


def test_scaling_takes_all_rows(spark):
    v = np.random.default_rng(8).standard_normal((700, 6)) * [1.5, 1.3, 1.2, 1.1, 1.0, 1.0] + 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    got = np.array([r["x"] for r in clustering.euclidean_scaling(df, "id", "v", 3).orderBy("id").collect()])
    whole = clustering.multidimensional_scaling(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 3)
    assert np.allclose(np.abs(got.T @ whole), np.diag(np.diag(whole.T @ whole)), atol=1e-6 * (whole**2).sum())


def test_query_takes_all_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in rows], dtype=float)
    u, s, _ = np.linalg.svd(v - v.mean(0), full_matrices=False)
    got = np.array([r["x"] for r in plans.queries()["mds"](spark, sf).orderBy("vec_id").collect()])
    assert len(v) > 512
    assert np.allclose(np.abs(got.T @ u[:, :3]), np.diag(s[:3]), atol=1e-6 * s[0])
