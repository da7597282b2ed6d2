"""Moments of all places of a vector column against numpy."""

import numpy as np

from latticeflow.operators import stats
from latticeflow.plans import queries as plans


def matrix(df):
    rows = df.collect()
    d = 1 + max(r["i"] for r in rows)
    assert len(rows) == d * d
    m = np.full((d, d), np.nan)
    for r in rows:
        m[r["i"], r["j"]] = np.nan if r["s"] is None else r["s"]
    return m


def test_moments_have_all_places(spark):
    x = np.random.default_rng(4).standard_normal((60, 12)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(4)
    assert np.allclose(matrix(stats.raw_second_moment(df, "v")), x.T @ x / 59, rtol=1e-12)
    assert np.allclose(matrix(stats.centred_covariance(df, "v")), np.cov(x.T), atol=1e-8)


def test_moments_of_one_row_and_none(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    for f in (stats.raw_second_moment, stats.centred_covariance):
        assert np.isnan(matrix(f(df, "v"))).all()
        assert f(df.limit(0), "v").count() == 0


def test_queries_have_all_places(spark, sf):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], dtype=float)
    assert np.allclose(matrix(plans.queries()["raw_second_moment_whole"](spark, sf)), x.T @ x / (len(x) - 1), atol=1e-6)
    assert np.allclose(matrix(plans.queries()["centred_covariance_whole"](spark, sf)), np.cov(x.T), atol=1e-6)
