"""All folds from sums, against refitting each fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeflow.operators import clustering, folds, stats
from latticeflow.plans import queries as plans


def refitted(spark, pdf, directions, n):
    """{(fold, held, label, predicted): rows}, a fit for each fold."""
    out = {}
    for f in range(n):
        train = spark.createDataFrame(pdf[pdf["fold"] != f])
        w = clustering.discriminants(train, "v", "label", directions)
        centres = stats.centroid_vectors(clustering.projected(train, "v", w), "projected", "label")
        found = stats.nearest_centroid(clustering.projected(spark.createDataFrame(pdf), "v", w), centres, "projected", "label", ["fold", "label"])
        for r in found.groupBy("fold", "label", "predicted").count().collect():
            key = f, r["fold"] == f, r["label"], r["predicted"]
            out[key] = out.get(key, 0) + r["count"]
    return out


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(8)
    label = rng.integers(0, 4, 240)
    x = rng.normal(size=(240, 6)) + 1.5 * rng.normal(size=(4, 6))[label]
    pdf = pd.DataFrame({"id": range(240), "v": x.tolist(), "label": label})
    pdf["fold"] = pdf["id"] % 3
    pdf.loc[(pdf["label"] == 3) & (pdf["fold"] == 1), "label"] = 2  # a fold without one of the labels
    return pdf


def test_counts_equal_refitting(spark, sample):
    counts = folds.discriminant_counts(spark.createDataFrame(sample).repartition(5), "v", "label", 2, F.col("fold"), 3)
    got = {(r["fold"], r["held"], r["label"], r["predicted"]): r["n"] for r in counts.collect()}
    assert got == refitted(spark, sample, 2, 3)
    errors = {r["fold"]: r for r in folds.fold_errors(counts).collect()}
    for f in range(3):
        for held, name in ((False, "in_error"), (True, "out_error")):
            own = {k: n for k, n in got.items() if k[:2] == (f, held)}
            assert np.isclose(errors[f][name], sum(n for k, n in own.items() if k[2] != k[3]) / sum(own.values()))
    cm = np.zeros((3, 4, 4))
    for (f, held, a, b), n in got.items():
        cm[f, a, b] += n * held
    for f in range(3):
        for a in range(4):
            cm[f, a] = cm[f, a] / cm[f, a].sum() if cm[f, a].sum() else np.eye(4)[a]
    table = {(r["label"], r["predicted"]): (r["mean"], r["sd"]) for r in folds.share_confusion(counts, 3).collect()}
    for a in range(4):
        for b in range(4):
            assert np.allclose(table.get((a, b), (0, 0)), (cm[:, a, b].mean(), cm[:, a, b].std(ddof=1)), atol=1e-7)


def test_cross_validation_of_the_query(spark, sf):
    df = plans.embeddings(spark, sf).select("vec_id", F.col("embedding").alias("v"), "label").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int"))
    want = refitted(spark, df.toPandas().assign(v=lambda p: [list(map(float, x)) for x in p["v"]]), 4, 3)
    share = [sum(n for k, n in want.items() if k[:2] == (f, True) and k[2] != k[3]) / sum(n for k, n in want.items() if k[:2] == (f, True)) for f in range(3)]
    got = plans.queries()["lda_cross_validation"](spark, sf).first()
    assert np.isclose(got["mean"], np.mean(share)) and np.isclose(got["sd"], np.std(share, ddof=1))
    rows = plans.queries()["discriminant_validation"](spark, sf).groupBy("label").agg(F.sum("mean").alias("one")).collect()
    assert rows and all(np.isclose(r["one"], 1) for r in rows)
