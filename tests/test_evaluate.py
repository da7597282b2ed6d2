"""Reports and segmentation helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.functions import models
from latticeflow.operators import clustering, evaluate, generate, graph, segment, stats


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), (r.standard_normal(6) * 0.3 + 3 * np.eye(6)[i % 4]).tolist(), int(i % 4)) for i in range(120)]
    return spark.createDataFrame(rows, "id long, v array<double>, label long").cache()


def test_class_reports(samples):
    scores = evaluate.class_scores(samples, "v", "label", "id", stats.centroid_vectors(samples, "v", "label"))
    assert scores.count() == 480
    rows = evaluate.class_thresholds(scores, (0.1,)).collect()
    assert len(rows) == 4 and all(r["rate"] == 1 for r in rows)
    one = scores.where("class = 1 and same = 0").orderBy("dist").collect()
    assert [r["threshold"] for r in rows if r["class"] == 1][0] == pytest.approx(one[int(0.1 * len(one))]["dist"])
    curve = stats.roc_curve(scores).withColumn("curve", F.lit("a"))
    assert "a" in evaluate.side_by_side(curve, "curve", ["a"]).columns
    c = samples.groupBy("label").agg(F.count("*").alias("n")).withColumn("predicted", F.lit(0))
    assert evaluate.row_percent(c, "label", "predicted").select(F.min("percent")).first()[0] == 100


def test_generalization(samples):
    g = evaluate.label_generalization(samples, "id", "v", "label", 2, far=0.05)
    rows = g.collect()
    assert [r["k"] for r in rows] == list(range(1, len(rows) + 1)) and all(0 <= r["inside"] <= r["outside"] <= 1 for r in rows)
    assert evaluate.best_directions(g).first()["outside"] == min(r["outside"] for r in rows)


def test_discriminants_tell_classes_apart(samples):
    w = clustering.discriminants(samples, "v", "label", 3)
    near = stats.nearest_centroid(clustering.projected(samples, "v", w), stats.centroid_vectors(clustering.projected(samples, "v", w), "projected", "label"), "projected", "label", ["id", "label"])
    assert near.where("label = predicted").count() == 120
    extra = clustering.discriminants(samples, "v", "label", 3, exclude=samples, weight=0.5)
    assert extra.shape == w.shape and np.isfinite(extra).all()


def test_clusters(samples):
    labels, means = clustering.fuzzy_kmeans(samples, "id", "v", 4, 1.0)
    assert labels.join(samples.withColumnRenamed("label", "truth"), "id").groupBy("truth").agg(F.count_distinct("label").alias("n")).agg(F.max("n")).first()[0] == 1
    probs = clustering.fuzzy_kmeans(samples, "id", "v", 4, 2.0, rounds=5)[0]
    assert probs.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_counts(spark):
    d = spark.createDataFrame([(1, 9), (7, 2), (7, 9), (2, 1)], "a int, b int")
    assert {(r["a"], r["b"]): r["n"] for r in evaluate.capped_confusion(d, "a", "b").collect()} == {(1, 4): 1, (4, 2): 1, (4, 4): 1, (2, 1): 1}
    assert evaluate.monotone_breaks(d, "a", "b").first()[0] == 1


def test_splits():
    label = evaluate.capacity_split(np.array([0.5, 0.4, 0.3, 0.0, 0.2]), np.ones((5, 5)), 2)
    assert label[3] == -1 and set(label.tolist()) == {-1, 0, 1}
    t = [models.tensor(np.array([0, 0, 1.0]), a, b) for a, b in ((1.7e-3, 3e-4), (1e-3, 2e-4))]
    assert evaluate.contained(t, 1000.0, generate.sphere(30)) == 1


def test_segmentation(spark):
    e = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, w double")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    v = spark.range(7)
    assert segment.spread_seeds(v, both, 3) == [0, 6, 3]
    p = {r["id"]: r["probs"] for r in segment.seed_memberships(v, both, [0, 6]).collect()}
    assert p[1][0] > p[1][1] and p[5][1] > p[5][0]
    probs = spark.createDataFrame([(k, x) for k, x in p.items()], "id long, probs array<double>")
    after = clustering.kernel_memberships(both, probs, 1.0, 0.0, rounds=3)
    assert segment.kernel_energy(both, after).first()[0] < segment.kernel_energy(both, probs).first()[0]
    axes = spark.createDataFrame([(k, int(k > 3), [1.0, 0.0, 0.0] if k % 2 else [-1.0, 0.1, 0.0]) for k in range(7)], "id long, label int, dir array<double>")
    assert segment.smooth_axes(axes, both).count() == 7
    grid = generate.grid(spark, 1, 3, 3).withColumn("id", F.col("row") * 3 + F.col("col")).withColumn("v", F.lit(1.0))
    kernel = segment.gaussian_kernel(grid, "v", 1.0)
    assert kernel.where("w != 1").count() == 0 and graph.row_sums(kernel).agg(F.max("total")).first()[0] == 9  # eight neighbours and the diagonal


def test_runs_from_files(spark, samples, tmp_path):
    from latticeflow.sources import files

    files.save_matrix(samples.select("id", F.concat("v", F.array(F.col("label").cast("double"))).alias("x")), "id", "x", str(tmp_path / "m"))
    found = evaluate.discriminants_from_file(spark, str(tmp_path / "m"), 3, str(tmp_path / "svm"))
    assert found.count() == 120 and found.where("label = predicted").count() == 120
    lines = spark.read.text(str(tmp_path / "svm"))
    assert lines.count() == 120 and all(r[0].split(" ")[1].startswith("1:") for r in lines.collect())
    assert evaluate.validation_from_file(spark, str(tmp_path / "m"), 2).count() >= 1


def test_empty_tables(spark, samples):
    none = samples.limit(0)
    assert clustering.fuzzy_kmeans(none, "id", "v", 3)[0].count() == 0
    assert clustering.euclidean_scaling(none, "id", "v", 2).count() == 0
    nulls = samples.limit(3).withColumn("v", F.lit(None).cast("array<double>")).unionByName(samples)
    assert clustering.fuzzy_kmeans(nulls, "id", "v", 3, 1.0, rounds=2)[0].count() == 120
    assert stats.nth_smallest(none, "id", 0) is None and stats.nth_smallest(samples, "id", 5) == 5
