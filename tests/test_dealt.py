"""Work on few bytes is dealt over all tasks."""

import numpy as np

from latticeflow.operators import segment


def test_one_file_is_dealt_over_all_tasks(spark):
    x = np.random.default_rng(4).uniform(900, 1000, (500, 2))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").coalesce(1)
    got = segment.dense_kernel(points, "v", 40.0, points.where("id % 50 = 0"), places=4)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = got.toPandas().pivot(index="src", columns="dst", values="w")
    w = np.exp(-((x[::50, None] - x) ** 2).sum(2) / 1600)
    assert rows.shape == (10, 500) and np.allclose(rows.to_numpy(), np.round(w, 4), atol=1e-12)
    assert got.select("w").distinct().count() == len(np.unique(np.round(w, 4)))


def test_slices_are_dealt_over_all_tasks(spark):
    from latticeflow.operators import denoise

    voxels = spark.createDataFrame([(i, s, r, c, float(r == c)) for i in range(4) for s in range(20) for r in range(3) for c in range(4)], "i int, slice int, row int, col int, x double")
    got = denoise.filter_slices(voxels, "x", "tv_l2", 5.0, ["i", "slice"])
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = denoise.total_variation(np.eye(3, 4), 5.0)
    rows = got.collect()
    assert len(rows) == 960 and max(abs(r["filtered"] - want[r["row"], r["col"]]) for r in rows) < 1e-12


def test_simulation_is_dealt_over_all_tasks(spark):
    from latticeflow.operators import generate

    truth = generate.random_field(spark, 1, 4, 4).coalesce(1)
    got = generate.simulate(truth, generate.sphere(6), 1500.0)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 16


def test_the_dense_kernel_takes_little_room(spark, tmp_path):
    """Rows lie so that a columnar file holds them in well under a byte each; queries alike, more than a run of them, lose none."""
    x = np.append(np.random.default_rng(5).integers(900, 1000, 2700), [950] * 300) / 1.0
    points = spark.createDataFrame([(7 * i, [v]) for i, v in enumerate(x.tolist())], "id bigint, v array<double>")
    segment.dense_kernel(points, "v", 40.0, points.where("id % 2 = 0 or id >= 18900"), places=6).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = got.toPandas()
    picked = np.array([i for i in range(3000) if 7 * i % 2 == 0 or 7 * i >= 18900])
    assert len(rows) == 3000 * len(picked) and not rows.duplicated(["src", "dst"]).any() and set(rows["src"]) == set((7 * picked).tolist())
    want = np.floor(np.exp(-((x[rows["src"] // 7] - x[rows["dst"] // 7]) ** 2) / 1600) * 1e6 + 0.5) / 1e6
    assert np.allclose(rows["w"], want, atol=1.1e-6)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * len(rows)
