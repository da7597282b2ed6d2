"""Images written by many tasks: the same bytes as an image written whole, and nothing where a write fails."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.sources import images, sinks, volumes


@pytest.fixture(scope="module")
def data(spark):
    volumes.register(spark)
    return np.random.default_rng(3).random((7, 5, 9, 4)).astype("f4")  # x, y, z, t


def table(spark, data, keep=lambda s, r, c: True):
    nx, ny, nz, _ = data.shape
    rows = [(s, r, c, data[c, ny - 1 - r, s].tolist()) for s in range(nz) for r in range(ny) for c in range(nx) if keep(s, r, c)]
    return spark.createDataFrame(rows, "slice int, row int, col int, values array<double>").repartition(6)


def test_bytes_of_the_whole_image(spark, data, tmp_path):
    path = str(tmp_path / "deep" / "a.nii")
    sinks.save_volume(table(spark, data), "values", path)
    assert open(path, "rb").read() == images.encode_nifti(data) and os.listdir(tmp_path / "deep") == ["a.nii"]
    sinks.save_volume(table(spark, data), "values", f"file://{path}", bricks="3,0..1", kind="f8", centred="true")  # in place of the other
    head, got = images.decode_nifti(open(path, "rb").read())
    assert np.array_equal(got, data[..., [3, 0, 1]].astype("f8")) and tuple(head["dim"]) == (7, 5, 9, 3)


def test_rows_in_any_order_and_holes(spark, data, tmp_path):
    """Without sorting, slices are opened again and again; what has no voxel is 0."""
    path = str(tmp_path / "a.nii")
    some = table(spark, data, lambda s, r, c: (s + r * c) % 3 > 0).where("slice != 4")
    some.write.format("volume").option("path", path).option("shape", "9,5,7").option("length", 4).mode("append").save()
    _, got = images.decode_nifti(open(path, "rb").read())
    s, y, c = np.meshgrid(range(9), range(5), range(7), indexing="ij")
    there = ((s + (4 - y) * c) % 3 > 0) & (s != 4)
    want = np.where(there.transpose(2, 1, 0)[..., None], data, 0)
    assert np.array_equal(got, want)
    with pytest.raises(Exception, match="a.nii"):
        some.write.format("volume").option("path", path).option("shape", "9,5,7").option("length", 4).mode("append").save()
    assert os.listdir(tmp_path) == ["a.nii"] and np.array_equal(images.decode_nifti(open(path, "rb").read())[1], want)


def test_a_failed_task_leaves_nothing(spark, data, tmp_path):
    broken = table(spark, data).withColumn("row", F.when(F.col("slice") == 8, 99).otherwise(F.col("row")))
    with pytest.raises(Exception, match="outside"):
        broken.write.format("volume").option("path", str(tmp_path / "a.nii")).option("shape", "9,5,7").option("length", 4).mode("overwrite").save()
    assert os.listdir(tmp_path) == []


def test_scalars_read_back(spark, data, tmp_path):
    voxels = table(spark, data).select("slice", "row", "col", F.when(F.col("col") != 2, F.col("values")[1]).alias("v"))
    sinks.save_volume(voxels, "v", str(tmp_path / "a.nii"))
    back = spark.read.format("volume").option("path", str(tmp_path / "a.nii")).load()
    far = back.join(voxels, ["slice", "row", "col"]).where(F.abs(F.col("values")[0] - F.coalesce("v", F.lit(0.0))) > 1e-7)
    assert back.count() == 315 and far.count() == 0


def test_remote_paths_are_refused():
    with pytest.raises(ValueError, match="mount"):
        sinks.local("s3://bucket/a.nii")
