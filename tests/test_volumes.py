"""The data source over images: pushed filters, options, bricks and zipped files give what plain reading gives."""

import numpy as np
import pytest

from latticeflow.operators import graph
from latticeflow.sources import images, volumes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("volumes")
    data = np.random.default_rng(1).random((5, 4, 3, 6)).astype("f4")
    (at / "a.nii").write_bytes(images.encode_nifti(data, more=((6, b"note"),)))
    (at / "b.nii.gz").write_bytes(images.encode_nifti(data * 2, compress=True))
    (at / "notes.txt").write_text("no image")
    volumes.register(spark)
    return at


def rows(df):
    return {(r["path"].rsplit("/", 1)[-1], r["slice"], r["row"], r["col"]): [round(x, 6) for x in r["values"]] for r in df.collect()}


def test_whole_files(spark, folder):
    got = rows(spark.read.format("volume").option("path", str(folder)).load())
    want = rows(images.read_nifti(spark, f"{folder}/*.nii*"))
    assert got == want and len(got) == 2 * 60


def test_filters_and_bricks(spark, folder):
    source = spark.read.format("volume").option("path", f"{folder}/a.nii").option("col", "1:4").option("bricks", "[5,0..1]")
    got = rows(source.load().where("slice > 0 and slice <= 2 and row = 2 and col != 2"))
    want = {k: [v[5], v[0], v[1]] for k, v in rows(images.read_nifti(spark, f"{folder}/a.nii")).items() if 0 < k[1] <= 2 and k[2] == 2 and k[3] in (1, 3)}
    assert got == want and len(got) == 4
    assert source.load().where("slice = 7").count() == 0


def test_picked_bricks_and_places(spark, folder):
    v = images.read_nifti(spark, f"{folder}/a.nii")
    assert rows(images.pick_bricks(v, [2, 2])) == {k: [x[2], x[2]] for k, x in rows(v).items()}
    assert images.signal_at(v, 2, 1, 0).count() == 1 and images.signal_at(v, 9, 0, 0).count() == 0


def test_headers():
    raw = images.encode_nifti(np.zeros((2, 3, 4), "i2"), more=((4, b"x" * 40),))
    assert images.sniff(raw) == 1 and images.sniff(b"") == -1 and images.sniff(raw[:344] + b"\0" * 4) == 0
    assert images.extensions(raw) == [(4, b"x" * 40)]
    assert images.parse_header_text(images.header_text(images.parse_nifti_header(raw)))["nz"] == "4"
    with pytest.raises(ValueError):
        images.parse_header_text("nothing")
    for bad in ("[30]", "[1..]", "[a]", "[1..4(0)]"):
        with pytest.raises(ValueError):
            images.int_list(bad, 20)


def test_shared_folder(spark):
    assert graph.shared_dir(spark)
