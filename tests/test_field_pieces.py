"""Field files that no task holds whole."""

import numpy as np
import pytest

from latticeflow.sources import fields, texts

SPEC = "name string, slice int, row int, col int, compartments array<struct<fraction:double,rotation:array<double>,lambda:array<double>,seg:int>>, atoms array<struct<alpha:double,dir:array<double>,grp:int>>"


@pytest.mark.parametrize("binary", [False, True])
def test_fields_are_written_and_read_in_pieces(spark, tmp_path, binary):
    rng = np.random.default_rng(2)
    made = lambda: ([{"fraction": float(rng.random()), "rotation": rng.random(9).tolist(), "lambda": rng.random(3).tolist(), "seg": 1}], [{"alpha": 0.25, "dir": rng.random(3).tolist(), "grp": 2}])
    rows = {name: {(int(p) // 12, int(p) // 4 % 3, int(p) % 4): made() for p in rng.permutation(36)[:n]} for name, n in (("a", 36), ("b", 9), ("c", 1))}
    field = spark.createDataFrame([(name, *k, *v) for name, own in rows.items() for k, v in own.items()], SPEC)
    sizes = {r["name"]: r["bytes"] for r in fields.write_field(field, str(tmp_path), binary).collect()}
    for name, own in rows.items():
        shape = [max(k[i] for k in own) + 1 for i in range(3)]
        want = texts.encode_binary_field(own, *shape) if binary else texts.format_field(own, *shape).encode()
        assert (tmp_path / name).read_bytes() == want and sizes[name] == len(want)
    got = {}
    for r in texts.read_field(spark, str(tmp_path), piece=7).collect():
        voxel = [[x.asDict() for x in r[k]] for k in ("compartments", "atoms")]
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["slice"], r["row"], r["col"]] = tuple(voxel)
    assert {n: {k: v for k, v in own.items() if v != ([], [])} for n, own in got.items()} == rows
    assert len(got["a"]) == 36


def test_a_field_that_ends_early(spark, tmp_path):
    for text in ("3\n1 1 2\n-4 0 0\n", "3\n1 1 1\n-4 1 0.5"):
        with pytest.raises(ValueError, match="ends early"):
            texts.parse_field(text)
    assert list(texts.text_voxels(["3 1 1", " 1", " -4", " 0 ", "0"])) == [(0, 0, 0, [], [])]
