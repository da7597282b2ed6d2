"""The largest component of the voxels over the mean value, against a flood fill."""

import pytest

from latticeflow.plans import queries as plans


def flood(voxels):
    """Ids of the largest component of {(slice, row, col): id}, ties to the one with the least id."""
    left, best = dict(voxels), []
    while left:
        stack = [min(left, key=left.get)]
        found = [left.pop(stack[0])]
        while stack:
            s, r, c = stack.pop()
            for at in ((s - 1, r, c), (s + 1, r, c), (s, r - 1, c), (s, r + 1, c), (s, r, c - 1), (s, r, c + 1)):
                if at in left:
                    found.append(left.pop(at))
                    stack.append(at)
        if (-len(found), min(found)) < (-len(best), min(best, default=0)):
            best = found
    return sorted(best)


def brightest(rows):
    mean = sum(r["v"] for r in rows) / len(rows)
    return flood({(r["slice"], r["row"], r["col"]): r["id"] for r in rows if r["v"] > mean + 1e-9})


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_component_of_values(spark, size):
    sf = f"/root/testdata/{size}"
    rows = plans.lattice(spark, sf).collect()
    expected = brightest(rows)
    got = sorted(r["id"] for r in plans.queries()["largest_bright_component"](spark, sf).collect())
    assert got == expected and len(got) > 1


def test_component_follows_the_value(spark, tmp_path):
    """A bright block of 3 x 4 voxels in the dark, whatever the ids."""
    block = {200 + 20 * r + c for r in range(2, 5) for c in range(6, 10)}
    spark.createDataFrame([(i, 1000.0 if i in block or i % 17 == 0 else 10.0) for i in range(600)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = plans.lattice(spark, str(tmp_path)).collect()
    expected = brightest(rows)
    got = sorted(r["id"] for r in plans.queries()["largest_bright_component"](spark, str(tmp_path)).collect())
    assert got == expected and block <= set(got)
