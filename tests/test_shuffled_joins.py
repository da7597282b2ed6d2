"""Joins of sides that both grow shuffle both: small files must not send a table through the driver."""

import pytest

from latticeflow.plans import queries as plans


@pytest.mark.parametrize("name", ["sparse_kernel", "dual_lattice"])
def test_neighbours_are_not_broadcast(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan.split("== Initial Plan ==")[0] and "SortMergeJoin" in plan


def test_rounds_of_regularisation_are_not_broadcast(spark):
    from latticeflow.operators import graph, regularize

    voxels = graph.settle(spark.createDataFrame([(0, 0, c, [1.0, 2.0]) for c in range(4)], "slice int, row int, col int, alpha array<double>"))
    at = "struct(slice, row, cast(col + 1 as int) as col) as at"
    edges = graph.settle(voxels.selectExpr("slice", "row", "col", at, "1.0D as w"))
    df = regularize._around(voxels, edges)
    assert df.count() == 3 and {r["near"][0]["w"] for r in df.collect()} == {1.0}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_aligned_denoising_is_dealt_over_all_tasks(spark, sf):
    df = plans.queries()["aligned_denoising"](spark, sf)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
