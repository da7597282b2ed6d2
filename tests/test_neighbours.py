"""Comparisons of every query with every row, against plain numpy, with the queries in several passes."""

import numpy as np
import pytest

from latticeflow.operators import neighbours


@pytest.fixture(scope="module")
def vectors():
    x = np.random.default_rng(3).standard_normal((90, 8))
    x[40:50] = x[7]  # ties
    return x


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(5)


@pytest.fixture
def passes(monkeypatch):
    """A limit that 90 vectors of 8 numbers (7200 bytes) pass ten times over."""
    monkeypatch.setattr(neighbours, "PASS_BYTES", 700)
    monkeypatch.setattr(neighbours, "TILE", 64)


def angles(vectors):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.minimum(1.0, np.abs(u @ u.T)))


def test_nearest_axes_have_no_row_limit(table, vectors, passes):
    got = {(r["id"], r["rank"]): (r["neighbour"], r["angle"]) for r in neighbours.nearest_axes(table, table, "id", "v", 4).collect()}
    a = np.round(angles(vectors), 6)
    for i in range(90):
        order = [j for j in sorted(range(90), key=lambda j: (a[i, j], j)) if j != i][:4]
        assert [got[i, r][0] for r in range(4)] == order
        assert np.allclose([got[i, r][1] for r in range(4)], a[i, order], atol=1e-6)
    assert len(got) == 360


def test_codified_directions_count_themselves(table, passes):
    got = neighbours.codify(table, table, "id", "v", 3).groupBy("id").sum("weight").collect()
    assert len(got) == 90 and all(abs(r[1] - 1) < 1e-9 for r in got)


def test_axes_within_have_no_row_limit(table, vectors, passes):
    got = {(r["id"], r["neighbour"]) for r in neighbours.axes_within(table, table, "id", "v", 0.9).collect()}
    a = angles(vectors)
    assert got == {(i, j) for i in range(90) for j in range(90) if i != j and a[i, j] <= 0.9}


def test_pair_distances_have_no_row_limit(table, vectors, passes):
    got = {(r["i"], r["j"]): r["d"] for r in neighbours.pair_sqr_distances(table, table, "id", "v").collect()}
    assert len(got) == 90 * 89 // 2
    assert all(abs(d - ((vectors[i] - vectors[j]) ** 2).sum()) < 1e-9 for (i, j), d in got.items())


def test_no_queries(table):
    assert neighbours.nearest_axes(table.limit(0), table, "id", "v", 4).count() == 0
