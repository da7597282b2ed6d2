"""Leading eigenpairs of edge tables against dense matrices."""

import numpy as np
import pytest

from latticeflow.operators import krylov


def edges(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "src long, dst long, w double")


def check(spark, a, k, **how):
    values, vectors = krylov.leading_eigenpairs(edges(spark, a), spark.range(len(a)), k, **how)
    x = np.array([r["x"] for r in vectors.orderBy("id").collect()])
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.allclose(values, want, atol=1e-6) and np.allclose(x.T @ x, np.eye(len(want)), atol=1e-8)
    assert np.linalg.norm(a @ x - x * values, axis=0).max() < 2e-6 * max(1, abs(want[0]))


def test_clustered_and_repeated_values(spark):
    """A ring, whose values come in equal pairs close to one another, beside a piece of its own; the basis starts again on the way."""
    a = np.zeros((26, 26))
    for i in range(24):
        a[i, (i + 1) % 24] = a[(i + 1) % 24, i] = 1.0
    a[24, 25] = a[25, 24] = 1.93
    check(spark, a, 4, most=14)


def test_noise(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 40)) * (rng.random((40, 40)) < 0.3)
    check(spark, a + a.T, 3)


def test_whole_space(spark):
    a = np.diag([3.0, 1.0, 2.0])
    check(spark, a, 3)
    values, vectors = krylov.leading_eigenpairs(edges(spark, a), spark.range(3), 7)
    assert np.allclose(values, [3, 2, 1]) and vectors.count() == 3
    assert krylov.leading_eigenpairs(edges(spark, a), spark.range(0), 2)[0].size == 0


def test_rounds_that_do_not_suffice(spark):
    a = np.zeros((40, 40))
    for i in range(39):
        a[i, i + 1] = a[i + 1, i] = 1.0
    with pytest.raises(RuntimeError, match="residuals"):
        krylov.leading_eigenpairs(edges(spark, a), spark.range(40), 2, rounds=2)


def test_values_of_the_query(spark, sf):
    from latticeflow.operators import graph
    from latticeflow.plans import queries as plans

    rows = graph.normalized_cut(plans.knn_graph(spark, sf)).collect()
    names = {i: k for k, i in enumerate(sorted({r["src"] for r in rows}))}
    a = np.zeros((len(names), len(names)))
    for r in rows:
        a[names[r["src"]], names[r["dst"]]] = r["w"]
    got = plans.queries()["cut_eigenvalues"](spark, sf).orderBy("rank").collect()
    assert np.allclose([r["value"] for r in got], np.linalg.eigvalsh(a)[::-1][:4], atol=1e-6) and [r["n"] for r in got] == [len(names)] * 4
