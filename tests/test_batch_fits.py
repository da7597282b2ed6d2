"""Least squares of many voxels together: optimal for every one, and the same as one by one."""

import numpy as np
import pytest

from latticeflow.functions import models, solvers
from latticeflow.operators import generate
from latticeflow.plans import fits as plans


@pytest.mark.parametrize("shape", [(20, 8), (12, 30)])
def test_conditions_of_optimality(shape):
    rng = np.random.default_rng(6)
    e, f = np.abs(rng.normal(size=shape)), rng.normal(size=(300, shape[0]))
    f[:3] = [np.zeros(shape[0]), e.sum(1), -np.ones(shape[0])]
    x = solvers.nnls_batch(e, f, at_once=64)
    w = (f - x @ e.T) @ e
    assert (x >= 0).all() and w.max() < 1e-8 and np.abs(w[x > 0]).max() < 1e-8
    for i in range(0, 300, 7):
        one, error = solvers.nnls(e, f[i])
        assert np.isclose(((e @ x[i] - f[i]) ** 2).sum(), error, atol=1e-9)
        if shape[0] > shape[1]:
            assert np.allclose(one, x[i], atol=1e-8)
    assert solvers.nnls_batch(e, np.zeros((0, shape[0]))).shape == (0, shape[1])


def test_every_voxel_of_the_query_is_optimal(spark, sf):
    phi = models.basis(generate.sphere(32), generate.sphere(64), plans.B, plans.LONGITUDINAL, plans.TRANSVERSAL)
    signals = {(r["slice"], r["row"], r["col"]): np.array(r["dw"]) / (r["s0"] or 1.0) for r in plans.signals(spark, sf).collect()}
    found = plans.queries()["nnls_fit"](spark, sf).collect() if hasattr(plans, "queries") else plans.nnls_fit(spark, sf).collect()
    assert len(found) == len(signals) > 100
    for r in found:
        y, x = signals[r["slice"], r["row"], r["col"]], np.array(r["alpha"])
        w = phi.T @ (y - phi @ x)
        assert (x >= 0).all() and w.max() < 1e-6 and np.abs(w[x > 0]).max(initial=0) < 1e-6
        assert np.isclose(r["sse"], ((phi @ x - y) ** 2).sum()) and np.isclose(r["sse"], solvers.nnls(phi, y)[1], atol=1e-8)
