"""Solvers of many signals at once against one signal at a time."""

import numpy as np
import pytest

from latticeflow.functions import models, solvers


@pytest.mark.parametrize("name", ["nnsls", "pgs"])
@pytest.mark.parametrize("sparsity", [1e-7, 0.01])
def test_batches_find_what_single_signals_do(name, sparsity):
    rng = np.random.default_rng(6)
    e = rng.random((20, 9))
    f = rng.random((37, 9)) @ e.T * rng.integers(0, 2, (37, 1)) + 0.1 * rng.normal(size=(37, 20))
    f[3] = 0
    one = np.array([solvers.SOLVERS[name](e, y, sparsity) for y in f])
    assert np.allclose(solvers.BATCHES[name](e, f, sparsity), one, atol=1e-9)
    x, sse, _ = models.fit_bases(f, e, name, sparsity)
    assert np.allclose(x, one, atol=1e-9) and np.allclose(sse, ((one @ e.T - f) ** 2).sum(1))


def test_pgs_goes_on_in_parts():
    rng = np.random.default_rng(7)
    e, f = rng.random((8, 4)), rng.random((11, 8))
    assert np.allclose(solvers.pgs_batch(e, f, 0.01, at_once=3), solvers.pgs_batch(e, f, 0.01))
    assert solvers.pgs_batch(e, f[:0], 0.01).shape == (0, 4)
