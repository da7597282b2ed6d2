"""Batches of matchings of three axes against one at a time."""

import numpy as np

from latticeflow.functions import assignment


def test_a_batch_is_matched_as_each_pair():
    r = np.random.default_rng(5)
    a, b = r.normal(size=(2, 400, 3, 3))
    a[r.random((400, 3)) < 0.3] = 0
    b[r.random((400, 3)) < 0.3] = 0
    for void in (0.0, 20.0, 60.0):
        to, angles = assignment.match_threes(a, b, void)
        for x, y, t, d in zip(a, b, to, angles, strict=True):
            assert tuple(t) == assignment.match_three(x, y, void)[0] and np.allclose(d, assignment.axial_costs(x, y), rtol=0, atol=1e-9)
