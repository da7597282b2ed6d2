"""Matrix, assignment, solver, harmonic and model routines against direct formulas and invariants."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.functions import assignment, harmonics, linalg, models, solvers
from latticeflow.operators import clustering, denoise, generate, stats


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, seed):
    c = np.random.default_rng(seed).random((n, n))
    to, cost = assignment.assign(c)
    assert sorted(to) == list(range(n))
    assert cost == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))))


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 12), st.integers(1, 8), st.integers(0, 10_000))
def test_nnls_meets_its_conditions(n, m, seed):
    r = np.random.default_rng(seed)
    e, f = r.standard_normal((n, m)), r.standard_normal(n)
    x, error = solvers.nnls(e, f)
    g = e.T @ (f - e @ x)
    assert (x >= 0).all() and (g <= 1e-6).all() and abs(g @ x) < 1e-6
    assert error == pytest.approx(((e @ x - f) ** 2).sum())


def test_sparse_solvers_agree_on_an_orthogonal_basis():
    r = np.random.default_rng(1)
    e = np.linalg.qr(r.standard_normal((20, 6)))[0]
    f = e @ np.array([2.0, 0, 1, 0, 0, 0.5])
    for name in solvers.SOLVERS:
        x = solvers.SOLVERS[name](e, f, 1e-8)
        assert np.abs(x - [2, 0, 1, 0, 0, 0.5]).max() < 1e-3, name


def test_lasso_path_bounds_the_norm():
    r = np.random.default_rng(2)
    x, y = r.standard_normal((30, 5)), r.standard_normal(30)
    beta = solvers.lars(x, y, 0.2)
    assert np.abs(beta).sum() == pytest.approx(0.2)
    full = solvers.lars(x, y, np.inf)
    assert np.abs(full - np.linalg.lstsq(x, y, rcond=None)[0]).max() < 1e-6


def test_bfgs_finds_the_minimum():
    f = lambda v: (v[0] - 1) ** 2 + 10 * (v[1] + 2) ** 2
    g = lambda v: np.array([2 * (v[0] - 1), 20 * (v[1] + 2)])
    assert np.abs(solvers.bfgs(f, g, np.zeros(2))[0] - [1, -2]).max() < 1e-5


def test_matrix_routines():
    r = np.random.default_rng(3)
    a = r.standard_normal((5, 3))
    assert np.allclose(linalg.pseudo_inverse(a), np.linalg.pinv(a))
    q, t = linalg.qr(a)
    assert np.allclose(q @ t, a) and np.allclose(q @ q.T, np.eye(5))
    s = r.standard_normal((4, 4))
    for scale in (1e-3, 1.0, 30.0):
        v, w = np.linalg.eig(s * scale / 4)
        assert np.allclose(linalg.expm(s * scale / 4), ((w * np.exp(v)) @ np.linalg.inv(w)).real, rtol=1e-8, atol=1e-6 * np.exp(np.abs(v.real).max()))
    b = s @ s.T + np.eye(4)
    m = s + s.T
    values, vectors = linalg.generalized_symmetric_eigen(m, b)
    assert np.allclose(m @ vectors, b @ vectors * values)
    psd, _, _ = linalg.project_psd(m)
    assert np.linalg.eigvalsh(psd).min() > -1e-9


def test_rotations_round_trip():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.standard_normal((2, 3))
        rot = linalg.from_to_rotation(a, b)
        assert np.allclose(rot @ (a / np.linalg.norm(a)), b / np.linalg.norm(b)) and np.linalg.det(rot) == pytest.approx(1)
        q = linalg.rotation_quaternion(rot)
        assert np.allclose(linalg.quaternion_rotation(q), rot)
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = rot * [2, 3, 4], [5, 6, 7]
        p = linalg.quaternion_from_affine(m)
        assert np.allclose(linalg.affine_from_quaternion(p["b"], p["c"], p["d"], p["offset"], p["sizes"], p["qfac"]), m)
    assert linalg.orientation_codes(np.eye(4)) == (1, 3, 5)


def test_horn_and_icp_undo_a_motion():
    r = np.random.default_rng(5)
    x = r.standard_normal((12, 3))
    rot = linalg.rotation_from_angles(0.2, 0.1)
    t, scale = assignment.horn_align(x, x @ rot.T + 1)
    assert np.allclose(x @ t[:3, :3].T + t[:3, 3], x @ rot.T + 1) and scale == pytest.approx(1)
    assert assignment.icp(x, (x @ linalg.rotation_from_angles(0.02, 0.01).T))[1] < 1e-8


def test_emd_on_a_line_is_the_area_between_cumulatives():
    r = np.random.default_rng(6)
    for _ in range(10):
        p, q = r.random((2, 7))
        p, q = p / p.sum(), q / q.sum()
        d = np.abs(np.subtract.outer(np.arange(7.0), np.arange(7.0)))
        assert assignment.emd(p, q, d) == pytest.approx(np.abs(np.cumsum(p - q)).sum(), abs=1e-9)
        assert assignment.emd(p, q, d, metric=True) == pytest.approx(np.abs(np.cumsum(p - q)).sum(), abs=1e-9)


def test_harmonics_are_orthonormal():
    z, w = np.polynomial.legendre.leggauss(20)
    a = np.arange(40) * 2 * np.pi / 40
    s = np.sqrt(1 - z * z)
    d = np.stack([np.outer(s, np.cos(a)), np.outer(s, np.sin(a)), np.outer(z, np.ones(40))], -1).reshape(-1, 3)
    y = harmonics.design(d, 6)
    assert np.allclose((y * np.repeat(w, 40)[:, None] * 2 * np.pi / 40).T @ y, np.eye(y.shape[1]), atol=1e-10)
    assert harmonics.value(0.3, 0.7, 2, 1) == pytest.approx(y[0, 0] * 0 + harmonics.design(np.array([[np.cos(0.3) * np.sin(0.7), np.sin(0.3) * np.sin(0.7), np.cos(0.7)]]), 2)[0, 4])


def test_tensor_fit_recovers_a_noise_free_tensor():
    g = generate.sphere(30)
    d = np.array([0.6, 0.0, 0.8])
    t = models.tensor(d, 1.7e-3, 3e-4)
    fit = models.TensorModel(1500.0, g).voxel(1.0, models.signal([1.0], [t], g, 1500.0))
    assert np.allclose(fit["ev"], [3e-4, 3e-4, 1.7e-3]) and abs(np.dot(fit["pdd"], d)) == pytest.approx(1)
    assert np.isnan(models.TensorModel(1500.0, g).voxel(0.0, np.ones(30))["fa"])
    four = models.TensorModel(1500.0, generate.sphere(60), rank=4)
    assert np.allclose(four.design @ four.solve(1.0, np.exp(four.design @ np.arange(15.0) * 1e-4)), four.design @ np.arange(15.0) * 1e-4)


def test_profile_derivatives_match_differences():
    r = np.random.default_rng(7)
    g, d = generate.sphere(20), generate.sphere(8)
    a, p = r.random(8), np.array([3e-4, 1.2e-3])
    s = models.basis(g, d, 1000.0, 1.9e-3, 4e-4) @ a
    f = lambda q: models.profile_objective(q, s, g, d, a, 1000.0)
    h = 1e-8
    num = np.array([(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(2)])
    assert np.allclose(models.profile_gradient(p, s, g, d, a, 1000.0), num, rtol=1e-4)
    hess = np.array([(models.profile_gradient(p + h * e, s, g, d, a, 1000.0) - models.profile_gradient(p - h * e, s, g, d, a, 1000.0)) / (2 * h) for e in np.eye(2)])
    assert np.allclose(models.profile_hessian(p, s, g, d, a, 1000.0), hess, rtol=1e-3)
    assert np.allclose(models.fit_profile(s, g, d, a, 1000.0), [4e-4, 1.5e-3], rtol=1e-2)


def test_deconvolution_points_along_the_fibre():
    g = generate.sphere(64)
    z = np.array([0, 0, 1.0])
    r, n = models.response([(1.0, models.signal([1.0], [models.tensor(z, 1.7e-3, 3e-4)], g, 3000.0), z)], g, 6)
    d = np.array([0.8, 0.6, 0.0])
    f = models.Deconvolution(r, g, generate.sphere(200), 6).solve(1.0, models.signal([1.0], [models.tensor(d, 1.7e-3, 3e-4)], g, 3000.0))
    dirs = generate.sphere(2000)
    dirs[:, 2] *= 0.999
    best = dirs[np.argmax(harmonics.amplitudes(f, dirs, 6))]
    assert n == 1 and abs(best @ d) > 0.98


def test_grouping_and_refinement():
    d = generate.sphere(60)
    alpha = np.zeros(60)
    alpha[[3, 40]] = [0.7, 0.3]
    found = models.peaks(alpha, d)
    assert len(found) == 2 and found[0][1] == pytest.approx(0.7)
    labels = models.split_by_angle(alpha, d, 0.1)
    assert labels[3] == 0 and labels[40] == 1 and (labels == -1).sum() == 58
    g = generate.sphere(40)
    s = models.signal([1.0], [models.tensor(d[3] + 0.1 * d[4], 1.7e-3, 3e-4)], g, 1500.0)
    start = models.fit_basis(s, models.basis(g, d, 1500.0, 1.7e-3, 3e-4))[1]
    assert models.refine(s, g, d, 1500.0, 1.7e-3, 3e-4)[2] <= start


def test_scaling_and_discretisation():
    r = np.random.default_rng(8)
    x = r.standard_normal((15, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    y = clustering.multidimensional_scaling(d, 2)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), d)
    label = clustering.discretize(np.eye(3)[[0, 0, 1, 2, 2]] + 1e-3)
    assert label[0] == label[1] and label[3] == label[4] and len(set(label.tolist())) == 3
    line = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    assert np.allclose(clustering.geodesic(line, 2), line)


def test_filters_smooth_without_moving_the_mean():
    r = np.random.default_rng(9)
    g = np.zeros((20, 20))
    g[:, 10:] = 1
    noisy = g + 0.1 * r.standard_normal(g.shape)
    for name, f in denoise.FILTERS.items():
        u = f(noisy, 1.0 if name in ("robust", "robust_or", "tv_l1") else 4.0)  # above 2, TV-L1 gives the image back
        assert ((u - g) ** 2).mean() < ((noisy - g) ** 2).mean(), name
    u, c = r.standard_normal((2, 5, 6)), r.standard_normal((5, 6))
    a, b = denoise.forward(c)
    assert (a * u[0] + b * u[1]).sum() == pytest.approx(-(c * denoise.back_divergence(*u)).sum())


def test_small_helpers():
    assert stats.nth_allowed(2, {0, 1, 3}) == 5
    v, t = linalg.subdivide_sphere(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1.0]]), np.array([[0, 1, 2], [1, 3, 2], [3, 4, 2], [4, 0, 2], [1, 0, 5], [3, 1, 5], [4, 3, 5], [0, 4, 5]]))
    assert len(t) == 32 and len(v) == 18 and np.allclose(np.linalg.norm(v, axis=1), 1)
    assert len(generate.spread_directions(generate.sphere(100), 5, 0.5)) == 5
    assert assignment.match_axes(np.zeros((0, 3)), np.eye(3))[0].tolist() == []
    p, cost = assignment.match_three(np.eye(3), np.eye(3)[[1, 2, 0]], 90.0)
    assert cost == pytest.approx(0)
