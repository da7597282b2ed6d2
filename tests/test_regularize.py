"""Regularisation against plain loops, aligned denoising, and whole experiments."""

import numpy as np
import pytest

from latticeflow.functions import assignment, harmonics, models
from latticeflow.operators import experiment, fields, generate, regularize
from latticeflow.operators.neighbours import KEY

SIZE = (2, 2, 2)
G, D = generate.sphere(20), generate.sphere(6)
PHI = models.basis(G, D, 1500.0, 1.7e-3, 3e-4)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    alpha = r.random((*SIZE, 6))
    return alpha, alpha @ PHI.T + 0.01 * r.standard_normal((*SIZE, 20))


@pytest.fixture(scope="module")
def voxels(spark, data):
    alpha, dw = data
    rows = [(int(s), int(r), int(c), 1.0, dw[s, r, c].tolist(), alpha[s, r, c].tolist(), [1.0, 0.5, 0.2, 0.1, 0.0, 0.3]) for s, r, c in np.ndindex(*SIZE)]
    return spark.createDataFrame(rows, "slice int, row int, col int, s0 double, dw array<double>, alpha array<double>, tensor array<double>").repartition(3).cache()


def as_array(df):
    out = np.zeros((*SIZE, 6))
    for r in df.collect():
        out[r["slice"], r["row"], r["col"]] = r["alpha"]
    return out


def neighbours(p):
    for axis in range(3):
        for step in (-1, 1):
            q = list(p)
            q[axis] += step
            if 0 <= q[axis] < SIZE[axis]:
                yield tuple(q)


def weights(alpha):
    spread, w = regularize.spread_matrix(D), {}
    for p in np.ndindex(*SIZE):
        for axis in range(3):
            q = list(p)
            q[axis] += 1
            if q[axis] < SIZE[axis]:
                w[p, tuple(q)] = w[tuple(q), p] = float(((alpha[p] - alpha[tuple(q)] @ spread) ** 2).sum())
    top = max(w.values())
    return {k: 1 - x / top for k, x in w.items()}


def test_edges(voxels, data):
    got = {((r["slice"], r["row"], r["col"]), tuple(r["at"])): r["w"] for r in regularize.basis_edges(voxels, D).collect()}
    want = weights(data[0])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_robust_smoothing_against_a_loop(voxels, data):
    alpha, dw = data
    w, gram = weights(alpha), PHI.T @ PHI
    wpt = {r: x for r, x in enumerate(projection([1.0, 0.5, 0.2, 0.1, 0.0, 0.3]))}
    now = alpha.copy()
    told = []
    got = as_array(regularize.robust_smooth(voxels, PHI, D, 0.05, 0.02, 0.01, "tensor", rounds=3, inner=2, stop=-1.0, callback=lambda k, df: told.append((k, df.count()))))
    for _ in range(3):
        new = now.copy()
        for p in np.ndindex(*SIZE):
            a, mean, cross = now[p].copy(), now[p].mean(), dw[p] @ PHI
            for _ in range(2):
                for k in range(6):
                    pull = sum(w[p, q] * now[q][k] for q in neighbours(p))
                    total = sum(w[p, q] for q in neighbours(p))
                    others = sum(gram[k, j] * a[j] for j in range(6) if j != k)
                    a[k] = max(0.0, (cross[k] - others + 0.05 * pull - 0.01 * mean) / (gram[k, k] + 0.05 * total + 0.02 * wpt[k] - 0.01))
            new[p] = a
        now = new
    assert np.allclose(got, now) and told == [(0, 8), (1, 8), (2, 8)]


def projection(t):
    m = np.array([[t[0], t[3], t[4]], [t[3], t[1], t[5]], [t[4], t[5], t[2]]])
    q = np.trace(m) * np.eye(3) - m
    x = np.einsum("ni,ij,nj->n", D, q, D)
    return (x - x.min()) / (x.max() - x.min())


def test_neighbourly_least_squares(voxels, data):
    one = as_array(regularize.regularize(voxels, PHI, D, 0.0, 0.0, rounds=1))
    assert (one >= 0).all() and np.abs(one @ PHI.T - data[1]).max() < 0.1
    strong = as_array(regularize.regularize(voxels, PHI, D, 0.0, 50.0, rounds=60))
    assert np.ptp(strong, axis=(0, 1, 2)).max() < 0.2 * np.ptp(one, axis=(0, 1, 2)).max()


def test_steps_and_mixing_keep_coefficients_positive(voxels):
    for mixed in (False, True):
        a = as_array(regularize.regularize_in_steps(voxels, PHI, D, "tensor", 1e-3, 2, mixed, rounds=2))
        assert np.isfinite(a).all() and (a >= 0).all() and a.sum() > 0


def test_aligned_denoising(spark):
    d = np.array([0.0, 0.6, 0.8])
    clean = models.signal([1.0], [models.tensor(d, 1.7e-3, 3e-4)], G, 1500.0)
    r = np.random.default_rng(2)
    rows = [(0, int(y), int(x), 1.0, (clean + 0.02 * r.standard_normal(20)).tolist()) for y, x in np.ndindex(3, 3)]
    out = regularize.denoise_aligned(spark.createDataFrame(rows, "slice int, row int, col int, s0 double, dw array<double>"), G, lmax=4).collect()
    before = np.mean([(np.array(x[4]) - clean) ** 2 for x in rows])
    assert np.mean([(np.array(x["dw"]) - clean) ** 2 for x in out]) < before
    assert {len(x["errors"]) for x in out} == {3, 5, 8}


def test_settings_are_read_back():
    s = experiment.parse("b 2000 # s/mm2\nsolver nnsls\nestimate true\nunits s/m^2\n")
    assert s.b == 2000 and s.estimate and s.weighting == 2e9
    assert experiment.parse(experiment.describe(s)) == s
    with pytest.raises(ValueError):
        experiment.parse("bee 2000")


def test_experiment_without_noise(spark, tmp_path):
    truth = generate.random_field(spark, 1, 2, 2, seed=3, crossing=lambda s, r, c: False)
    settings = experiment.Settings(least_peak=0.5)
    g, basis = generate.sphere(30), generate.sphere(60)
    found = experiment.reconstruct(experiment.simulated(truth, g, settings), g, basis, settings)
    row = experiment.evaluate(truth, found).first()
    assert row["missing_mean"] == 0 and row["extra_mean"] == 0 and row["angle_mean"] < 10
    assert experiment.cropped(truth.limit(0), found).where("size(compartments) > 0").count() == 0
    rows = experiment.training_set(truth, found).collect()
    assert len(rows) == 4 and all(r["truth_count"] == 1 and len(r["angles"]) == max(0, len(r["fractions"]) - 1) for r in rows)
    assert experiment.coherence_images(truth, str(tmp_path / "lci")).count() == 1


def test_masks_profiles_and_steps(spark):
    truth = generate.random_field(spark, 1, 2, 2, seed=5, crossing=lambda s, r, c: False)
    g, settings = generate.sphere(30), experiment.Settings(samplings=2)
    signals = experiment.simulated(truth, g, settings)
    longitudinal, transversal = experiment.profile(experiment.tensor_mask(signals, g, settings), settings)
    assert longitudinal == pytest.approx(1.7e-3) and transversal == pytest.approx(3e-4)
    for kind in ("mean", "median", "selective"):
        assert experiment.smoothed(signals, g, experiment.Settings(smoothing=kind, strength=10.0)).count() == 4
    average = experiment.cumulative_averages(truth, g, settings, (40, 20)).collect()
    assert len(average) == 8 and {len(r["dw"]) for r in average} == {30}
    sweep = experiment.snr_sweep(truth, g, generate.sphere(40), settings, (20,)).collect()
    assert len(sweep) == 1 and sweep[0]["snr"] == 20
    grid = experiment.denoising_grid(truth, g, experiment.Settings(snr=10.0), np.array([0.5]), ("tv",)).collect()
    assert {r["kind"] for r in grid} == {"none", "tv"} and all(r["rmse"] > 0 for r in grid)


def test_studies_and_progress(spark):
    study = experiment.parameter_study(spark, 4)
    assert study.count() == 16 and study.select(fields.smallest_angle(study["compartments"])).where("col = 3") is not None
    df, seen = experiment.observed(study, "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 16
    assert experiment.Clock().tic().toc() >= 0
    assert study.select(*KEY).distinct().count() == 16


def test_aligning_a_batch_of_axial_shapes_is_that_of_each(monkeypatch):
    """Half of the points gives what all of them give one pair at a time, and no pair goes through the loop."""
    r = np.random.default_rng(3)
    half = r.uniform(0.1, 1.0, (40, 12, 1)) * (lambda d: d / np.linalg.norm(d, axis=1, keepdims=True))(r.standard_normal((12, 3)))
    both = lambda x: np.concatenate([x, -x])
    want = [assignment.icp(both(x), both(y)) for x, y in zip(half[:-1], half[1:], strict=True)]
    monkeypatch.setattr(assignment, "assign", None)
    moved, errors = assignment.axial_icp(half[:-1], half[1:])
    assert np.allclose(errors, [e for _, e in want], atol=1e-12)
    assert np.allclose(moved, [x[:12] for x, _ in want], atol=1e-9)


def test_assignments_of_a_batch(monkeypatch):
    r = np.random.default_rng(9)
    for k in (1, 2, 5, 12):
        for c in (r.random((60, k, k)), r.integers(0, 3, (60, k, k)).astype(float)):
            to = assignment.assign_batch(c)
            assert (np.sort(to, axis=1) == np.arange(k)).all()
            assert np.allclose(np.take_along_axis(c, to[:, :, None], 2).sum((1, 2)), [assignment.assign(x)[1] for x in c])
    assert assignment.assign_batch(np.zeros((0, 3, 3))).shape == (0, 3)


def test_aligned_denoising_against_a_loop(spark):
    """Voxel by voxel with all points of both shapes; one voxel has no neighbours."""
    r = np.random.default_rng(8)
    dw = {(0, y, x): r.uniform(0.2, 1.0, 20) for y, x in np.ndindex(3, 3)} | {(5, 5, 5): r.uniform(0.2, 1.0, 20)}
    rows = spark.createDataFrame([(*p, 1.0, y.tolist()) for p, y in dw.items()], "slice int, row int, col int, s0 double, dw array<double>")
    got = {(x["slice"], x["row"], x["col"]): x for x in regularize.denoise_aligned(rows, G, lmax=2).collect()}
    shape = lambda y: np.concatenate([y[:, None] * G, -y[:, None] * G])
    fit = lambda s: np.linalg.lstsq(harmonics.design(s[:20], 2), np.linalg.norm(s[:20], axis=1), rcond=None)[0]
    for p, y in dw.items():
        near = [assignment.icp(shape(dw[q]), shape(y)) for q in sorted(dw) if q != p and max(abs(a - b) for a, b in zip(p, q, strict=True)) <= 1]
        e = np.array([x for _, x in near])
        limit = np.sort(np.append(e, np.inf))[(len(e) + 1) // 2] if len(e) else 0.0
        kept = [shape(y), *[s for s, x in near if x <= limit]]
        assert np.allclose(got[p]["errors"], e, atol=1e-9)
        assert np.allclose(got[p]["dw"], harmonics.design(G, 2) @ np.mean([fit(s) for s in kept], axis=0), atol=1e-9)
