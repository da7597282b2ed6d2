"""Verification over pairs that are counted and never written."""

import numpy as np
import pytest

from latticeflow.operators import graph, pairs, stats


def plain(rows, wanted, rank):
    """(threshold, rate) over every pair i < j that wanted(i, j) names, with distances summed place by place."""
    rows = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])
    one = [(pairs.placewise(np.array([a[1]]), np.array([b[1]]))[0], a[2] == b[2]) for k, a in enumerate(rows) for b in rows[k + 1 :] if wanted(a[0], b[0])]
    others = sorted(d for d, same in one if not same)
    t, matches = others[rank(len(others))], [d for d, same in one if same]
    return t, sum(d < t for d in matches) / len(matches)


@pytest.fixture
def rows():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5)).astype(np.float32).astype(float)
    x[40:90] = x[40]  # copies: many pairs of one distance
    x[90:110] = x[90] + 1e-7 * r.normal(size=(20, 5))
    x[7] *= 1e3
    ids = r.permutation(900)[:300]
    return [(int(i), v.tolist(), int(l)) for i, v, l in zip(ids, x, r.integers(0, 4, 300), strict=True)] + [(None, [0.0] * 5, 1), (2000, None, 1)]


@pytest.mark.parametrize(("bins", "most"), [(1 << 16, 1 << 18), (16, 40)])
def test_pairs_are_counted_and_not_written(spark, rows, monkeypatch, bins, most):
    monkeypatch.setattr(pairs, "blocks_of", lambda n: 3)
    monkeypatch.setattr(pairs, "BINS", bins)
    monkeypatch.setattr(pairs, "OPEN", most)
    monkeypatch.setattr(graph, "settle", lambda df: pytest.fail("a table of pairs is written"))
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    got = stats.verification_all_pairs(df, "id", "v", "label").first()
    assert (got["threshold"], got["rate"]) == pytest.approx(plain(rows, lambda i, j: True, lambda n: n // 1000), rel=0, abs=0)
    for far in (0.0, 0.02, 0.5, 0.999):
        got = stats.verification_ruled(df.where("id % 3 = 0"), df, "id", "v", "label", lambda i, j: (i + j) % 4 == 0, far).first()
        assert tuple(got) == plain(rows, lambda i, j: i % 3 == 0 and (i + j) % 4 != 0, lambda n: int(far * n))  # noqa: B023


def test_no_pairs_and_odd_vectors(spark):
    schema = "id bigint, v array<double>, label int"
    assert tuple(stats.verification_all_pairs(spark.createDataFrame([], schema), "id", "v", "label").first()) == (None, None)
    far = [(1, [0.0, 1.0], 1), (2, [0.0, float("inf")], 2), (3, [0.0, 2.0], 1), (4, [float("nan"), 0.0], 2), (5, [1.0, 1.0], None)]
    assert tuple(stats.verification_all_pairs(spark.createDataFrame(far, schema), "id", "v", "label").first()) == (float("inf"), 0.5)
