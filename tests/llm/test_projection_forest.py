"""Operator 11 against brute force."""

import numpy as np
import pytest

from latticeflow.llm import projection_forest as pf


def table(spark, rows):
    return spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id bigint, embedding array<double>, v bigint, `a.b` string")


def plain(rows, k=5, every=50):
    """{query: [(score, vec_id)]} of all candidates, nearest first."""
    fine = [(i, tuple(map(float, e))) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    fine = [(i, np.array(e) / max(map(abs, e))) for i, e in dict.fromkeys(fine)]
    out = {}
    for q, x in fine:
        if q % every == 0:
            own = [(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in fine if i != q and len(y) == len(x)]
            out.setdefault(q, []).append(sorted(own, key=lambda e: (-round(e[0], 12), e[1]))[:k])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)]  # copies of a query: ties by vec_id
    rows += [(50, rows[50][1]), (2000, None), (2050, []), (2100, [0.0] * 6), (2150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] + [0.0] * 5), (2250, [float("inf")] + [1.0] * 5), (None, rows[3][1])]
    rows += [(3000, [1.0, 0.0]), (3001, [0.5, 0.5]), (3050, [1e300, 1e-300]), (4000, [3.0, 1.0, 1.0])]  # other lengths; few or no candidates
    got, want = found(pf.nearest(table(spark, rows))), plain(rows)
    assert set(got) == {q for q, lists in want.items() if lists[0]} and 4000 not in got
    for q, ranked in got.items():
        assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1))
        assert [v for _, v, _ in ranked] == [v for _, v in want[q][0]]
        assert np.allclose([s for _, _, s in ranked], [s for s, _ in want[q][0]], atol=1e-14)
    assert [v for _, v, _ in got[0]] == [1000, 1001, 1002, 1003, 1004] and len(got[3000]) == 2


def test_nothing_usable(spark):
    out = pf.nearest(table(spark, [(0, None), (50, [0.0])]))
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall(spark, kind):
    """Whether vectors are equally far or in groups; with several rounds of splits and leaves far below the table."""
    rng = np.random.default_rng(2)
    n, dim = 3000, 32
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.2 * x
    rows = [(i, e) for i, e in enumerate(x.tolist())]
    saved, pf.STEP = pf.STEP, 3
    try:
        got = found(pf.nearest(table(spark, rows), leaf=32))
    finally:
        pf.STEP = saved
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, ranked in got.items():
        s = u @ u[q]
        s[q] = -2
        assert len(ranked) == 5 and np.allclose([s[v] for _, v, _ in ranked], [c for _, _, c in ranked])
        hits += sum(c >= np.sort(s)[-5] - 1e-12 for _, _, c in ranked)
    assert len(got) == n // 50 and hits >= 0.9 * 5 * len(got)


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(1500)]
    got = found(pf.nearest(table(spark, rows)))
    assert [v for _, v, _ in got[150]] == [0, 3, 6, 9, 12] and len(got) == 30
    assert all(abs(s - 1) < 1e-12 for _, _, s in got[300])


def test_thresholds_part_evenly():
    p = np.random.default_rng(0).normal(size=(1024, 5))
    cut, node = pf.thresholds(p), np.zeros(1024, dtype=int)
    for level in range(5):
        node = 2 * node + 1 + (p[:, level] > cut[node])
    assert set(np.bincount(node - 31)) == {32}
    chances = pf.leaf_chances(p[:3], cut, np.array([0.1, 1.0, 10.0]))
    assert np.allclose(chances.sum(axis=1), 1, atol=1e-6) and chances[0].argmax() == node[0] - 31 and chances[2].max() < 0.1


def test_rows_of_many_cells_go_together():
    """One call for rows that have each its own thresholds gives what a call for each row gives."""
    rng = np.random.default_rng(6)
    p, cuts, sigma = rng.normal(size=(300, 3)), rng.normal(size=(300, 7)), rng.uniform(0.1, 2, 300)
    together = pf.leaf_chances(p, cuts, sigma)
    assert together.shape == (300, 8)
    assert all((together[i] == pf.leaf_chances(p[i : i + 1], cuts[i], sigma[i : i + 1])[0]).all() for i in range(300))
