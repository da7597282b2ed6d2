"""Lattice operators on tiles against whole arrays, and tables that go when a round is over."""

import itertools

import numpy as np
import pytest

from latticeflow.operators import denoise, graph, tiles

SIZE = (4, 5, 6)


def table(spark, **arrays):
    first = next(iter(arrays.values()))
    rows = [(int(s), int(r), int(c), *[None if np.isnan(a[s, r, c]) else float(a[s, r, c]) for a in arrays.values()]) for s, r, c in np.ndindex(first.shape[:3])]
    return spark.createDataFrame(rows, "slice int, row int, col int, " + ", ".join(f"{k} double" for k in arrays))


def volume(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["slice"], r["row"], r["col"]])
        out[r["slice"], r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def around(x, there, *at):
    box = tuple(slice(max(0, p - 1), p + 2) for p in at)
    return x[box][there[box]].tolist()


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 11, 13)) + (np.arange(13) > 6)[None, None] * 4.0
    return x, rng.random(x.shape) > 0.15


def test_one_pass_filters_cross_borders(spark, noisy):
    x, there = noisy
    holes = table(spark, v=np.where(there, x, np.nan))
    mean, median = (volume(f(holes, "v", SIZE), name, x.shape) for f, name in ((tiles.mean, "mean"), (tiles.median, "median")))
    gone = holes.where("v is not null")
    close = volume(tiles.selective_mean(gone, "v", "v", 1.0, SIZE), "mean", x.shape)
    dropped = volume(tiles.selective_mean(gone, "v", "v", 1.0, SIZE), "dropped", x.shape)
    for p in np.ndindex(x.shape):
        near = around(x, there, *p)
        assert np.isclose(mean[p], np.mean(near)) and np.isclose(median[p], np.median(near))
        if there[p]:
            own = [n for n in near if abs(n - x[p]) <= 1.0]
            assert np.isclose(close[p], np.mean(own)) and dropped[p] == len(near) - len(own)


@pytest.mark.parametrize("rounds", [1, 3])
def test_erosion(spark, noisy, rounds):
    x, there = noisy
    flags = table(spark, v=np.where(there, x, np.nan)).where("v is not null").selectExpr("slice", "row", "col", "v > -1.5 as f")
    kept = there & (x > -1.5)
    for _ in range(rounds):
        kept = np.array([kept[p] and all(around(kept, there, *p)) for p in np.ndindex(x.shape)]).reshape(x.shape)
    got = volume(tiles.erode(flags, "f", rounds, SIZE), "kept", x.shape)
    assert np.array_equal(got[there] == 1, kept[there]) and np.isnan(got[~there]).all() and 0 < kept.sum()


@pytest.mark.parametrize("data_scale", [None, 2.0])
def test_robust_volume_equals_the_whole_array(spark, noisy, data_scale):
    x, _ = noisy
    whole = denoise.robust(x, 0.8, "geman", 2.0, data_scale, rounds=24)
    got = volume(tiles.robust(table(spark, v=x), ["v"], 0.8, "geman", 2.0, data_scale, rounds=24, tolerance=0.0, size=SIZE, halo=3), "v", x.shape)
    assert np.abs(got - whole).max() < 1e-9 and np.abs(got - x).max() > 0.5


def test_robust_field_with_holes(spark, noisy):
    """Vectors share their weights; holes weigh nothing; rounds end at the tolerance."""
    x, there = noisy
    f = np.stack([x, -x + 1], -1)
    z = np.where(there[..., None], f, 0.0)
    for k in range(900):
        new = tiles.robust_round(z, np.where(there[..., None], f, 0.0), there, 0.5, "tukey", 4.0, None)
        change, z = np.abs(new - z)[there].mean(), new
        if change < 1e-6:
            break
    rows = table(spark, a=np.where(there, x, np.nan), b=np.where(there, -x + 1, np.nan))
    got = tiles.robust(rows, ["a", "b"], 0.5, "tukey", 4.0, size=SIZE, halo=4)
    assert k < 899 and got.count() == there.sum()
    for i, name in enumerate("ab"):
        own = volume(got, name, x.shape)
        assert np.abs(own - z[..., i])[there].max() < 2e-3 and np.isnan(own[~there]).all()


def test_rounds_shuffle_rims_alone(spark, noisy):
    """The tiles of a round are joined where they lie: no exchange stands between a join and a table of tiles."""
    x, _ = noisy
    store = tiles.TileStore(table(spark, v=x))
    rows = spark.createDataFrame([(t, 0, 0, t) for t in range(20)], "ts int, tr int, tc int, n int")
    a, b = store.put("a", rows), store.put("b", rows.withColumnRenamed("n", "m"))
    plan = a.hint("merge").join(b, tiles.TILE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" in plan
    store.clear()
    assert not spark.catalog.tableExists("a")


def spiral(n=15):
    """One path of one voxel's width, wound inwards, with gaps that 26 neighbours don't close."""
    on, r, c, d = np.zeros((n, n), dtype=bool), 0, 0, 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    on[0, 0] = True
    turned = 0
    while turned < 2:
        dr, dc = steps[d]
        a, b = r + dr, c + dc
        ahead = (r + 2 * dr, c + 2 * dc)
        free = 0 <= a < n and 0 <= b < n and not on[a, b] and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and on[ahead])
        if free:
            r, c, turned = a, b, 0
            on[r, c] = True
        else:
            d, turned = (d + 1) % 4, turned + 1
    return on


def flood(on):
    out, names = np.full(on.shape, -1), 0
    for p in np.ndindex(on.shape):
        if on[p] and out[p] < 0:
            todo, out[p] = [p], names
            while todo:
                q = todo.pop()
                for d in itertools.product((-1, 0, 1), repeat=3):
                    a = tuple(np.add(q, d))
                    if all(0 <= i < n for i, n in zip(a, on.shape, strict=True)) and on[a] and out[a] < 0:
                        out[a] = names
                        todo.append(a)
            names += 1
    return out


@pytest.mark.parametrize("kind", ["spiral", "noise"])
def test_components_equal_flood_fill(spark, kind):
    on = np.zeros((3, 15, 15), dtype=bool)
    on[1] = spiral()
    if kind == "noise":
        on = np.random.default_rng(3).random((8, 9, 10)) > 0.88
    want = flood(on)
    rows = table(spark, v=np.where(on, 1.0, np.nan)).where("v is not null").select("slice", "row", "col")
    got = tiles.labels(rows, (2, 4, 5)).collect()
    assert len(got) == on.sum() and (kind == "noise" or want.max() == 0)
    pairs = {(r["comp"], int(want[r["slice"], r["row"], r["col"]])) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == want.max() + 1


def test_rounds_leave_no_tables(spark):
    import os

    folder = graph.shared_dir(spark).removeprefix("file://") + "/latticeflow"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40)], "src long, dst long, w double")
    vertices = spark.range(41)
    assert graph.components(vertices, edges).select("comp").distinct().count() == 1
    assert graph.shortest_paths(vertices, edges, 0).agg({"dist": "max"}).first()[0] == 40
    assert len(set(os.listdir(folder)) - before) <= 2


@pytest.mark.parametrize("name", ["robust_volume", "robust_vectors"])
def test_robust_queries_equal_the_whole_array(spark, sf, name):
    from latticeflow.plans import queries as plans

    if name == "robust_volume":
        voxels, values, lam, how = plans.lattice(spark, sf).selectExpr("slice", "row", "col", "v / 100 as v"), ["v"], 0.5, ("tukey", 4.0, None)
    else:
        voxels, values, lam, how = plans.embeddings(spark, sf).selectExpr("int(vec_id div 200) as slice", "int(vec_id div 20 % 10) as row", "int(vec_id % 20) as col", *[f"double(embedding[{k}]) as {n}" for k, n in enumerate("xyz")]), list("xyz"), 0.2, ("geman", 2.0, 2.0)
    rows = voxels.collect()
    shape = tuple(max(r[k] for r in rows) + 1 for k in ("slice", "row", "col"))
    img, there = np.zeros((*shape, len(values))), np.zeros(shape, dtype=bool)
    for r in rows:
        img[r["slice"], r["row"], r["col"]] = [r[v] for v in values]
        there[r["slice"], r["row"], r["col"]] = True
    z = img
    for k in range(1, 901):
        new = tiles.robust_round(z, img, there, lam, *how)
        change, z = np.abs(new - z)[there].mean(), new
        if k % 8 == 0 and change < 1e-6:
            break
    got = plans.queries()[name](spark, sf).collect()
    assert len(got) == there.sum()
    assert max(abs(r[v] - z[r["slice"], r["row"], r["col"], i]) for r in got for i, v in enumerate(values)) < 1e-5
