"""Upper medians whose groups no task holds."""

import random

from latticeflow.operators import stats


def test_groups_repeats_and_nulls(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, 5.0, r.random() * 10])) for g in ("a", "b", None) for _ in range(r.randrange(50, 80))] + [("one", 2.0), ("two", 2.0), ("two", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert {s["g"]: s["median"] for s in stats.upper_median(df, "x", ["g"]).collect()} == {g: sorted(x)[len(x) // 2] for g, x in want.items()}
    every = sorted(x for xs in want.values() for x in xs)
    assert [s["median"] for s in stats.upper_median(df, "x").collect()] == [every[len(every) // 2]]


def test_no_window_takes_a_whole_group(spark):
    df = spark.range(60000).selectExpr("id % 2 as g", "cast(id as double) as x")
    got = stats.upper_median(df, "x", ["g"])
    assert {r["g"]: r["median"] for r in got.collect()} == {0: 30000.0, 1: 30001.0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "settled-" in plan and "RowNumber" not in plan and "row_number" not in plan
