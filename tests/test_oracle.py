"""Every registered query with SQL against DuckDB at the smallest scale; the others must run and have rows."""

import duckdb
import pytest

from latticeflow.plans import queries as plans

TABLES = "region nation part lineitem orders events documents embeddings pages".split()
SQL = plans.oracle_sql()


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).lower().startswith(("int", "uint", "bool", "float")):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: str(x)[:10] if hasattr(x, "year") else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = table(plans.queries()[name](spark, sf).toPandas()), table(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        same = (ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())
        if ours[c].dtype.kind == "f":
            same |= (ours[c] - theirs[c]).abs() < 2e-6
        assert same.all(), (c, ours[~same].head(), theirs[~same].head())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
