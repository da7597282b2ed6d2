"""Queries of operators 11 and 12 against their SQL; that of operator 11 is the exact search, of which it finds nine in ten at least."""

import duckdb
import pytest

from latticeflow.llm import queries


@pytest.mark.parametrize("name", ["op11_projection_forest", "op12_crc_resampling"])
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    key = lambda r: tuple((x is None, round(x, 9) if isinstance(x, float) else x) for x in r)
    want = sorted((tuple(r) for r in theirs.fetchall()), key=key)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names) and want
    ours = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    if name == "op12_crc_resampling":
        assert list(map(key, ours)) == list(map(key, want))
    else:
        at = [names.index(c) for c in ("query_id", "vec_id", "score")]
        pairs = lambda rows: {(r[at[0]], r[at[1]], round(r[at[2]], 9)) for r in rows}
        assert len(ours) == len(want) and len(pairs(ours) & pairs(want)) >= 0.9 * len(want)
