"""Registered queries against their SQL, and the others' results for shape, on the smallest tables."""

from __future__ import annotations

import pytest

from tidemill.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, SF).select(*rel.columns)
    a = sorted(map(str, (tuple(r) for r in got.collect())))
    assert a == sorted(map(str, rel.fetchall()))


def test_a_query_for_each_operator():
    names = list(q.queries())
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
