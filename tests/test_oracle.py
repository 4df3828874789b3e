"""Registered queries against their SQL in DuckDB, on small tables."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from tidemill.plans import queries as q

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    if isinstance(v, datetime.date):
        return str(v)
    return v


#: queries whose doubles are rounded to four places and lie on a tie here and there
TIES = {"design_matrix", "rolling_before"}


def same(a, b, step: float = 0.0) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, str):
        return a == b
    return abs(a - b) <= step + 1e-9 * max(1.0, abs(a)) if isinstance(a, float) or isinstance(b, float) else a == b


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v) if not isinstance(v, float) else f"{v:.2f}") for v in r])


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = q.queries()[name](spark, SF)
    rel = duck.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns, key=lambda c: (dict(got.dtypes)[c] == "double", c))
    a = ordered([tuple(plain(r[c]) for c in columns) for r in got.collect()])
    at = [rel.columns.index(c) for c in columns]
    b = ordered([tuple(plain(r[i]) for i in at) for r in rel.fetchall()])
    assert len(a) == len(b)
    assert a, "an empty result proves nothing"
    bad = [(x, y) for x, y in zip(a, b) if not all(same(u, v, 1e-4 if name in TIES else 0.0) for u, v in zip(x, y))]
    assert not bad, bad[:3]
