"""Every plan with an oracle, in Spark and DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from wavemill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    return str(v).lower() if isinstance(v, bool) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(float(r[k]) if type(r[k]).__name__ in ("Decimal",) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_plan_equals_oracle(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got.columns, got.collect()), _rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or math.isclose(float(p), float(q), rel_tol=1e-5, abs_tol=2e-6)
