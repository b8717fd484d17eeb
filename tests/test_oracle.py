"""Each telemetry query against its SQL in DuckDB, as multisets of rows."""

import math

import duckdb
import pytest

from spanloom.plans import registry

SF = "/root/testdata/sf0.01"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".") if v == v else v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    data = got.collect()
    if name not in registry.oracle_sql():
        assert data
        return
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a, b = rows(got.columns, data), rows(names, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
    assert a
