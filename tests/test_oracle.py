"""Every query with a DuckDB twin agrees with it on the small tables, value by value."""

from __future__ import annotations

import duckdb
import pytest

from quire.plans import catalogue, registry

ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, spark, sf, duck):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for c in a.columns:
        assert (a[c] == b[c]).all(), c
