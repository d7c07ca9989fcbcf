"""Every query of the library that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from kgloom import queries as library

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return repr(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        out.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return out


@pytest.mark.parametrize("name", list(library.oracle_sql()))
def test_query(spark, con, name):
    got = library.queries()[name](spark, FOLDER)
    found = con.execute(library.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    expected = sorted(tuple(map(_plain, row)) for row in found.fetchall())
    assert sorted(tuple(map(_plain, row)) for row in got.select(*[f"`{c}`" for c in columns]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_query_without_sql(spark, name):
    got = library.queries()[name](spark, FOLDER)
    assert got.count() > 0
