"""Every query with SQL against DuckDB, on the smallest tables; the others must run."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

# The training-data queries have tests of their own.
QUERIES = {k: q for k, q in entry.queries().items() if "lodestream.llm" not in getattr(q, "__module__", "")}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for file in Path(data).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=str)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
