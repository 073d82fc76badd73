"""Aggregates over small tables of their own."""

from __future__ import annotations

import pytest

from lodestream.plans.registry import QUERIES

#: l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
LINES = [(1, 1, 0, 7, 5.0), (1, 2, 1, 7, 30.0), (2, 1, 0, 8, 5.0), (2, 6, 0, 8, 40.0), (3, 4, 1, 9, 2.0), (3, 9, 1, 9, 30.0), (4, 11, 0, 9, None)]


@pytest.fixture
def folder(spark, tmp_path):
    """A writer of lineitem and part with the given lines; returns the folder."""

    def write(lines):
        rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
        rows.selectExpr("*", "0.0D as l_discount", "timestamp '2024-01-01 00:00:00' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
        parts = spark.createDataFrame([(0, "Brand#11", "T", "X"), (1, "Brand#12", "U", "Y")], "p_partkey long, p_brand string, p_type string, p_name string")
        parts.write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("lines, total", [(LINES, 112), ([], 0), ([(1, 1, 0, 7, None)], 0)])
def test_total_savings(spark, folder, lines, total):
    assert [r.total for r in QUERIES["A14_total_savings"](spark, folder(lines)).collect()] == [total]


def test_grouped_and_sorted_has_every_finding(spark, folder):
    lines = LINES + [(5, 6, None, 9, 1.0), (6, 1, 0, 9, 5.0)]
    got = sorted(QUERIES["A77_grouped_and_sorted"](spark, folder(lines)).select("file", "rule_id", "severity", "id", "place", "members").collect())
    assert [tuple(r) for r in got] == [
        ("Brand#11", "T", "low", "1-1", 2, 5),
        ("Brand#11", "T", "low", "2-1", 3, 5),
        ("Brand#11", "T", "low", "2-6", 1, 5),
        ("Brand#11", "T", "low", "4-11", 5, 5),
        ("Brand#11", "T", "low", "6-1", 4, 5),
        ("Brand#12", "U", "critical", "3-4", 2, 2),
        ("Brand#12", "U", "critical", "3-9", 1, 2),
        ("Brand#12", "U", "medium", "1-2", 1, 1),
    ]
