from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import at

from lodestream.operators.intervals import continuous_periods, periods_and_gaps

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "k string, s timestamp, e timestamp, kind string, __s long"


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(rows, touch=1_000_000):
    """Sorts and merges in plain Python."""
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((us(s), us(e)) for k, s, e, *_ in rows if k == key and s and e and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1] + touch:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return set(map(tuple, periods_and_gaps(df, ["k"], "s", "e", **more).collect()))


def test_overlap_nest_touch_and_gap(spark):
    rows = [("a", at(0), at(10)), ("a", at(5), at(20)), ("a", at(6), at(8)), ("a", at(21), at(30)), ("a", at(32), at(40))]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 3


@pytest.mark.parametrize("gap", [1.0, 1.000001])
def test_exactly_one_second_apart(spark, gap):
    rows = [("a", at(0), at(10)), ("a", at(10 + gap), at(20))]
    assert run(spark, rows) == brute(rows)
    assert len(brute(rows)) == (1 if gap == 1 else 3)


def test_nulls_reversed_empty_and_repeated(spark):
    rows = [
        (None, at(0), at(1)), ("a", None, at(5)), ("a", at(5), None), ("a", at(9), at(2)), ("a", at(3), at(3)),
        ("a", at(0), at(1)), ("a", at(0), at(1)), ("b", at(4), at(4)),
    ]
    assert run(spark, rows) == brute(rows) == {("a", "period", us(at(0)), us(at(1)))}


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_random_over_chunk_borders(spark):
    pick = random.Random(7)
    day = 86_400
    rows = []
    for _ in range(1500):
        start = pick.random() * 200 * day
        rows.append((pick.choice("aaab"), at(start), at(start + pick.choice([0.5, 60, 3600, 5 * day, 0.1 * day, 80 * day * (pick.random() < 0.01)]))))
    assert run(spark, rows, chunk_days=1) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_one_long_period_over_many_chunks(spark):
    day = 86_400
    rows = [("a", at(0), at(100 * day))] + [("a", at(i * day + 5), at(i * day + 50)) for i in range(110)]
    assert run(spark, rows, chunk_days=3) == brute(rows)


def test_periods_keep_two_keys_apart(spark):
    df = spark.createDataFrame([("a", "x", at(0), at(9)), ("a", "y", at(5), at(12))], "k string, c string, s timestamp, e timestamp")
    assert continuous_periods(df, ["k", "c"], "s", "e").count() == 2
