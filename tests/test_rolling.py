from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators.rolling import TwoStackQueue, trailing_totals


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(-50, 50)), max_size=60), st.integers(1, 12))
def test_queue_against_plain_window(steps, width):
    queue, items, key = TwoStackQueue(max, -(10**9)), [], 0
    for jump, value in steps:
        key += jump
        queue.push(key, value)
        items.append((key, value))
        queue.evict(key - width + 1)
        assert queue.total() == max((v for k, v in items if k > key - width), default=-(10**9))


def day(n):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=n)


SCHEMA = "h string, m string, t timestamp, c double, g long, v timestamp, merchant string, n_rows int, __e string"


def totals(spark, rows, windows=(3, 7)):
    df = spark.createDataFrame([(*r, "z", 1, "q") for r in rows], SCHEMA)
    out = trailing_totals(df, ["h"], "v", F.lower(F.trim("m")), "t", {"c": "c", "g": "g"}, windows, "merchant")
    return {(r.merchant, r.day, r.window_days): r for r in out.collect()}


def test_quiet_days_late_versions_and_bad_values(spark):
    nan = float("nan")
    rows = [
        ("1", "A ", day(0), 5.0, 10, day(0)), ("1", " a", day(0), 7.0, 10, day(9)), ("2", "a", day(9), nan, 4, day(9)),
        ("3", "a", day(9), None, None, day(9)), ("4", None, day(3), 1.0, 1, day(3)), ("5", "a", None, 1.0, 1, day(3)), ("6", "", day(3), 1.0, 1, day(3)),
    ]
    got = totals(spark, rows)
    assert len(got) == 20
    first, quiet, last = (got[("a", day(n).date(), 3)] for n in (0, 5, 9))
    assert (first.n_rows, first.sum_c, first.max_c) == (1, 7.0, 7.0)
    assert (quiet.n_rows, quiet.sum_c, quiet.avg_c, quiet.max_c, quiet.active_days) == (0, 0.0, None, None, 0)
    assert (last.n_rows, last.sum_c, last.avg_c, last.sum_g) == (2, 0.0, None, 4.0)


def test_rows_without_key_all_count(spark):
    rows = [(None, "a", day(0), 1.0, 1, day(0))] * 3
    assert totals(spark, rows)[("a", day(0).date(), 3)].n_rows == 3


def test_empty_table(spark):
    assert totals(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_brute_force(spark, seed):
    pick = random.Random(seed)
    rows = [(str(i), pick.choice("aaabc"), day(int(pick.random() ** 2 * 40)), float(pick.randint(0, 99)), pick.randint(0, 9), day(0)) for i in range(300)]
    got = totals(spark, rows)
    for (m, d, w), r in got.items():
        own = [x for x in rows if x[1] == m and 0 <= (d - x[2].date()).days < w]
        assert (r.n_rows, r.sum_c, r.sum_g) == (len(own), sum(x[3] for x in own), sum(x[4] for x in own))
        assert r.max_c == max((x[3] for x in own), default=None)
        assert r.active_days == len({x[2].date() for x in own})
