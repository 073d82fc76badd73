from __future__ import annotations

import random

import numpy as np
from conftest import at

from lodestream.operators.outliers import _rolling, _run_lengths, flag_implausible

BOUNDS = {"g": lambda v: v > 0}
SCHEMA = "id string, a string, t timestamp, g double, measure string, reason int"


def flags(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    # Of the filter's spikes those that lie further outside the ordinary range than it is wide.
    return {(r.id, r.reason) for r in flag_implausible(df, "id", "a", "t", BOUNDS, **more).collect() if r.reason != "spike" or r.excess > 0}


def series(n, seed=1, source="a"):
    pick = random.Random(seed)
    return [[f"{source}{i}", source, at(i * 60), 100.0 + pick.random() * 50] for i in range(n)]


def test_spikes_up_and_down_stuck_and_impossible(spark):
    rows = series(300)
    rows[50][3], rows[60][3], rows[70][3] = 2000.0, 4.0, -3.0
    for i in range(200, 206):
        rows[i][3] = 123.0
    for i in range(220, 225):
        rows[i][3] = 124.0
    wanted = {("a50", "spike"), ("a60", "spike"), ("a70", "impossible")} | {(f"a{i}", "stuck") for i in range(200, 206)}
    assert flags(spark, rows) == wanted
    random.Random(3).shuffle(rows)
    assert flags(spark, rows) == wanted
    # Blocks far smaller than the table, so that runs and windows lie across their borders.
    assert flags(spark, rows, block=7) == wanted


def test_the_filter_decides(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in [*series(200), ["far", "a", at(3000.5), 1000.0]]], SCHEMA)
    found = lambda k: {r.id: r for r in flag_implausible(df, "id", "a", "t", BOUNDS, mads=k).collect() if r.reason == "spike"}
    some, more, none = found(3.0), found(2.0), found(60.0)
    assert set(some) < set(more) and set(none) == set() and "far" in some and all(r.score > 3 for r in some.values())
    assert some["far"].excess > 0 and all(r.excess <= 0 for k, r in more.items() if k != "far")


def test_two_levels_in_turn_hide_no_spike(spark):
    rows = [[r[0], "a", r[2], r[3] * (4 if i % 2 else 1)] for i, r in enumerate(series(300))]
    rows[150][3] = 8000.0
    assert flags(spark, rows) == {("a150", "spike")} == flags(spark, rows, block=30)


def test_small_sources_have_only_impossible_readings(spark):
    rows = series(29)
    rows[3][3], rows[4][3] = 9e9, 0.0
    assert flags(spark, rows) == {("a4", "impossible")}


def test_sources_whose_values_repeat_are_never_stuck(spark):
    rows = series(100)
    for i, r in enumerate(rows):
        r[3] = 7.0 if i % 25 else 8.0
    assert not {x for x in flags(spark, rows) if x[1] == "stuck"}


def test_nulls_repeats_and_empty(spark):
    rows = series(60)
    rows[10][3] = None
    more = [(None, "a", at(5), 1e9), ("x", None, at(5), -1.0), ("y", "a", None, 120.0)]
    assert flags(spark, [*map(tuple, rows), *map(tuple, rows), *more]) == set()
    assert flags(spark, []) == set()


def test_a_null_inside_a_run_does_not_break_it(spark):
    rows = series(80)
    for i in range(20, 27):
        rows[i][3] = 111.0
    rows[23][3] = None
    assert flags(spark, rows) == {(f"a{i}", "stuck") for i in range(20, 27) if i != 23}


def test_ties_in_time(spark):
    rows = [[r[0], r[1], at(0), r[3]] for r in series(50)]
    rows[9][3] = 5000.0
    assert flags(spark, rows) == {("a9", "spike")}


def test_rolling_against_plain_loops():
    values = np.random.default_rng(1).normal(size=40)
    median, mad = _rolling(values, 5)
    for i in range(40):
        window = values[max(0, i - 5) : i + 6]
        assert np.isclose(median[i], np.median(window)) and np.isclose(mad[i], np.median(np.abs(window - np.median(window))))
    assert _run_lengths(np.array([1, 1, 2, 2, 2, 1])).tolist() == [2, 2, 3, 3, 3, 1]
