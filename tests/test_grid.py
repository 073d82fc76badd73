from __future__ import annotations

import math
import random

from conftest import at
from pyspark.sql import functions as F

from lodestream.operators.grid import regular_grid

SCHEMA = "id string, c string, t timestamp, y double, slot_s string, __slot int"


def grid(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r.c, r.slot_s): r for r in regular_grid(df, "id", "c", "t", ["y"], F.col("y") > 0, **more).collect()}


def seconds(t):
    return int((t - at(0)).total_seconds()) + 1_704_067_200


def test_outage_is_filled_near_its_ends_and_marked_inside(spark):
    rows = [(str(i), "a", at(i * 60), 2.0 + i) for i in range(30)] + [(f"b{i}", "a", at(7200 + i * 60), 9.0) for i in range(30)]
    got = grid(spark, rows)
    status = [got[k].status for k in sorted(got)]
    assert len(got) == 30 and status[:6] == ["observed"] * 6 and status[6] == "filled" and "missing" in status
    assert all((r.y is None) == (r.status == "missing") for r in got.values())


def test_a_line_is_kept(spark):
    rows = [(str(i), "a", at(i * 37), 5.0 + 0.01 * i * 37) for i in range(200)]
    got = grid(spark, rows)
    inner = sorted(got)[4:-4]
    assert all(math.isclose(got[k].y, 5.0 + 0.01 * (k[1] + 150 - 1_704_067_200), rel_tol=1e-9) for k in inner)


def test_unusable_repeated_and_null_rows(spark):
    rows = [("1", "a", at(0), -1.0), ("2", "a", at(700), 4.0), ("2", "a", at(700), 4.0), ("3", "a", at(1000), None), (None, "a", at(710), 4.0), ("4", None, at(5), 1.0), ("5", "a", None, 1.0)]
    got = grid(spark, rows)
    assert [got[k].n_usable for k in sorted(got)] == [0, 0, 2, 0]


def test_empty_table(spark):
    assert grid(spark, []) == {}


def test_against_brute_force(spark):
    pick = random.Random(3)
    rows = [(str(i), "a", at(pick.random() * 20_000), pick.random() * 9 + 1) for i in range(60)]
    for (_, slot), r in grid(spark, rows).items():
        d = [((seconds(at(0)) + (t - at(0)).total_seconds() - slot - 150) / 900, y) for _, _, t, y in rows]
        w = [(max(0.0, 1 - abs(x) ** 3) ** 3, x, y) for x, y in d if abs(x) < 1]
        s0, s1, s2 = (sum(k * x**p for k, x, _ in w) for p in (0, 1, 2))
        t0, t1 = (sum(k * x**p * y for k, x, y in w) for p in (0, 1))
        if r.y is not None and len(w) > 2 and min(x for _, x, _ in w) <= 0 <= max(x for _, x, _ in w):
            assert math.isclose(r.y, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), rel_tol=1e-6)
