from __future__ import annotations

import numpy as np
import pytest

from lodestream.llm import distinct as d

SCHEMA = "day string, value string, register int, bits string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def test_counts_and_roll_ups_within_the_error(spark):
    rows = [(f"d{i % 3}", f"v{i % 6000}") for i in range(18000)]
    got = {(r.day, r.grouping): r.distinct for r in d.distinct_counts(table(spark, rows).drop("register", "bits"), ["day"], "value").collect()}
    assert len(got) == 4
    for (_, grouping), n in got.items():
        true = 6000 if grouping else 2000
        assert abs(n / true - 1) < 4 * d.standard_error()


def test_error_over_many_sets(spark):
    rows = [(f"d{i}", f"{i}-{j}") for i in range(60) for j in range(800)]
    got = [r.distinct / 800 - 1 for r in d.distinct_counts(table(spark, rows).select("day", "value"), ["day"], "value", 8).where("grouping = 0").collect()]
    assert len(got) == 60 and abs(np.mean(got)) < 0.025 and np.std(got) < 1.6 * d.standard_error(8)


def test_merging_parts_loses_nothing(spark):
    df = table(spark, [("a", f"v{i}") for i in range(5000)] + [("b", f"v{i}") for i in range(50)]).select("day", "value")
    first, second = df.where("value < 'v3'"), df.where("value >= 'v2'")
    whole = d.sketches(df, ["day"], "value")
    merged = d.merge(d.sketches(first, ["day"], "value").unionByName(d.sketches(second, ["day"], "value")), ["day"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    # Rolled up from merged sketches of parts, or from the rows.
    over = {r.grouping: bytes(r.sketch) for r in d.roll_up(merged, ["day"]).where("grouping = 1").collect()}
    assert over[1] == bytes(d.sketches(df.selectExpr("value"), [], "value").first().sketch)


def test_registers_against_plain_loops():
    pick = np.random.default_rng(2)
    ranks = [set(pick.integers(1, 54, size=pick.integers(0, 9)).tolist()) for _ in range(500)]
    bits = np.array([sum(1 << (r - 1) for r in s) for s in ranks], dtype=np.uint64)
    cells = d.pack(bits)
    for s, cell in zip(ranks, cells.tolist()):
        top = max(s, default=0)
        assert cell == top * 4 + 2 * (top - 1 in s) + (top - 2 in s) * 1
    again = d.unpack(cells)
    assert (d.pack(again) == cells).all()
    # Merging what was packed is the same as packing what was merged.
    assert (d.pack(again[::2] | again[1::2]) == d.pack(bits[::2] | bits[1::2])).all()


def test_more_groups_than_a_task_holds(spark, monkeypatch):
    rows = [(f"d{i % 40}", f"v{i}") for i in range(4000)]
    df = table(spark, rows).select("day", "value").coalesce(1)
    plain = sorted(map(str, d.distinct_counts(df, ["day"], "value", 6).collect()))
    fold = d._fold

    def small(groups, precision):
        run = fold(groups, precision)

        def limited(batches):
            d.HELD = 64 * 7
            return run(batches)

        return limited

    monkeypatch.setattr(d, "_fold", small)
    assert sorted(map(str, d.distinct_counts(df, ["day"], "value", 6).collect())) == plain and len(plain) == 41


def test_nulls_empty_groups_and_tables(spark):
    df = table(spark, [(None, "x"), (None, "x"), ("a", None), ("a", ""), ("a", "z" * 100_000)]).select("day", "value")
    got = {(r.day, r.grouping): r.distinct for r in d.distinct_counts(df, ["day"], "value").collect()}
    assert got == {(None, 0): 1, ("a", 0): 2, (None, 1): 3}
    assert d.distinct_counts(df.limit(0), ["day"], "value").count() == 0


def test_estimates_of_odd_sketches():
    assert d.likelihood_estimates([bytes(16)], 4)[0] == 0
    with pytest.raises(ValueError):
        d.likelihood_estimates([bytes(3)], 4)
