"""Findings as tables, and the scores' published values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import costs
from lodestream.operators import findings as ops
from lodestream.streaming import monitors

SCHEMA = "id string, rule_id string, file string, line int, severity string, message string, detail int, copies int"


def dedup(spark, rows, strategy, detail="detail"):
    got = ops.deduplicated(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA), strategy, detail).collect()
    return sorted((r.canonical_id, r.copies) for r in got)


def test_duplicates(spark):
    a = ("1", "r", "f", 1, "high", "Re-entrancy  here", 0)
    same = ("2", "r", "f", 1, "high", "Re-entrancy  here", 3)
    spaced = ("3", "r", "f", 1, "high", "re-entrancy here ", 0)
    other = ("4", "q", "f", 1, "critical", "else", 0)
    assert dedup(spark, [a, same], "exact") == [("2", 2)] and dedup(spark, [a, same], "exact", None) == [("1", 2)]
    assert dedup(spark, [a, spaced], "exact") == [("1", 1), ("3", 1)] and dedup(spark, [a, spaced], "normalised") == [("1", 2)]
    assert dedup(spark, [a, same, spaced, other], "same_location") == [("4", 4)]
    nulls = ("5", None, None, None, None, None, None)
    assert dedup(spark, [nulls, nulls], "exact") == [("5", 2)] and dedup(spark, [], "exact") == []


def test_a_third_of_all_rows_in_one_place(spark):
    pick = random.Random(1)
    rows = [(f"{i:05}", "r", "hot" if i % 3 == 0 else f"f{i}", 1, pick.choice(ops.RANKS), "m", i % 7) for i in range(3000)]
    got = dict(dedup(spark, rows, "same_location"))
    hot = min((r for r in rows if r[2] == "hot"), key=lambda r: (ops.RANKS.index(r[4]), -r[6], r[0]))
    assert len(got) == 2001 and got[hot[0]] == 1000


def test_inline_suppressions(spark):
    text = "x\ny // IGNORE r1, r2 -- known -- fine\n// ignore r3\n// other r4\nz // ignore\n// ignore -- why\n"
    rows = ops.inline_suppressions(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "file string, source string"), "ignore").collect()
    assert sorted((r.file, r.line, r.rule_id, r.reason) for r in rows) == [("a", 2, "r1", "known -- fine"), ("a", 2, "r2", "known -- fine"), ("a", 3, "r3", "No reason provided")]


def test_suppressed(spark):
    rows = [("r1", "src/a.rs", 5), ("r1", "src/a.rs", 6), ("r1", "src/a.rs", 7), ("r2", "src/a.rs", 5), ("r2", "src/deep/b.rs", 1), ("r3", "x", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "rule_id string, file string, line int")
    inline = spark.createDataFrame([("src/a.rs", 5, "r1"), ("src/a.rs", 5, "r1")], "file string, line int, rule_id string")
    got = {(r.rule_id, r.file, r.line): r.suppressed_by for r in ops.suppressed(df, inline, [("r2", "src/*.rs"), ("r3", "global"), ("r1", "src/**")]).collect()}
    assert len(got) == 7 and [got[x] for x in rows] == ["inline", "inline", "config", "config", None, "config", None]


def test_fixes_and_notes(spark):
    sources = spark.createDataFrame([("a", "1\n2\n3"), ("b", "x"), ("c", None)], "file string, source string")
    fixes = spark.createDataFrame([("a", 3, None), ("a", 1, "one\nmore"), ("a", 9, "far"), ("z", 1, "y")], "file string, line int, text string")
    assert {r.file: r.source for r in ops.applied_fixes(sources, fixes).collect()} == {"a": "one\nmore\n2", "b": "x", "c": None}
    notes = spark.createDataFrame([("a", 1, "n2"), ("a", 1, "n1"), ("a", 3, "end")], "file string, line int, note string")
    assert {r.file: r.source for r in ops.annotated(sources, notes).collect()}["a"] == "1\nn1\nn2\n2\n3\nend"
    cut = sources.select("file", ops.snippets(F.col("source"), F.lit(1), F.lit(1), 1).alias("s"))
    assert {r.file: r.s for r in cut.collect()} == {"a": "1\n2", "b": "x", "c": None}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_published_costs(spark):
    cpu = costs.cpu_cost(F.lit(1_000_000), limit_ledger=1_000_000_000)
    assert value(spark, cpu["normalized"]) == pytest.approx(0.01) and value(spark, cpu["pressure"]) == pytest.approx(1e-6)
    double = [value(spark, costs.cpu_cost(F.lit(n))["pressure"]) for n in (100_000_000, 200_000_000)]
    assert double[1] == pytest.approx(4 * double[0])
    memory = costs.memory_cost(F.lit(33_554_432))
    assert value(spark, memory["normalized"]) == pytest.approx(0.8) and value(spark, memory["cost"]) == pytest.approx(100 * math.exp(4))


def test_volatility(spark):
    ends = [0, 0.25, 0.26, 0.5, 0.51, 0.75, 0.76, 1.0]
    rows = spark.createDataFrame([(float(x),) for x in ends], "x double").select("x", costs.volatility_level(F.col("x")).alias("l")).collect()
    assert [r.l for r in sorted(rows, key=lambda r: r.x)] == ["Low", "Low", "Moderate", "Moderate", "High", "High", "Extreme", "Extreme"]
    prices = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "p double")
    assert prices.agg(F.stddev_pop("p").alias("s")).first().s == pytest.approx(2)
    index = lambda n, m, s, short: value(spark, costs.volatility_index(F.lit(n), F.lit(m), F.lit(s), F.lit(short)))
    assert index(1, 5.0, 2.0, 5.0) == 0 and index(10, 42.0, 0.0, 42.0) == 0 and index(10, 10.0, 5.0, 20.0) == pytest.approx(0.65) and index(9, 1.0, 9.0, 9.0) == 1


def test_thresholds_of_a_chain_win_over_the_global_ones(spark):
    rows = spark.createDataFrame([(7, 12.0, 0.0), (1, 12.0, 0.0), (7, 12.0, 120.0), (1, 55.0, None)], "chain int, absolute_gwei double, priority_fee_percentage double")
    got = monitors.threshold_levels(rows, "chain", monitors.THRESHOLDS | monitors.CHAIN_THRESHOLDS).collect()
    assert sorted((r.chain, r.absolute_gwei, r.level or "") for r in got) == [(1, 12.0, ""), (1, 55.0, "info"), (7, 12.0, "critical"), (7, 12.0, "info")]


def test_scores_and_versions(spark):
    assert value(spark, costs.z_score(F.lit(5.0), F.lit(1.0), F.lit(0.0))) == 0 and value(spark, costs.z_score(F.lit(5.0), F.lit(1.0), F.lit(2.0))) == 2
    assert [value(spark, costs.band(F.lit(x), 2, 3, 5)) for x in (2.0, 2.1, 3.1, 5.1)] == [None, "low", "medium", "high"]
    meets = lambda v, r: value(spark, costs.satisfies(F.lit(v), r))
    assert meets("10.0.0", ">=9.9.9") and meets("1.9.0", "^1.2.0") and not meets("2.0.0", "^1.2.0") and meets("1.2.9", "~1.2.3") and not meets("1.3.0", "~1.2.3")
