from __future__ import annotations

from fractions import Fraction

import pytest
from conftest import at
from pyspark.sql import functions as F

from lodestream.operators import units


def test_compositions_and_cycles():
    edges = [("c", "k", 1, Fraction("273.15")), ("f", "c", Fraction(5, 9), Fraction(-160, 9))]
    a, b = units.compose(edges, "k")["f"]
    assert float(a * 212 + b) == pytest.approx(373.15)
    with pytest.raises(units.ConversionError):
        units.compose([*edges, ("f", "k", 1, 0)], "k")
    with pytest.raises(units.ConversionError):
        units.compose([("a", "b", 0, 1)], "b")
    assert set(units.compose([("a", "b", 2, 0), ("x", "y", 2, 0)], "b")) == {"a", "b"}


def test_conversion_by_join(spark):
    df = spark.createDataFrame([(1, 2.0, " Gwei", "evm"), (2, 3.0, "XLM", "stellar"), (3, 3.0, "gwei", "stellar"), (4, None, "wei", "evm"), (5, 1.0, None, None)], "id int, v double, u string, f string")
    got = {r.id: r.canonical for r in units.convert(df, "v", "u", "f", units.conversion_table(spark)).collect()}
    assert got == {1: 2e9, 2: 3e7, 3: None, 4: None, 5: None}


CASES = [
    ("amount in Gwei, a swap", 5, "evm", 9), ("recorded as WEI", 5, "evm", 0), ("claim sweep [finney]", 12, "evm", 15), ("12 milliether granted", 12, "evm", 15),
    ("covers 18,024,444WEI of it", 18024444, "evm", 0), ("entspricht 0,017 ETH", 17, "evm", 15), ("worth 0.025549311 ETH for it", 25549311, "evm", 9),
    ("paid out 7.1E-5 ETH", 71, "evm", 12), ("1_5 gwei", 15, "evm", 9), ("18 628 464 gwei granted", 18628464, "evm", 9), ("swap, 1,570,000,000 stroops in total", 157, "stellar", 7),
    ("gas price 104 gwei at inclusion, a swap", 104, "evm", None), ("a swap; priority tip was 1 Gwei", 1, "evm", None), ("x, wallet held 10 ETH before", 10, "evm", None),
    ("x; reserve of 5 XLM untouched", 5, "stellar", None), ("base fee 690 stroops per op, x", 690, "stellar", None), ("lote 2040, swap", 7, "evm", None), (None, 7, "evm", None), ("", 7, "evm", None),
    ("104 lumens " + "z" * 100_000, 104, "stellar", 7), ("5 gwei", 0, "evm", None), ("5 gwei", None, "evm", None), ("amount in wei", 3, "stellar", None),
]


POWER = {r[1]: units._power(Fraction(r[3])) for r in units.conversion_rows()}


def test_units_shown_in_texts(spark):
    df = spark.createDataFrame([(i, t, a, f) for i, (t, a, f, _) in enumerate(CASES)], "i int, text string, amount long, family string")
    got = {r.i: POWER.get(r.shown) for r in units.with_shown_unit(df, "text", "amount", "family", "shown").collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: c[3] for i, c in enumerate(CASES)}


def test_usual_unit_changes_over_time(spark):
    shown = [("r", "evm", at(i * 3600), "wei") for i in range(40)] + [("r", "evm", at((60 + i) * 3600), "gwei") for i in range(40)] + [("q", "evm", at(i * 3600), "gwei" if i % 4 else "wei") for i in range(200)]
    segments = units.usual_units(spark.createDataFrame(shown, "s string, f string, t timestamp, e string"), "s", "f", "t", "e")
    start = 1_704_067_200_000_000
    rows = [("r", "evm", start + h * 3_600_000_000, None) for h in (0, 30, 55, 99)] + [("q", "evm", start, None), ("new", "evm", start, None), (None, "evm", start, None), ("r", "evm", start, "finney")]
    records = spark.createDataFrame(rows, "source string, family string, at_us long, own string")
    got = [(r.source, r.at_us, r.p) for r in units.with_usual(records, segments, "own", "p").collect()]
    by = {(s, (t - start) // 3_600_000_000 if t else t, p) for s, t, p in got}
    wanted = {("r", 0, "wei"), ("r", 30, "wei"), ("r", 55, "gwei"), ("r", 99, "gwei"), ("q", 0, "gwei"), ("new", 0, None), (None, 0, None), ("r", 0, "finney")}
    assert by == wanted and len(got) == 8


def test_amounts_come_through_the_graph(spark):
    # id, source, family, hour, amount, shown unit: shown, usual for the source, canonical by default, unknown family.
    rows = [("a", "s", "evm", 0, 2.0, "gwei"), ("b", "s", "evm", 1, 3.0, None), ("c", None, "stellar", 1, 4.0, None), ("d", "s", None, 1, 5.0, None), ("e", "s", "evm", 1, None, None)]
    records = spark.createDataFrame([("t", i, s, f, h * 3_600_000_000, a, u) for i, s, f, h, a, u in [*rows, rows[0]]], "record_table string, id string, source string, family string, at_us long, amount double, shown string")
    conversions = units.conversion_table(spark)
    got = {r.id: (r.unit, r.exp10, r.canonical_amount) for r in units.canonical_amounts(records, conversions).collect()}
    assert got == {"a": ("gwei", 9, 2e9), "b": ("gwei", 9, 3e9), "c": ("stroop", 0, 4.0), "d": (None, 0, 5.0), "e": ("gwei", 9, None)}
    # Another factor in the graph is another result.
    changed = units.conversion_table(spark, [("gwei", "wei", 7, 1), ("xlm", "stroop", 10**7, 0)])
    assert {r.id: r.canonical_amount for r in units.canonical_amounts(records, changed).collect()}["a"] == 15.0
    assert units.canonical_amounts(records.limit(0), conversions).count() == 0


def test_chain_spellings(spark):
    texts = ["1", " 0x1", "eip155:1", "0x89", "137 ", "stellar-PUBNET", "stellar:pubnet", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(units.canonical_chain(F.col("t")).alias("c")).collect()] == ["1", "1", "1", "137", "137", "stellar:pubnet", "stellar:pubnet", None, None]
