"""Row and range frames over groups cut into blocks, against plain loops."""

from __future__ import annotations

import random

from conftest import at
from pyspark.sql import functions as F

from lodestream.operators.ordered import newest, numbered, with_frames, with_latest, with_recent

SCHEMA = "k string, t timestamp, i int, x double"


def table(n, seed):
    pick = random.Random(seed)
    return [("hot" if pick.random() < 0.6 else pick.choice("abc"), at(pick.randrange(0, 5 * 86400, 600)), i, float(pick.randint(0, 9))) for i in range(n)]


def test_row_frames(spark):
    rows = table(400, 1)
    frames = {"s": lambda w: F.sum("x").over(w.rowsBetween(-3, -1)), "before": lambda w: F.lag("i").over(w)}
    plain = {}
    for k in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == k)
        for j, r in enumerate(own):
            last = own[max(0, j - 3) : j]
            plain[r[2]] = (j, sum(x[3] for x in last) if last else None, own[j - 1][2] if j else None)
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (1, 4, 7, 1000):
        got = {r.i: (r.at_row, r.s, r.before) for r in with_frames(df, ["k"], ["t", "i"], 3, frames, block).collect()}
        assert got == plain
    assert with_frames(df.limit(0), ["k"], ["t", "i"], 3, frames).count() == 0


def test_recent_rows(spark):
    rows = table(300, 2) + [("a", None, 999, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for reach in (600, 7200, 3 * 86400):
        got = {r.i: r.n for r in with_recent(df, ["k"], "t", reach * 1_000_000, {"n": lambda w: F.count(F.lit(1)).over(w)}).collect()}
        near = lambda a, b: a[1] is None and b[1] is None or a[1] and b[1] and 0 <= (a[1] - b[1]).total_seconds() <= reach  # noqa: E731, B023
        assert got == {r[2]: sum(1 for o in rows if o[0] == r[0] and near(r, o)) for r in rows}


def test_places_and_latest_values(spark):
    rows = table(300, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    some = F.when(F.col("x") > 6, F.col("i"))
    latest = {r.i: r.v for r in with_latest(df, ["k"], ["t", "i"], some, "v").collect()}
    places = {r.i: (r.at_row, r.all_row) for r in numbered(df, ["k"], ["t", "i"]).collect()}
    for k in {r[0] for r in rows}:
        own, last = sorted(r for r in rows if r[0] == k), None
        for j, r in enumerate(own):
            last = r[2] if r[3] > 6 else last
            assert latest[r[2]] == last and places[r[2]] == (j, len(own))


def test_newest(spark):
    rows = table(300, 3)
    got = {(r.k, r.i) for r in newest(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "i", 5).collect()}
    assert got == {(k, r[2]) for k in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[-5:]}
