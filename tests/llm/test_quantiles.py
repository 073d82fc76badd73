from __future__ import annotations

import datetime as dt
import random

import numpy as np
from conftest import at

from lodestream.llm import quantiles as q

METRICS = "id string, endpoint string, method string, timestamp timestamp, responseTime long, window string, n int"
AGGREGATES = "id string, endpoint string, method string, aggregationWindow string, timestamp timestamp, p95ResponseTime double, published string"


def metrics(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], METRICS)


def draw(n, seed=1, endpoint="/a", hours=1):
    pick = random.Random(seed)
    return [(f"{endpoint}{seed}-{i}", endpoint, "GET", at(pick.random() * 3600 * hours), int(pick.lognormvariate(5, 0.8))) for i in range(n)]


def test_bounds_hold_the_truth_small_and_large(spark):
    rows = draw(30_000) + draw(7, 2, "/b") + draw(1, 3, "/c")
    got = {(r.endpoint, r.window): r for r in q.endpoint_percentiles(metrics(spark, rows), k=256).collect()}
    assert len(got) == 6
    for (endpoint, _), r in got.items():
        own = [x[4] for x in rows if x[1] == endpoint]
        assert r.n == len(own)
        for name, level in q.LEVELS.items():
            assert r[f"{name}_low"] <= np.percentile(own, level * 100) + 1e-9 and np.percentile(own, level * 100) - 1e-9 <= r[f"{name}_high"]


def test_sketches_far_above_their_size_keep_their_bounds(spark):
    rows = draw(200_000, 5)
    own = [x[4] for x in rows]
    df = metrics(spark, rows).repartition(7)
    for k in (64, q.K):
        (r,) = [x for x in q.endpoint_percentiles(df, k=k).collect() if x.window == "hour"]
        for name, level in q.LEVELS.items():
            low, true, high = r[f"{name}_low"], np.percentile(own, level * 100), r[f"{name}_high"]
            assert low <= true <= high
            # Not wider than the error allows: twice it, in ranks, and what the steps round up.
            width = np.mean([low <= x <= high for x in own])
            assert width <= 2 * q.SURE * q.rank_error(k) * q.STEP + 0.02
    assert abs(q.rank_error() - 0.00138) < 0.00001


def test_small_sketches_are_exact(spark):
    rows = [x for n in [*range(1, 140), 255, 256] for x in draw(n, n, f"/{n}")]
    got = {r.endpoint: r for r in q.endpoint_percentiles(metrics(spark, rows), k=256).where("window = 'hour'").collect()}
    assert len(got) == 141
    for endpoint, r in got.items():
        own = [x[4] for x in rows if x[1] == endpoint]
        for name, level in q.LEVELS.items():
            true = np.percentile(own, level * 100)
            assert r[f"{name}_low"] <= true + 1e-9 and true - 1e-9 <= r[f"{name}_high"]
            assert name == "p99" or abs(r[name] - true) < 1e-6


def test_small_windows_are_decided_by_their_sketches(spark):
    rows = [x for e in range(40) for x in draw(500 + e, e, f"/{e}")]
    df = metrics(spark, rows)
    start, pick = dt.datetime(2024, 1, 1), random.Random(3)
    published = []
    for e in range(40):
        true = float(np.percentile([x[4] for x in rows if x[1] == f"/{e}"], 95))
        published += [(f"{e}-{i}", f"/{e}", "GET", "hour", start, true * pick.uniform(0.8, 1.25), "x") for i in range(20)]
    judged, _ = q.judged_published(spark.createDataFrame(published, AGGREGATES), df)
    verdicts = [r.verdict for r in judged.collect()]
    assert len(verdicts) == 800 and verdicts.count("undecided") == 0


def test_merged_hours_are_days(spark):
    rows = draw(6000, hours=6)
    hours, days = q.endpoint_sketches(metrics(spark, rows), k=4096)
    assert hours.count() == 6 and days.first().n == 6000


def test_repeats_nulls_and_negatives_do_not_count(spark):
    rows = [("1", "/a", "GET", at(0), 10), ("1", "/a", "GET", at(0), 10), ("2", "/a", "GET", at(1), None), ("3", "/a", "GET", at(2), -1), (None, "/a", "GET", at(3), 20), ("4", "/a", "GET", None, 9)]
    got = {r.window: r.n for r in q.endpoint_percentiles(metrics(spark, rows)).collect()}
    assert got == {"hour": 2, "day": 2}
    assert q.endpoint_percentiles(metrics(spark, [])).count() == 0


def test_wrong_figures(spark):
    rows = draw(5000) + draw(40, 2, "/b")
    true = {e: float(np.percentile([x[4] for x in rows if x[1] == e], 95)) for e in ("/a", "/b")}
    start = dt.datetime(2024, 1, 1)
    published, wanted = [], set()
    for i, factor in enumerate([1.0, 1.0999, 1.1001, 0.9001, 0.8999, 3.0, 0.1]):
        for e in true:
            for w in ("hour", "DAY "):
                published.append((f"{e}{i}{w}", e, "GET", w, start, true[e] * factor, "x"))
                if abs(factor - 1) > 0.1:
                    wanted.add(f"{e}{i}{w}")
    published += [("none", "/zzz", "GET", "hour", start, 5.0, "x"), ("null", "/a", "GET", "hour", start, None, "x")]
    df = spark.createDataFrame(published, AGGREGATES)
    # A small sketch, so that many figures must be decided exactly.
    for k in (64, q.K):
        assert {r.id for r in q.wrong_published(df, metrics(spark, rows), k=k).collect()} == wanted
