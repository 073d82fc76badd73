from __future__ import annotations

import json

from conftest import at

from lodestream.sources import files, sinks


def test_source_tree(spark, tmp_path):
    for name in ("a.sol", "b/c.rs", "b/node_modules/x.rs", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("line one\nline two\n")
    rows = files.source_files(spark, str(tmp_path)).collect()
    assert sorted(r.file.rpartition("/")[2] for r in rows) == ["a.sol", "c.rs"] and rows[0].source == "line one\nline two\n"


def test_a_root_inside_a_skipped_folder(spark, tmp_path):
    for name in ("build/my tree/a.sol", "build/my tree/dist/b.sol"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = files.source_files(spark, str(tmp_path / "build" / "my tree")).collect()
    assert [r.file.rpartition("/")[2] for r in rows] == ["a.sol"]


def test_ties_in_retention(spark):
    df = spark.createDataFrame([("a", at(0), i) for i in range(50)], "k string, t timestamp, i int")
    one = {tuple(sinks.retained(df.repartition(n), "t", "2024-01-01", ["k"], 3).sort("i").select("i").toPandas().i) for n in (1, 3, 7)}
    assert len(one) == 1


def test_globs(spark):
    df = spark.createDataFrame([("src/a.rs",), ("src/deep/b.rs",), ("test/a.rs",)], "p string")
    keep = lambda **k: sorted(r.p for r in files.path_filter(df, "p", **k).collect())
    assert keep(include=["src/*.rs"]) == ["src/a.rs"] and keep(include=["src/**"]) == ["src/a.rs", "src/deep/b.rs"]
    assert keep(include=["a.rs"], exclude=["test"]) == ["src/a.rs"] and len(keep()) == 3


def test_chunks(spark):
    assert sorted(map(tuple, files.block_chunks(spark, 5, 4500).collect())) == [(5, 2004), (2005, 4004), (4005, 4500)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all', 1.23456), (2, None, None)], "i int, t string, x double")
    sinks.write_csv(df, str(tmp_path / "o"), {"x": 4})
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "o")).collect()
    assert sorted((r.i, r.t, r.x) for r in back) == [("1", 'say "hi", all', "1.2346"), ("2", None, None)]


def test_sarif(spark):
    rows = [("r1", "high", "m1", "a.rs", 3), ("r2", "info", "m2", "a.rs", 1), ("r1", "low", "m3", "b.rs", None)]
    logs = {r.file: json.loads(r.sarif) for r in sinks.sarif(spark.createDataFrame(rows, "rule_id string, severity string, message string, file string, line int"), "t").collect()}
    run = logs["a.rs"]["runs"][0]
    assert logs["a.rs"]["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2"]
    assert [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]] == [("r2", "note", 1), ("r1", "error", 3)]


def test_retention_and_days(spark, tmp_path):
    df = spark.createDataFrame([("a", at(i * 86400)) for i in range(5)] + [("b", None)], "k string, t timestamp")
    assert sinks.retained(df, "t", "2024-01-03", ["k"], 2).count() == 3
    days = df.selectExpr("k", "to_date(t) as day")
    sinks.overwrite_days(days, str(tmp_path / "d"), "day")
    sinks.overwrite_days(days.where("day = '2024-01-01'").selectExpr("'z' as k", "day"), str(tmp_path / "d"), "day")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["a", "a", "a", "a", "b", "z"]
