from __future__ import annotations

import pytest

from lodestream.dsl import RuleError, parse_rules, run_rules


def rule(condition, **fields):
    base = {"name": '"n"', "description": '"d"', "severity": "error", "message": '"at {line}: {snippet}"'} | fields
    return "rule r { " + " ".join(f"{k}: {v}" for k, v in base.items()) + f" when {{ {condition} }} }}"


def find(spark, text, source, file="a.rs"):
    rows = run_rules(spark.createDataFrame([(file, source)], "file string, source string"), parse_rules(text)).collect()
    return [(r.line, r.column, r.message) for r in rows]


@pytest.mark.parametrize(
    "condition, source, wanted",
    [
        ('contains_pattern("unsafe")', "fn main() { unsafe { } }", [(1, 13, "at 1: unsafe")]),
        ('contains_pattern("unsafe")', "fn main() { }", []),
        ('contains_pattern("a") and contains_pattern("b")', "a\nb", [(1, 1, "at 1: a"), (2, 1, "at 2: b")]),
        ('contains_pattern("a") and contains_pattern("z")', "a\nb", []),
        ('contains_pattern("a") or contains_pattern("b")', "a\nb", [(1, 1, "at 1: a")]),
        ('not contains_pattern("require")', "x", [(1, None, "at 1: not-condition satisfied")]),
        ('has_keyword("loop")', "looping { }", []),
        ('has_keyword("loop")', "é loop", [(1, 4, "at 1: loop")]),
        ('identifier_matches("x[0-9]")', "x1 = x2\r\nx3", [(1, 1, "at 1: x1"), (1, 6, "at 1: x2"), (2, 1, "at 2: x3")]),
        ("nesting_depth_exceeds(3)", "fn a() { { {\n{ } } } }", [(2, None, "at 2: max nesting depth 4 (threshold: 3)")]),
        ("line_count_exceeds(2)", "a\nb\n", []),
        ("line_count_exceeds(1)", "a\nb\n", [(1, None, "at 1: 2 lines (threshold: 1)")]),
        ("comment_ratio_below(0.6)", "// a\nb", [(1, None, "at 1: comment ratio 0.50 < threshold 0.60")]),
        ("comment_ratio_below(0.6)", "", []),
        ("function_count_exceeds(1)", "fn a() fn b()", [(1, None, "at 1: 2 functions (threshold: 1)")]),
        ('lacks_keyword("x")', "y", [(1, None, "at 1: keyword 'x' not found")]),
        ("true and not false", "y", [(1, None, "at 1: always"), (1, None, "at 1: not-condition satisfied")]),
        ('contains_pattern("(")', "(", []),
        ('contains_pattern("z+")', "z" * 200_000, [(1, 1, "at 1: " + "z" * 200_000)]),
    ],
)
def test_conditions(spark, condition, source, wanted):
    assert find(spark, rule(condition), source) == wanted


@pytest.mark.parametrize("pattern, lines", [(r"(?P<x>fn)", []), (r"\\p{Lu}", [1]), (r"(?<x>fn)", [1]), ("[", [])])
def test_patterns_are_tried_by_the_engine_that_runs_them(spark, pattern, lines):
    good = rule('contains_pattern("main")').replace("rule r ", "rule good ")
    rows = run_rules(spark.createDataFrame([("a.rs", "fn main() { A }")], "file string, source string"), parse_rules(rule(f'contains_pattern("{pattern}")') + good)).collect()
    assert [r.line for r in rows if r.rule_id == "r"] == lines and [r.line for r in rows if r.rule_id == "good"] == [1]


def test_language_and_null_source(spark):
    text = rule('contains_pattern("a")', language="solidity")
    assert find(spark, text, "a", "x.rs") == [] and len(find(spark, text, "a", "x.sol")) == 1
    assert find(spark, text, None, "x.sol") == []


@pytest.mark.parametrize(
    "text, says",
    [
        (rule('does_not_exist("x")'), "does_not_exist"),
        (rule("always(1)"), "always"),
        (rule("line_count_exceeds(1.5)"), "whole"),
        ("rule r { name: \"n\" }", "description"),
        (rule("true", severity="bad"), "critical"),
        (rule("true") + " rule", "word"),
        (rule("true", name='"a" name: "b"'), "twice"),
        ("rule r { # }", "unexpected"),
    ],
)
def test_errors_name_the_fault(text, says):
    with pytest.raises(RuleError, match=says):
        parse_rules(text)
