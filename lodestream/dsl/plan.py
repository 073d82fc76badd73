"""Rules as Spark columns: every condition is one array of matches for each file, computed without leaving the JVM."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.dsl.language import Both, Either, Neither, Predicate, Rule

#: One match of a condition, and one finding of a rule.
MATCH = "array<struct<line:int,column:int,snippet:string>>"
FINDING = ("rule_id", "severity", "message", "file", "line", "column", "suggestion")
#: The file name endings of each language.
ENDINGS = {"solidity": (".sol",), "rust": (".rs",), "vyper": (".vy", ".vyper")}


def lines_of(source: Column) -> Column:
    """The lines of a text: a final line break ends the last line, a carriage return before a break is dropped."""
    body = F.regexp_replace(source, r"\r?\n$", "")
    return F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def _match(line, column, snippet) -> Column:
    number = lambda x: (F.lit(x) if x is None or isinstance(x, int) else x).cast("int")
    return F.struct(number(line).alias("line"), number(column).alias("column"), snippet.alias("snippet"))


def _none() -> Column:
    return F.array().cast(MATCH)


def _once(condition: Column, snippet: Column, line=1) -> Column:
    return F.when(condition, F.array(_match(line, None, snippet))).otherwise(_none())


def _first_per_line(pattern: str) -> Column:
    def hit(line: Column, i: Column) -> Column:
        start = F.regexp_instr(line, F.lit(pattern))
        column = F.octet_length(line.substr(F.lit(1), start - 1)) + 1
        return F.when(line.rlike(pattern), _match(i + 1, column, F.regexp_extract(line, pattern, 0)))

    return F.filter(F.transform("lines", hit), lambda m: m.isNotNull())


def _all_per_line(pattern: str) -> Column:
    def hits(line: Column, i: Column) -> Column:
        found, between = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern, -1)
        size = lambda parts, n: F.octet_length(F.array_join(F.slice(parts, F.lit(1), n), ""))
        return F.transform(found, lambda x, k: _match(i + 1, size(between, k + 1) + size(found, k) + 1, x))

    return F.flatten(F.transform("lines", hits))


def _depth(threshold: int) -> Column:
    steps = F.flatten(
        F.transform(
            "lines",
            lambda line, i: F.transform(
                F.regexp_extract_all(line, F.lit("[{}]"), F.lit(0)), lambda b: F.struct((i + 1).alias("line"), F.when(b == "{", 1).otherwise(-1).alias("by"))
            ),
        )
    )
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"), F.lit(1).alias("line"))

    def step(a: Column, s: Column) -> Column:
        now = a["now"] + s["by"]
        higher = now > a["top"]
        return F.struct(now.alias("now"), F.when(higher, now).otherwise(a["top"]).alias("top"), F.when(higher, s["line"]).otherwise(a["line"]).alias("line"))

    return F.reduce(steps, start, step, lambda a: _once(a["top"] > threshold, F.format_string(f"max nesting depth %d (threshold: {threshold})", a["top"]), a["line"]))


def _predicate(p: Predicate) -> Column:
    arg = p.args[0] if p.args else None
    word = rf"(?U)\b\Q{arg}\E\b"
    if p.name in ("contains_pattern", "matches_regex"):
        return _first_per_line(f"(?U){arg}")
    if p.name == "has_keyword":
        return _first_per_line(word)
    if p.name == "identifier_matches":
        return _all_per_line(rf"(?U)\b{arg}\b")
    if p.name == "lacks_keyword":
        return _once(~F.col("source").rlike(word), F.lit(f"keyword '{arg}' not found"))
    if p.name == "line_count_exceeds":
        return _once(F.size("lines") > arg, F.format_string(f"%d lines (threshold: {arg})", F.size("lines")))
    if p.name == "function_count_exceeds":
        count = F.regexp_count("source", F.lit(r"(?U)\b(fn|function|def)\s+\w+"))
        return _once(count > arg, F.format_string(f"%d functions (threshold: {arg})", count))
    if p.name == "comment_ratio_below":
        comments = F.size(F.filter("lines", lambda x: x.rlike(r"^\s*(//|#|/\*|\*)")))
        ratio = comments / F.nullif(F.size("lines"), F.lit(0))
        return _once(F.coalesce(ratio < float(arg), F.lit(False)), F.format_string(f"comment ratio %.2f < threshold {float(arg):.2f}", ratio))
    if p.name == "nesting_depth_exceeds":
        return _depth(arg)
    return _once(F.lit(p.name == "always"), F.lit("always"))


def compile_condition(condition) -> Column:
    """A condition as an array of matches over the columns ``source`` and ``lines``; an empty array is false.

    'and' gives the matches of both sides if both have any, 'or' those of the left side if it has any and else those of
    the right, 'not' one match at line 1.
    """
    if isinstance(condition, Predicate):
        return _predicate(condition)
    if isinstance(condition, Neither):
        return _once(F.size(compile_condition(condition.inner)) == 0, F.lit("not-condition satisfied"))
    left, right = compile_condition(condition.left), compile_condition(condition.right)
    if isinstance(condition, Either):
        return F.when(F.size(left) > 0, left).otherwise(right)
    assert isinstance(condition, Both)
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(left, right)).otherwise(_none())


def _patterns(condition) -> list[str]:
    if isinstance(condition, Predicate):
        return [condition.args[0]] if condition.name in ("contains_pattern", "matches_regex", "identifier_matches") else []
    if isinstance(condition, Neither):
        return _patterns(condition.inner)
    return _patterns(condition.left) + _patterns(condition.right)


def usable(rule: Rule, spark: SparkSession) -> bool:
    """Whether the engine that runs the rule's patterns can compile them; a rule with one that it can't finds nothing."""
    engine = spark.sparkContext._jvm.java.util.regex.Pattern
    try:
        for pattern in _patterns(rule.condition):
            engine.compile(rf"(?U)\b{pattern}\b")
    except IllegalArgumentException:
        return False
    return True


def _rendered(template: str | None, match: Column) -> Column:
    text = F.lit(template)
    for mark, value in (("{line}", match["line"].cast("string")), ("{file}", F.col("file")), ("{snippet}", match["snippet"])):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return text


def _reporter(rule: Rule):
    """The function from a match to the rule's finding."""

    def report(m: Column) -> Column:
        return F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), _rendered(rule.message, m).alias("message"),
            m["line"].alias("line"), m["column"].alias("column"), _rendered(rule.suggestion, m).alias("suggestion"),
        )

    return report


def run_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """The findings of all rules on all files (columns file, source): the columns of FINDING, one row for each match.

    A rule looks at files of its language by their name's ending, 'any' at those of all three. Every rule reads the same
    split lines; all rules share one scan. NULL sources have no findings; columns other than the two are ignored.
    """
    base = files.select(F.col("file").cast("string").alias("file"), "source").where(F.col("source").isNotNull())
    base = base.withColumn("lines", lines_of(F.col("source")))
    found = []
    for rule in [r for r in rules if usable(r, files.sparkSession)]:
        endings = [e for language, es in ENDINGS.items() if rule.language in ("any", language) for e in es]
        mine = F.lit(False)
        for ending in endings:
            mine = mine | F.col("file").endswith(ending)
        matches = F.when(mine, compile_condition(rule.condition)).otherwise(_none())
        found.append(F.transform(matches, _reporter(rule)))
    empty = "array<struct<rule_id:string,severity:string,message:string,line:int,column:int,suggestion:string>>"
    everything = F.flatten(F.array(*found)) if found else F.array().cast(empty)
    rows = base.select("file", F.explode(everything).alias("f"))
    return rows.select("f.rule_id", "f.severity", "f.message", "file", "f.line", "f.column", "f.suggestion")
