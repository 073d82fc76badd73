"""Kinds of source detectors, each one array column of hits for a text; all run in one pass inside the JVM.

A detector reads the columns ``source`` and ``lines`` of a file and gives an array of hits (line, message). Patterns are
Java regular expressions. Line breaks are "\\n"; lines are numbered from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<line:int,message:string>>"


@dataclass(frozen=True)
class Detector:
    """One rule: its id, severity, message, the files it looks at (endings; none for all) and what it looks for."""

    rule_id: str
    severity: str
    find: Callable[[str], Column]
    message: str = ""
    savings: int | None = None
    endings: tuple[str, ...] = field(default=())


def kind(make: Callable) -> Callable:
    """A search remembers what it was made of, as (name, arguments, named arguments), for checks that restate it."""

    @wraps(make)
    def made(*args, **named):
        find = make(*args, **named)
        find.made_of = (make.__name__, args, named)
        return find

    return made


def _hit(line: Column, message) -> Column:
    return F.struct(line.cast("int").alias("line"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _none() -> Column:
    return F.array().cast(HITS)


def _kept(hits: Column) -> Column:
    return F.filter(hits, lambda h: h.isNotNull())


def _tests(line: Column, has: list[str], lacks: list[str]) -> Column:
    test = F.lit(True)
    for p in has:
        test = test & line.rlike(p)
    for p in lacks:
        test = test & ~line.rlike(p)
    return test


@kind
def on_lines(*has: str, lacks: tuple[str, ...] = (), named: str | None = None, not_among: str | None = None) -> Callable[[str], Column]:
    """Every line that matches all of ``has`` and none of ``lacks``.

    ``named`` is a pattern whose first group, found in the line, replaces {} in the message. A line whose name is among
    those that ``not_among`` (its first group) finds in the whole text doesn't count.
    """

    def find(message: str) -> Column:
        def hit(line: Column, i: Column) -> Column:
            test, text = _tests(line, list(has), list(lacks)), F.lit(message)
            if named is not None:
                text = F.replace(text, F.lit("{}"), F.regexp_extract(line, named, 1))
            if not_among is not None:
                others = F.regexp_extract_all("source", F.lit(not_among), F.lit(1))
                test = test & ~F.array_contains(others, F.regexp_extract(line, named, 1))
            return F.when(test, _hit(i + 1, text))

        return _kept(F.transform("lines", hit))

    return find


@kind
def on_code_lines(*has: str, lacks: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """As :func:`on_lines`, but outside comments: lines that begin with // and, whole, those of a block comment."""

    def find(message: str) -> Column:
        start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("code"))

        def step(a: Column, line: Column) -> Column:
            body = F.trim(line)
            inside = a["inside"] | body.startswith("/*")
            return F.struct((inside & ~body.contains("*/")).alias("inside"), F.array_append(a["code"], ~inside & ~body.startswith("//")).alias("code"))

        code = F.reduce("lines", start, step, lambda a: a["code"])
        rows = F.zip_with("lines", code, lambda line, is_code: F.when(is_code & _tests(line, list(has), list(lacks)), True))
        return _kept(F.transform(rows, lambda x, i: F.when(x, _hit(i + 1, message))))

    return find


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


@kind
def anywhere(pattern: str, group: int | None = None) -> Callable[[str], Column]:
    """Every match of ``pattern`` in the whole text, at the line where it begins; ``group`` of it replaces {} in the message."""

    def find(message: str) -> Column:
        found, between = F.regexp_extract_all("source", F.lit(pattern), F.lit(0)), F.split("source", pattern, -1)
        names = F.regexp_extract_all("source", F.lit(pattern), F.lit(group)) if group is not None else found
        start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("at"))

        def step(a: Column, pair: Column) -> Column:
            line = a["line"] + _breaks(pair["b"])
            return F.struct((line + F.coalesce(_breaks(pair["f"]), F.lit(0))).alias("line"), F.array_append(a["at"], line).alias("at"))

        at = F.reduce(F.arrays_zip(found.alias("f"), F.slice(between, F.lit(1), F.size(found)).alias("b")), start, step, lambda a: a["at"])
        return F.zip_with(at, names, lambda line, name: _hit(line, F.replace(F.lit(message), F.lit("{}"), name)))

    return find


@kind
def first_line(*has: str, lacks: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """One hit, at line 1, for a text that matches all of ``has`` and none of ``lacks``."""

    def find(message: str) -> Column:
        return F.when(_tests(F.col("source"), list(has), list(lacks)), F.array(_hit(F.lit(1), message))).otherwise(_none())

    return find


@kind
def near(
    *has: str, lacks: tuple[str, ...] = (), before: int = 0, lines: int | None = 1, need: str | None = None, unless: str | None = None, more_than: int = 0
) -> Callable[[str], Column]:
    """Lines as in :func:`on_lines` whose neighbourhood matches ``need`` more than so many times, and doesn't match ``unless``.

    The neighbourhood has so many ``lines``, from ``before`` lines above (or from the first; below, if negative); without
    a number, those up to the line before.
    """

    def find(message: str) -> Column:
        def hit(line: Column, i: Column) -> Column:
            start = F.greatest(i + 1 - before, F.lit(1))
            around = F.array_join(F.slice("lines", start, F.lit(lines) if lines is not None else i + 1 - start), "\n")
            test = _tests(line, list(has), list(lacks))
            if need is not None:
                test = test & (F.regexp_count(around, F.lit(need)) > more_than)
            if unless is not None:
                test = test & ~around.rlike(unless)
            return F.when(test, _hit(i + 1, message))

        return _kept(F.transform("lines", hit))

    return find


@kind
def only_if(find: Callable[[str], Column], *has: str, lacks: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """The hits of ``find`` in texts that, as a whole, match all of ``has`` and none of ``lacks``."""
    return lambda message: F.when(_tests(F.col("source"), list(has), list(lacks)), find(message)).otherwise(_none())


def only_first(find: Callable[[str], Column]) -> Callable[[str], Column]:
    return lambda message: F.slice(find(message), 1, 1)


def repeated(pattern: str) -> Callable[[str], Column]:
    """Names (the first group of ``pattern``, one a line) that come on several lines: a hit on the first for each."""

    def find(message: str) -> Column:
        names = F.transform("lines", lambda line: F.regexp_extract(line, pattern, 1))
        again = F.filter(F.array_distinct(names), lambda n: (n != "") & (F.size(F.filter(names, lambda m: m == n)) > 1))
        return F.transform(again, lambda n: _hit(F.array_position(names, n), F.replace(F.lit(message), F.lit("{}"), n)))

    return find


def nested_loops(head: str) -> Callable[[str], Column]:
    """Lines with the head of a loop inside another; {} in the message is the depth. Braces tell where loops end."""

    def find(message: str) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("loops"), F.array().cast("array<int>").alias("at"))

        def step(a: Column, line: Column) -> Column:
            is_head = line.rlike(head)
            loops = a["loops"] + F.when(is_head, 1).otherwise(0)
            depth = (a["depth"] + F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))).cast("int")
            left = F.greatest(F.least(loops, depth + 1), F.lit(0)).cast("int")
            return F.struct(depth.alias("depth"), left.alias("loops"), F.array_append(a["at"], F.when(is_head, loops)).alias("at"))

        depths = F.reduce("lines", start, step, lambda a: a["at"])
        return _kept(F.transform(depths, lambda d, i: F.when(d > 1, _hit(i + 1, F.replace(F.lit(message), F.lit("{}"), d.cast("string"))))))

    return find


def scored(signals: list[tuple[float, Callable[[], Column]]], threshold: float) -> Callable[[str], Column]:
    """One hit, at line 1, for a text whose signals' weights sum up to ``threshold``."""

    def find(message: str) -> Column:
        score = sum((F.when(test(), F.lit(weight)).otherwise(0.0) for weight, test in signals), F.lit(0.0))
        return F.when(score >= threshold, F.array(_hit(F.lit(1), message))).otherwise(_none())

    return find


def topics(publish: str, most: int, large: str) -> Callable[[str], Column]:
    """Calls that match ``publish`` whose first parenthesised argument has more than ``most`` elements, or matches ``large``."""

    def find(message: str) -> Column:
        rests = F.slice(F.split("source", publish, -1), 2, 2**31 - 2)
        lines = anywhere(publish)("")

        def hit(rest: Column, at: Column) -> Column:
            start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("angle"), F.lit(0).alias("commas"), F.lit(0).alias("n"), F.lit(0).alias("end"))

            def step(a: Column, c: Column) -> Column:
                open_ = a["end"] == 0
                depth = a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
                angle = a["angle"] + F.when((c == "<") & (a["depth"] > 0), 1).when((c == ">") & (a["depth"] > 0), -1).otherwise(0)
                comma = open_ & (c == ",") & (a["depth"] == 1) & (a["angle"] == 0)
                n = a["n"] + 1
                closed = open_ & (c == ")") & (depth == 0)
                return F.struct(
                    F.when(open_, depth).otherwise(a["depth"]).alias("depth"), F.when(open_, angle).otherwise(a["angle"]).alias("angle"),
                    (a["commas"] + F.when(comma, 1).otherwise(0)).alias("commas"), n.alias("n"), F.when(closed, n).otherwise(a["end"]).alias("end"),
                )

            a = F.reduce(F.regexp_extract_all(rest, F.lit("[(),<>]"), F.lit(0)), start, step)
            inner = F.array_join(F.slice(F.split(rest, "[(),<>]", -1), F.lit(1), F.greatest(a["end"], F.lit(1))), ",")
            tuple_ = F.regexp_replace(inner, r"^[^,]*,", "")
            count = F.when(F.trim(F.replace(tuple_, F.lit(","), F.lit(""))) == "", 0).otherwise(a["commas"] + 1)
            many, big = count > most, tuple_.rlike(large)
            reason = F.when(many & big, F.lit(f"topic count exceeds {most}; topics contain large payload types")).when(many, F.lit(f"topic count exceeds {most}"))
            text = F.replace(F.lit(message), F.lit("{}"), F.coalesce(reason, F.lit("topics contain large payload types")))
            return F.when((a["end"] > 0) & (many | big), _hit(at["line"], text))

        return _kept(F.zip_with(rests, lines, hit))

    return find


def until_next(head: str, stop: str, unless: str, most: int = 300) -> Callable[[str], Column]:
    """Matches of ``head`` (its first group is the name, for {}) whose text up to the next ``stop`` doesn't match ``unless``.

    Where nothing stops it, the text is ``most`` characters long.
    """

    def find(message: str) -> Column:
        found, between = F.regexp_extract_all("source", F.lit(head), F.lit(0)), F.split("source", head, -1)
        names, lines = F.regexp_extract_all("source", F.lit(head), F.lit(1)), anywhere(head)("")

        def hit(i: Column) -> Column:
            # Pieces and matches alternate; the text goes on through those behind.
            rest = F.array_join(F.flatten(F.zip_with(F.slice(found, i, F.size(found)), F.slice(between, i + 1, F.size(found)), lambda f, b: F.array(f, b))), "")
            stopped = F.regexp_extract(rest, f"(?s)^.{{5}}.*?(?={stop})", 0)
            own = F.when(stopped != "", stopped).otherwise(F.substring(rest, 1, most))
            return F.when(~own.rlike(unless), _hit(F.get(lines, i - 1)["line"], F.replace(F.lit(message), F.lit("{}"), F.get(names, i - 1))))

        return F.when(F.size(found) > 0, _kept(F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), hit))).otherwise(_none())

    return find


def in_loops(head: str, *has: str, lacks: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """Lines as in :func:`on_lines` between the braces of a loop, whose head matches ``head``; a head's own line counts."""

    def find(message: str) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("base"), F.array().cast("array<boolean>").alias("in"))

        def step(a: Column, line: Column) -> Column:
            base = F.when(line.rlike(head), a["depth"]).otherwise(a["base"])
            depth = a["depth"] + F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))
            base = F.when(depth > base, base)
            return F.struct(depth.cast("int").alias("depth"), base.alias("base"), F.array_append(a["in"], base.isNotNull()).alias("in"))

        inside = F.reduce("lines", start, step, lambda a: a["in"])
        rows = F.zip_with("lines", inside, lambda line, x: F.when(x & _tests(line, list(has), list(lacks)), True))
        return _kept(F.transform(rows, lambda x, i: F.when(x, _hit(i + 1, message))))

    return find


def bodies(head: str, *has: str, lacks: tuple[str, ...] = (), fallback: int = 400) -> Callable[[str], Column]:
    """Functions whose head matches ``head`` (its first group is the name, for {} in the message) by what their text matches.

    A function reaches from its head to the brace that closes it, or over ``fallback`` characters where none does.
    """

    def find(message: str) -> Column:
        found, between = F.regexp_extract_all("source", F.lit(head), F.lit(0)), F.split("source", head, -1)
        names = F.regexp_extract_all("source", F.lit(head), F.lit(1))
        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("line"), F.array().cast("array<struct<at:int,line:int>>").alias("all"))

        def step(a: Column, pair: Column) -> Column:
            at, line = a["at"] + F.length(pair["b"]), a["line"] + _breaks(pair["b"])
            here = F.struct(at.cast("int").alias("at"), line.cast("int").alias("line"))
            return F.struct((at + F.length(pair["f"])).cast("int").alias("at"), (line + _breaks(pair["f"])).cast("int").alias("line"), F.array_append(a["all"], here).alias("all"))

        places = F.reduce(F.arrays_zip(found.alias("f"), F.slice(between, F.lit(1), F.size(found)).alias("b")), start, step, lambda a: a["all"])

        def hit(place: Column, name: Column) -> Column:
            rest = F.substring("source", place["at"], F.lit(2**31 - 1))
            zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

            def brace(a: Column, b: Column) -> Column:
                depth, n = a["depth"] + F.when(b == "{", 1).otherwise(-1), a["n"] + 1
                closed = (a["end"] == 0) & (depth == 0) & (b == "}")
                return F.struct(depth.alias("depth"), n.alias("n"), F.when(closed, n).otherwise(a["end"]).alias("end"))

            end = F.reduce(F.regexp_extract_all(rest, F.lit("[{}]"), F.lit(0)), zero, brace, lambda a: a["end"])
            pieces = F.split(rest, "[{}]", -1)
            # The text up to the closing brace: its pieces, and a mark for each brace between them.
            own = F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(end, F.lit(1))), "{")).otherwise(F.substring(rest, 1, fallback))
            return F.when(_tests(own, list(has), list(lacks)), _hit(place["line"], F.replace(F.lit(message), F.lit("{}"), name)))

        return _kept(F.zip_with(places, names, hit))

    return find


@kind
def several(*finds: tuple[Callable[[str], Column], str]) -> Callable[[str], Column]:
    """The hits of several searches, each with its own message."""
    return lambda _: F.concat(*[find(message) for find, message in finds])


def _reporter(d: Detector) -> Callable[[Column], Column]:
    """The function from a hit to the detector's finding."""

    def report(h: Column) -> Column:
        return F.struct(
            F.lit(d.rule_id).alias("rule_id"), F.lit(d.severity).alias("severity"), h["line"].alias("line"), h["message"].alias("message"),
            F.lit(d.savings).cast("int").alias("savings"),
        )

    return report


def run(files: DataFrame, detectors: list[Detector]) -> DataFrame:
    """The findings of ``detectors`` on files (columns file, source): rule_id, severity, file, line, message, savings.

    One scan for all; a file goes only to detectors of its ending. NULL sources have no findings; other columns are
    ignored.
    """
    base = files.select(F.col("file").cast("string").alias("file"), "source").where(F.col("source").isNotNull())
    base = base.withColumn("lines", F.split("source", "\n", -1))
    found = []
    for d in detectors:
        mine = F.lit(not d.endings)
        for ending in d.endings:
            mine = mine | F.col("file").endswith(ending)
        found.append(F.transform(F.when(mine, d.find(d.message)).otherwise(_none()), _reporter(d)))
    rows = base.select("file", F.explode(F.flatten(F.array(*found))).alias("f"))
    return rows.select("f.rule_id", "f.severity", "file", "f.line", "f.message", "f.savings")
