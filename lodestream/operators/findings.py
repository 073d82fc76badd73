"""Findings as tables: duplicates, suppressions, and their place in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import squeeze

#: Severities from highest to lowest.
RANKS = ["critical", "high", "medium", "low", "info"]


def severity_rank(severity: Column) -> Column:
    """0 for the highest severity; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, RANKS)), F.lower(severity))
    return F.when(place > 0, place - 1).otherwise(len(RANKS))


def deduplicated(findings: DataFrame, strategy: str, detail: str | None = None) -> DataFrame:
    """One row for each set of duplicates: canonical_id, rule_id, file, line, severity, copies.

    ``findings`` has id, rule_id, file, line, severity, message. Findings are duplicates

    - 'exact': if all but the id is equal;
    - 'normalised': if rule, file, line and message are, white space and case aside;
    - 'same_location': if file and line are.

    The canonical one has the highest severity, then the most ``detail`` (a number), then the least id. It is kept by a
    mergeable minimum, so that a place with any number of findings costs a row for each task. NULLs are equal to one
    another.
    """
    keys = {
        "exact": ["rule_id", "file", "line", "severity", "message"],
        "normalised": ["rule_id", "file", "line", "__text"],
        "same_location": ["file", "line"],
    }[strategy]
    rows = findings.withColumn("__text", squeeze(F.col("message")))
    order = F.struct(severity_rank(F.col("severity")), -F.coalesce(F.col(detail), F.lit(0)) if detail else F.lit(0), F.col("id"))
    best = F.min_by(F.struct("id", "rule_id", "file", "line", "severity"), order)
    grouped = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best.alias("b"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(F.col("b.id").alias("canonical_id"), "b.rule_id", "b.file", "b.line", "b.severity", "copies")


def inline_suppressions(sources: DataFrame, prefix: str) -> DataFrame:
    """file, line, rule_id, reason: what comments of the form ``// prefix RULE, RULE -- reason`` suppress.

    ``sources`` has file and source. The prefix counts in any case; a comment without reason says so.
    """
    lines = sources.select("file", F.posexplode(F.split("source", "\n")).alias("k", "t")).where(F.col("t").contains("//"))
    comment = F.trim(F.expr("substring(t, locate('//', t) + 2)"))
    rows = lines.select("file", (F.col("k") + 1).alias("line"), comment.alias("c")).where(F.lower("c").startswith(prefix.lower()))
    parts = F.split(F.trim(F.expr(f"substring(c, {len(prefix) + 1})")), "--", -1)
    reason = F.trim(F.array_join(F.slice(parts, 2, 2**31 - 2), "--"))
    named = rows.select(
        "file", "line", F.explode(F.split(F.get(parts, F.lit(0)), ",")).alias("r"),
        F.when(reason == "", F.lit("No reason provided")).otherwise(reason).alias("reason"),
    )
    return named.select("file", "line", F.trim("r").alias("rule_id"), "reason").where(F.col("rule_id") != "")


def suppressed(findings: DataFrame, inline: DataFrame, scoped: list[tuple[str, str]]) -> DataFrame:
    """Add ``suppressed_by``: 'inline', 'config' or NULL.

    An inline suppression (file, line, rule_id) covers its rule on its own line and the next one; it wins over
    ``scoped`` ones: pairs of a rule and a glob of files ('global' for all). The list is the caller's configuration, so
    it becomes part of the condition; inline suppressions are joined on equality, each under both lines that it covers.
    """
    from lodestream.sources.files import glob_pattern

    marks = inline.select(F.col("file").alias("__f"), F.col("rule_id").alias("__r"), F.explode(F.array("line", F.col("line") + 1)).alias("__l")).distinct()
    same = (F.col("file") == F.col("__f")) & (F.col("rule_id") == F.col("__r")) & (F.col("line") == F.col("__l"))
    config = F.lit(False)
    for rule, glob in scoped:
        config = config | ((F.col("rule_id") == rule) & (F.lit(True) if glob == "global" else F.col("file").rlike(glob_pattern(glob))))
    by = F.when(F.col("__f").isNotNull(), F.lit("inline")).when(config, F.lit("config"))
    return findings.join(marks, same, "left").withColumn("suppressed_by", by).drop("__f", "__r", "__l")


def applied_fixes(sources: DataFrame, fixes: DataFrame) -> DataFrame:
    """file, source with the fixes (file, line, text) applied: a line becomes ``text``, or goes where that is NULL.

    Lines are those of the text before any fix, so their order doesn't matter; of several for a line the least text
    counts, a removal last. A file's fixes meet its text as one map.
    """
    by = fixes.groupBy("file", "line").agg(F.min("text").alias("text")).groupBy("file").agg(F.collect_list(F.struct("line", "text")).alias("fixes"))
    both = sources.join(by, "file", "left")
    found = F.map_from_entries(F.coalesce("fixes", F.array().cast("array<struct<line:int,text:string>>")))
    line = lambda x, i: F.when(F.map_contains_key(found, i + 1), F.try_element_at(found, i + 1)).otherwise(x)
    lines = F.filter(F.transform(F.split("source", "\n"), line), lambda x: x.isNotNull())
    return both.select("file", F.array_join(lines, "\n").alias("source"))


def annotated(sources: DataFrame, notes: DataFrame) -> DataFrame:
    """file, source with each note (file, line, note) on a line of its own under the line it belongs to, several in order."""
    by = notes.groupBy("file", "line").agg(F.array_join(F.array_sort(F.collect_list("note")), "\n").alias("note"))
    by = by.groupBy("file").agg(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "note")).alias("notes"))
    both = sources.join(by, "file", "left")
    found = F.map_from_entries(F.coalesce("notes", F.array().cast("array<struct<line:int,note:string>>")))
    lines = F.transform(F.split("source", "\n"), lambda x, i: F.concat_ws("\n", x, F.try_element_at(found, i + 1)))
    return both.select("file", F.array_join(lines, "\n").alias("source"))


def snippets(source: Column, first: Column, last: Column, context: int) -> Column:
    """Lines first to last of a text with ``context`` lines on either side, as far as there are any."""
    start = F.greatest(first - context, F.lit(1))
    return F.array_join(F.slice(F.split(source, "\n"), start, last + context - start + 1), "\n")
