"""Writing results: delimited exports, findings as SARIF, keyed overwrites and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SARIF levels of severities, and the standard's version and schema.
SARIF_LEVELS = {"critical": "error", "high": "error", "error": "error", "medium": "warning", "warning": "warning", "low": "note", "info": "note"}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def fixed(column, digits: int):
    """A number as text with just so many decimals, rounded by its exact value; NULL as an empty text."""
    x = column.cast("double")
    text = F.when(F.isnan(x), F.lit("NaN")).otherwise(F.translate(F.format_number(x, digits), ",", ""))
    return F.when(x.isNotNull(), text).otherwise("")


def csv_line(cells: list) -> Column:
    """A line of comma-separated cells: quoted where they hold a comma, quote or line break, quotes doubled; NULL is empty."""
    quoted = [F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """A folder of CSV files with a header each; fields are quoted where they must be, quotes doubled."""
    rows = df.select(*[fixed(F.col(c), decimals[c]).alias(c) if c in (decimals or {}) else F.col(c) for c in df.columns])
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def sarif_result() -> Column:
    """A finding (columns rule_id, severity, message, file, line) as a SARIF result."""
    level = F.create_map(*[F.lit(x) for pair in SARIF_LEVELS.items() for x in pair])
    region = F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("rule_id").alias("ruleId"), F.coalesce(level[F.lower("severity")], F.lit("none")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
    )


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """One row, column ``sarif``: the findings (rule_id, severity, message, file, line) as a SARIF log for each file.

    A log holds one file's results, so no row gathers more than a file; a reader takes the rows as so many runs.
    """
    rows = findings.withColumn("r", sarif_result())
    grouped = rows.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("line", F.to_json("r").alias("j"), "r"))).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("ids")
    )
    rules = F.transform("ids", lambda i: F.struct(i.alias("id")))
    run = F.struct(
        F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"),
        F.transform("rs", lambda x: x["r"]).alias("results"),
    )
    log = F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))
    return grouped.select("file", F.to_json(log).alias("sarif"))


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Write Parquet by day; only the days that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retained(df: DataFrame, time: str, cutoff: str, key: list[str] | None = None, newest: int | None = None) -> DataFrame:
    """The rows at or after ``cutoff`` and, if asked, of each key only the ``newest``; rows without time are kept.

    Ties in time are broken by the rows' other columns, so that the same rows stay whenever it runs.
    """
    kept = df.where(F.col(time).isNull() | (F.col(time) >= F.lit(cutoff).cast("timestamp")))
    if key and newest:
        from pyspark.sql import Window

        order = Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), F.xxhash64(*df.columns))
        kept = kept.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= newest).drop("__k")
    return kept
