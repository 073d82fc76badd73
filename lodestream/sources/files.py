"""Reading source trees, JSON stores and chunked ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a source tree's walk takes and leaves.
SOURCE_ENDINGS = (".sol", ".vy", ".rs")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "target")


def source_files(spark: SparkSession, root: str, endings: tuple[str, ...] = SOURCE_ENDINGS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """file, source of every file under ``root`` with one of the endings and outside the skipped folders.

    The walk is the engine's own recursive listing; files are read whole, each as one row, where they lie. Folders are
    skipped below ``root`` only: the root itself may lie in a folder of such a name.
    """
    import os
    from urllib.parse import quote, urlparse

    plain = urlparse(root).path if "://" in root else os.path.abspath(root)
    above = quote(plain.rstrip("/"), safe="/!$&'()*+,;=:@~")
    pattern = "*{" + ",".join(endings) + "}"
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    named = rows.select(F.input_file_name().alias("file"), F.col("value").alias("source"))
    below = F.expr("substring(file, locate(above, file) + length(above))")
    inside = named.withColumn("above", F.lit(above)).withColumn("below", below)
    return inside.where(~F.col("below").rlike("/(" + "|".join(x.replace(".", r"\.") for x in skipped) + ")/")).select("file", "source")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ** crosses folders, * does not, everything else stands for itself."""
    import re

    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in parts) + "$"


def path_filter(df: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keep the rows whose path meets an include (all if none is given) and no exclude; a text without * is a part of the path."""
    path = F.col(column)

    def any_of(globs: list[str]):
        hit = F.lit(False)
        for g in globs:
            hit = hit | (path.rlike(glob_pattern(g)) if "*" in g else path.contains(g))
        return hit

    kept = df.where(any_of(include)) if include else df
    return kept.where(~any_of(exclude)) if exclude else kept


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, each an array or an object over many lines; rows that don't parse are all NULL."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def block_chunks(spark: SparkSession, first: int, last: int, width: int = 2000) -> DataFrame:
    """start, stop of the chunks of ``width`` that cover first..last, spread over tasks, for scans that take a range each."""
    starts = spark.range(first, last + 1, width)
    return starts.select(F.col("id").alias("start"), F.least(F.col("id") + width - 1, F.lit(last)).alias("stop"))
