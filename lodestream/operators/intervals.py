"""Overlapping and gapped time intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import with_next

#: Rows are first merged within stretches of this many days of one entity, so that a hot entity is split.
CHUNK_DAYS = 32


def _sessions(df: DataFrame, keys: list[str], touch_us: int) -> DataFrame:
    """Merge by session_window with a duration of each row's own; the session's true bounds are kept beside it."""
    # A session that ends when another begins is merged with it, so the reach is as far as intervals may lie apart.
    length = F.concat((F.col("__e") - F.col("__s") + F.lit(touch_us)).cast("string"), F.lit(" microseconds"))
    window = F.session_window(F.timestamp_micros("__s"), length)
    return df.groupBy(*keys, window.alias("__w")).agg(F.min("__s").alias("__s"), F.max("__e").alias("__e")).drop("__w")


def continuous_periods(
    df: DataFrame, keys: list[str], start: str, end: str, touch_us: int = 1_000_000, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Merge the intervals of each entity into continuous periods: keys, start_us, end_us (microseconds since 1970).

    Intervals that overlap, nest, touch or lie at most ``touch_us`` apart are continuous. Rows with a NULL key, a
    NULL bound, or an end not after the start belong to no period. Repeated rows change nothing; other columns of
    ``df`` are ignored whatever their names; an empty input gives an empty result.

    Method: ``session_window`` with row-specific duration, first within chunks of an entity's time (so that no task
    holds a hot entity), then again over only those sessions that may reach across a chunk border.
    """
    inner = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, inner)],
        F.unix_micros(F.col(f"`{start}`").cast("timestamp")).alias("__s"),
        F.unix_micros(F.col(f"`{end}`").cast("timestamp")).alias("__e"),
    ).where(F.col("__e") > F.col("__s"))
    for key in inner:
        rows = rows.where(F.col(key).isNotNull())
    chunk = F.floor(F.col("__s") / F.lit(chunk_days * 86_400_000_000)).alias("__c")
    first = _sessions(rows.select(*inner, "__s", "__e", chunk), [*inner, "__c"], touch_us)
    # What earlier chunks reach into a chunk, and where the next one begins: one row for each entity and chunk.
    by_chunk = first.groupBy(*inner, "__c").agg(F.max("__e").alias("__last"), F.min("__s").alias("__first"))
    order = Window.partitionBy(*inner).orderBy("__c")
    edges = by_chunk.select(
        *inner,
        "__c",
        F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
        F.lead("__first").over(order).alias("__after"),
    )
    placed = first.join(edges, [*inner, "__c"])
    covered = F.coalesce(F.col("__e") <= F.col("__carry"), F.lit(False))
    settled = F.coalesce(F.col("__s") > F.col("__carry") + touch_us, F.lit(True)) & F.coalesce(
        F.col("__e") + touch_us < F.col("__after"), F.lit(True)
    )
    # A session inside what earlier chunks cover adds nothing; a settled one can meet no other.
    across = _sessions(placed.where(~covered & ~settled).select(*inner, "__s", "__e"), inner, touch_us)
    merged = placed.where(~covered & settled).select(*inner, "__s", "__e").unionByName(across)
    return merged.select(
        *[F.col(a).alias(k) for a, k in zip(inner, keys)], F.col("__s").alias("start_us"), F.col("__e").alias("end_us")
    )


def periods_and_gaps(
    df: DataFrame, keys: list[str], start: str, end: str, touch_us: int = 1_000_000, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """The continuous periods of each entity and the gaps between neighbours: keys, kind, start_us, end_us.

    Rows count as in :func:`continuous_periods`. ``kind`` is 'period' or 'gap'; an entity with one period has no gap.
    """
    periods = continuous_periods(df, keys, start, end, touch_us, chunk_days)
    chunk = F.floor(F.col("start_us") / F.lit(chunk_days * 86_400_000_000))
    both = with_next(periods, keys, "start_us", chunk, "start_us", "__next")
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_us"), F.col("end_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("end_us").alias("start_us"), F.col("__next").alias("end_us")),
    )
    return both.select(*keys, F.explode(pieces).alias("__p")).select(*keys, "__p.*").where(F.col("end_us").isNotNull())
