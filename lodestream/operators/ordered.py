"""Neighbour look-ups in ordered groups, without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, keys: list[str], order: str, chunk: Column, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the next row of the group by ``order``, NULL on its last row.

    ``chunk`` must not decrease with ``order``. A group is sorted chunk by chunk, each in its own task;
    only one row for each group and chunk is ordered over the whole group. Keys must not be NULL.
    """
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order)
    rows = df.withColumn("__chunk", chunk).withColumn(out, F.lead(value).over(inside))
    heads = rows.groupBy(*keys, "__chunk").agg(F.min_by(value, order).alias("__head"))
    over = Window.partitionBy(*keys).orderBy("__chunk")
    heads = heads.select(*keys, "__chunk", F.lead("__head").over(over).alias("__later"))
    return (
        rows.join(heads, [*keys, "__chunk"], "left")
        .withColumn(out, F.coalesce(out, "__later"))
        .drop("__chunk", "__later")
    )


def chunk_counts(df: DataFrame, keys: list[str], chunk: str, counted: dict[str, str]) -> DataFrame:
    """keys, chunk and, for each ``counted`` column, the rows of the group that have it: ``before_``name in earlier chunks, ``all_``name.

    ``counted`` maps names to columns. One row for each group and chunk; only those are ordered over a group.
    """
    counts = df.groupBy(*keys, chunk).agg(*[F.count(c).alias(n) for n, c in counted.items()])
    over = Window.partitionBy(*keys)
    before = over.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys, chunk, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in counted],
        *[F.sum(n).over(over).alias(f"all_{n}") for n in counted],
    )


def with_places(df: DataFrame, keys: list[str], order: list[str], chunk: str, counted: dict[str, str], counts: DataFrame) -> DataFrame:
    """Add all columns of ``counts`` and, for each ``counted`` column, the row's zero-based place ``at_``name in its group.

    Only rows where that column isn't NULL have a place; another gets that of the next one. ``chunk`` is a column that
    must not decrease with ``order``; ties in ``order`` need a unique last column. Each chunk is numbered in its own
    task and shifted by ``counts``, made by :func:`chunk_counts`. Keys must not be NULL.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[F.count(c).over(inside).alias(f"in_{n}") for n, c in counted.items()])
    placed = rows.join(counts, [*keys, chunk])
    return placed.withColumns({f"at_{n}": F.col(f"before_{n}") + F.col(f"in_{n}") for n in counted}).drop(*[f"in_{n}" for n in counted])


def without_repeats(df: DataFrame, keys: list[str], order: list[str], chunk: str) -> DataFrame:
    """Drop rows that agree with the row before in all of ``order``: exact copies, which sorting has made neighbours.

    Sorted and partitioned as in :func:`with_places`, so that the two share one shuffle.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    same = F.lit(True)
    for c in order:
        same = same & F.lag(c).over(inside).eqNullSafe(F.col(c))
    first = F.row_number().over(inside) == 1
    return df.withColumn("__first", first | ~same).where("__first").drop("__first")


#: Rows of one group that a task orders, beside those that its frames reach back to.
BLOCK = 100_000
#: Length of the stretches of time into which a group is cut.
CHUNK_US = 86_400_000_000


def _day(time: str) -> Column:
    return F.coalesce(F.floor(F.unix_micros(F.col(time)) / F.lit(CHUNK_US)), F.lit(-(2**40)))


def with_frames(
    df: DataFrame, keys: list[str], order: list[str], reach: int, frames: dict[str, Callable[[object], Column]], block: int = BLOCK
) -> DataFrame:
    """Add a column for each of ``frames``: a function of a window specification that looks at most ``reach`` rows back.

    ``order`` begins with a timestamp and ends with a unique column. ``at_row`` is the row's zero-based place in its
    group. A group is numbered day by day and cut into blocks of rows, each with ``reach`` rows of the one before, so
    that a hot group is spread over tasks. Keys must not be NULL.
    """
    block = max(block, reach, 1)
    rows = df.withColumns({"__one": F.lit(1), "__day": _day(order[0])})
    placed = with_places(rows, keys, order, "__day", {"row": "__one"}, chunk_counts(rows, keys, "__day", {"row": "__one"}))
    own = F.floor(F.col("at_row") / block)
    spread = placed.withColumn("__block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("at_row") + reach) / block)))))
    window = Window.partitionBy(*keys, "__block").orderBy("at_row")
    made = spread.select(*df.columns, "at_row", "__block", *[f(window).alias(n) for n, f in frames.items()])
    return made.where(F.col("__block") == own).drop("__block")


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add at_row, the row's zero-based place in its group, and all_row, the group's size; day by day, as in :func:`with_frames`."""
    rows = df.withColumns({"__one": F.lit(1), "__day": _day(order[0])})
    placed = with_places(rows, keys, order, "__day", {"row": "__one"}, chunk_counts(rows, keys, "__day", {"row": "__one"}))
    return placed.select(*df.columns, "at_row", "all_row")


def with_latest(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the last row of the group, this one included, that has one (isn't NULL).

    ``order`` begins with a timestamp. A group is ordered day by day, each in its own task; only the days' last values
    are ordered over it.
    """
    rows = df.withColumns({"__value": value, "__day": _day(order[0])})
    inside = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last("__value", ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys, "__day").agg(F.max_by("__here", F.struct(*order)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__day", F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
    return rows.join(ends, [*keys, "__day"]).withColumn(out, F.coalesce("__here", "__earlier")).select(*df.columns, out)


def with_recent(df: DataFrame, keys: list[str], time: str, reach_us: int, frames: dict[str, Callable[[object], Column]]) -> DataFrame:
    """Add a column for each of ``frames``: a function of a window specification over the rows of the last ``reach_us``.

    A group is cut into days, each with the rows that its frames reach back to, so that a hot group is spread over
    tasks and rows are shuffled once. Rows that tie in ``time`` see one another; rows without time see only those.
    """
    at = F.unix_micros(F.col(time))
    own = _day(time)
    later = F.coalesce(F.floor((at + reach_us) / F.lit(CHUNK_US)), F.lit(-(2**40)))
    spread = df.withColumn("__day", F.explode(F.sequence(own, later)))
    window = Window.partitionBy(*keys, "__day").orderBy(at).rangeBetween(-reach_us, 0)
    made = spread.select("*", *[f(window).alias(n) for n, f in frames.items()])
    return made.where(F.col("__day") == own).drop("__day")


def newest(df: DataFrame, keys: list[str], time: str, unique: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each group by time, then by a unique column: first of each day, then of those."""
    order = [F.col(time).desc_nulls_last(), F.desc(unique)]
    days = df.withColumn("__day", _day(time))
    few = days.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(*order))).where(F.col("__k") <= n)
    few = few.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= n)
    return few.drop("__k", "__day")
