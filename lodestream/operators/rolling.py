"""Rolling totals over trailing periods: a two-stack queue of a monoid, day by day, inactive days included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TwoStackQueue:
    """A first-in first-out queue that knows the combination of all its items, for any associative ``combine``.

    Needs no inverse, so it serves maxima as well as sums. Each item is moved once, so a step costs a constant number
    of combinations on average, whatever the window's length.
    """

    __slots__ = ("combine", "front", "back", "back_all", "empty")

    def __init__(self, combine: Callable, empty) -> None:
        self.combine, self.empty = combine, empty
        self.front: list = []  # (key, item combined with all items after it in this stack)
        self.back: list = []  # (key, item)
        self.back_all = empty

    def push(self, key: int, item) -> None:
        self.back.append((key, item))
        self.back_all = self.combine(self.back_all, item)

    def evict(self, before: int) -> None:
        """Drop the items whose key is less than ``before``; keys must have been pushed in order."""
        while True:
            if not self.front:
                if not self.back or self.back[0][0] >= before:
                    return
                whole = self.empty
                while self.back:
                    key, item = self.back.pop()
                    whole = self.combine(item, whole)
                    self.front.append((key, whole))
                self.back_all = self.empty
            if self.front[-1][0] >= before:
                return
            self.front.pop()

    def total(self):
        return self.combine(self.front[-1][1], self.back_all) if self.front else self.back_all


def _combine(a: tuple, b: tuple) -> tuple:
    """Day totals: rows, active days, then for each measure its sum, count and maximum."""
    out = [a[0] + b[0], a[1] + b[1]]
    for i in range(2, len(a), 3):
        x, y = a[i + 2], b[i + 2]
        out += [a[i] + b[i], a[i + 1] + b[i + 1], y if x is None or (y is not None and y > x) else x]
    return tuple(out)


def trailing_totals(
    df: DataFrame,
    key: list[str] | None,
    version: str | None,
    entity: Column,
    time: str,
    measures: dict[str, str],
    windows: tuple[int, ...] = (7, 30),
    entity_name: str = "entity",
) -> DataFrame:
    """For each entity, day and window length: totals over the trailing days, that day included.

    Columns: ``entity_name``, day (date), window_days, n_rows, active_days and, for each measure m, sum_m, avg_m (over
    rows that have it, NULL if none), max_m (NULL if none), per_day_m (sum over the window's length). Every day from the
    entity's first to its last active day comes out, with or without activity.

    A repeated ``key`` counts once, with the row of the latest ``version``; rows with a NULL in the key all count. Rows
    with a NULL or empty entity or a NULL time don't count. A NULL or NaN measure adds nothing but its row counts. Days
    are UTC. An empty input gives an empty result.

    Rows are totalled by entity and day before they meet, so one task holds at most an entity's days; those pass in
    order through :class:`TwoStackQueue`.
    """
    names = list(measures)
    rows = df.select(
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key or [])],
        *([F.col(f"`{version}`").alias("__v")] if version else []),
        entity.alias("__e"),
        F.unix_date(F.col(f"`{time}`").cast("timestamp").cast("date")).alias("__day"),
        *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"__m{i}") for i, c in enumerate(measures.values())],
    ).where((F.col("__e") != "") & F.col("__day").isNotNull())
    data = ["__e", "__day", *[f"__m{i}" for i in range(len(names))]]
    if key:
        keys = [f"__k{i}" for i in range(len(key))]
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        order = F.col("__v") if version else F.lit(0)
        latest = rows.where(whole).groupBy(*keys).agg(F.max_by(F.struct(*data), order).alias("__r"), F.count(F.lit(1)))
        rows = latest.select("__r.*").unionByName(rows.where(~whole).select(*data))
    parts = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        m = F.col(f"__m{i}")
        parts += [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"s{i}"), F.count(m).alias(f"c{i}"), F.max(m).alias(f"x{i}")]
    days = rows.groupBy("__e", "__day").agg(*parts).repartition("__e").sortWithinPartitions("__e", "__day")

    fields = [f"{entity_name} string", "day date", "window_days int", "n_rows long", "active_days int"]
    for name in names:
        fields += [f"sum_{name} double", f"avg_{name} double", f"max_{name} double", f"per_day_{name} double"]
    empty = (0, 0, *[x for _ in names for x in (0.0, 0, None)])
    return days.mapInPandas(_roller(len(names), windows, empty, [f.split()[0] for f in fields]), ", ".join(fields))


def _roller(measures: int, windows: tuple[int, ...], empty: tuple, names: list[str]) -> Callable[[Iterator], Iterator]:
    """The function over a partition sorted by entity and day; an entity may span batches."""

    def run(batches):
        import datetime

        import pandas as pd

        columns = ["n", *[f"{p}{i}" for i in range(measures) for p in "scx"]]
        epoch = datetime.date(1970, 1, 1).toordinal()
        entity, last, queues = None, None, []

        def emit(out, day):
            date = datetime.date.fromordinal(epoch + day)
            for width, queue in zip(windows, queues):
                queue.evict(day - width + 1)
                t = queue.total()
                row = [entity, date, width, t[0], t[1]]
                for i in range(2, len(t), 3):
                    row += [t[i] if t[i + 1] else 0.0, t[i] / t[i + 1] if t[i + 1] else None, t[i + 2], t[i] / width if t[i + 1] else 0.0]
                out.append(row)

        for pdf in batches:
            out: list[list] = []
            items = zip(pdf["__e"].tolist(), pdf["__day"].tolist(), *[pdf[c].tolist() for c in columns])
            for e, day, n, *values in items:
                if e != entity:
                    entity, last = e, None
                    queues = [TwoStackQueue(_combine, empty) for _ in windows]
                for quiet in range(last + 1, day) if last is not None else ():
                    emit(out, quiet)
                item = (n, 1, *[None if v != v else v for v in values])
                for queue in queues:
                    queue.push(day, item)
                emit(out, day)
                last = day
            if out:
                yield pd.DataFrame(out, columns=names).astype({c: "float64" for c in names[5:]})

    return run
