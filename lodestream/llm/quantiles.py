"""Percentiles by compactor hierarchies (KLL), mergeable, with a rank-error bound; and published figures held against them."""

from __future__ import annotations

import functools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size parameter of a sketch; its rank error is 0.14 %.
K = 2048
#: The sketch library's fit of its rank error, a / k^b.
ERROR_FIT = (2.296, 0.9723)
#: A bound is taken at so many rank errors; beyond it the chance of a wrong answer is negligible.
SURE = 4.0
#: Percentiles that come out.
LEVELS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Distances in rank at which bounds are read: they grow by STEP from FINEST to 1, and a group takes the next one that
#: covers its error.
FINEST, STEP = 2e-5, 1.05
#: The readings of one endpoint, method and hour are spread over so many tasks.
SALTS = 8


def rank_error(k: int = K) -> float:
    """The normalised rank error of one quantile at about 99 % confidence."""
    return ERROR_FIT[0] / k ** ERROR_FIT[1]


def sketches(df: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch for each group: groups, n, sketch. NULL values are left out; a group of none has no row.

    Built by the engine's own compactor sketch (levels that are sorted and halved at random, merged level by level)
    before any shuffle that the groups need, so that a hot group reaches it as one sketch for each task.
    """
    rows = df.where(F.col(value).isNotNull())
    agg = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch")
    )
    return agg


def merge(parts: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """Merge sketches by ``groups`` (hours into days, one partition's or day's result with another's)."""
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def percentiles(parts: DataFrame, groups: list[str], k: int = K, levels: dict[str, float] | None = None) -> DataFrame:
    """groups, n and, for each level, a percentile (linear interpolation) with its bounds: pXX, pXX_low, pXX_high.

    The true percentile lies within the bounds, but for a negligible chance: they are read ``SURE`` rank errors away on
    either side, from the two ranks between which it is interpolated. Up to ``k`` values a sketch holds them all. Then
    the two values themselves are read, and both bounds are the true percentile (for levels that are multiples of a
    twentieth; others keep the two values as bounds).
    """
    levels = levels or LEVELS
    slacks = [FINEST]
    while slacks[-1] < 1:
        slacks.append(slacks[-1] * STEP)
    ranks: list[float] = []
    for level in levels.values():
        ranks += [level, *[max(0.0, level - s) for s in slacks], *[min(1.0, level + s) for s in slacks]]
    read = parts.select(
        *groups, "n", F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(r) for r in ranks])).alias("__q")
    )
    n = F.col("n")

    def step(distance: Column, rounded) -> Column:
        """The place of a distance in rank among the steps."""
        at = rounded(F.log(distance / FINEST) / math.log(STEP))
        return F.greatest(F.lit(0), F.least(at, F.lit(len(slacks) - 1))).cast("int")

    columns = []
    for i, (name, level) in enumerate(levels.items()):
        first = i * (2 * len(slacks) + 1)
        parts_of_one = Fraction(level).limit_denominator(1000).denominator
        exact = parts_of_one <= 20
        ends = []
        for share, base in ((level, first + 1), (1 - level, first + 1 + len(slacks))):
            # Reading at rank r gives the value at place ceil(r * n). The place sought lies at a multiple of 1 / parts
            # from level * n; half of that inside it, the steps are fine enough to hit no other.
            small = step((share - 0.5 / parts_of_one) / n, F.round) if exact else step(share / n, lambda x: F.ceil(x + 1e-9))
            large = step(F.lit(SURE * rank_error(k)) + share / n, lambda x: F.ceil(x + 1e-9))
            ends.append(F.get("__q", F.lit(base) + F.when(n > k, large).otherwise(small)).cast("double"))
        low, high = ends
        at = (n - 1) * F.lit(level)
        between = low + (high - low) * (at - F.floor(at))
        known = (n <= k) & F.lit(exact)
        columns.append(F.when(known, between).otherwise(F.col("__q")[first]).alias(name))
        columns += [F.when(known, between).otherwise(end).alias(f"{name}_{side}") for end, side in ((low, "low"), (high, "high"))]
    return read.select(*groups, "n", *columns)


KEYS = ["endpoint", "method", "window_start"]


def _readings(metrics: DataFrame) -> DataFrame:
    """One row for each reading: endpoint, method, window_start (hour), salt, value. A repeated id counts once.

    Ids travel as 96 bits of hash within their endpoint, method and hour. Rows without id all count. The rows are
    shuffled once, by hour and a salt; whatever is grouped by those afterwards stays where it is.
    """
    rows = metrics.select(
        "endpoint", "method", F.date_trunc("hour", "timestamp").alias("window_start"), F.xxhash64("id").alias("h"), F.hash("id").alias("g"),
        F.col("id").isNull().alias("bare"), F.col("responseTime").cast("long").alias("value"),
    )
    rows = rows.where((F.col("value") >= 0) & F.col("window_start").isNotNull())
    # Rows without id are spread by their value.
    spread = F.when(F.col("bare"), F.col("value")).otherwise(F.col("h"))
    rows = rows.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).repartition(*KEYS, "salt")
    once = rows.groupBy(*KEYS, "salt", "h", "g", "bare", "value").agg(F.count(F.lit(1)).alias("c"))
    times = F.explode(F.when(F.col("bare"), F.sequence(F.lit(1), F.col("c"))).otherwise(F.array(F.lit(1).cast("bigint"))))
    return once.select(*KEYS, "salt", "value", times.alias("i")).drop("i")


def endpoint_sketches(metrics: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Sketches of responseTime by endpoint, method and hour, and those merged into days: two frames with window_start.

    A repeated id counts once (rows without id all count); NULL and negative response times don't count.
    """
    return _merged(_readings(metrics), k)


def _merged(readings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    hours = merge(sketches(readings, [*KEYS, "salt"], "value", k), KEYS, k)
    return hours, merge(hours.withColumn("window_start", F.date_trunc("day", "window_start")), KEYS, k)


def endpoint_percentiles(metrics: DataFrame, k: int = K) -> DataFrame:
    """Percentiles of responseTime by endpoint, method and window: window ('hour', 'day'), window_start, n, pXX with bounds."""
    return _percentiles(_readings(metrics), k, LEVELS)


def _percentiles(readings: DataFrame, k: int, levels: dict[str, float]) -> DataFrame:
    hours, days = _merged(readings, k)
    both = hours.withColumn("window", F.lit("hour")).unionByName(days.withColumn("window", F.lit("day")))
    return percentiles(both, ["endpoint", "method", "window", "window_start"], k, levels)


def same_window(**others: str) -> Column:
    """The condition of a join on the keys of a window: endpoint and method, by the other side's e and m, and ``others``.

    It is null-safe, as a condition that a key isn't NULL would reach below the shuffle of the readings and make it
    another for each reader.
    """
    pairs = {"endpoint": "e", "method": "m", **others}
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in pairs.items()])


def judged_published(aggregates: DataFrame, metrics: DataFrame, tolerance: float = 0.1, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The rows of ``aggregates`` with the sketches' bounds (id, keys, published, p95, verdict) and the readings they come from.

    ``verdict`` is 'wrong' or 'right' where the bounds decide whether p95ResponseTime differs from the true one by more
    than ``tolerance``, else 'undecided'. Windows are 'hour' and 'day', in any case.
    """
    readings = _readings(metrics)
    measured = _percentiles(readings, k, {"p95": LEVELS["p95"]})
    published = aggregates.where(F.col("p95ResponseTime").isNotNull()).select(
        "id", F.col("endpoint").alias("e"), F.col("method").alias("m"), F.lower(F.trim("aggregationWindow")).alias("w"),
        F.date_trunc("hour", "timestamp").alias("t"), F.col("p95ResponseTime").cast("double").alias("published"),
    )
    published = published.dropDuplicates(["id"]).dropna(subset=["e", "m", "w", "t"])
    judged = published.join(measured, same_window(window="w", window_start="t"))
    at = F.col("published")
    wrong = (at > F.col("p95_high") * (1 + tolerance)) | (at < F.col("p95_low") * (1 - tolerance))
    right = (at <= F.col("p95_low") * (1 + tolerance)) & (at >= F.col("p95_high") * (1 - tolerance))
    verdict = F.when(wrong, "wrong").when(right, "right").otherwise("undecided")
    return judged.select("id", "endpoint", "method", "window", "window_start", "published", "p95", verdict.alias("verdict")), readings


def wrong_published(aggregates: DataFrame, metrics: DataFrame, tolerance: float = 0.1, k: int = K) -> DataFrame:
    """The rows of ``aggregates`` whose p95ResponseTime differs from the true one by more than ``tolerance``: id, published, p95.

    A row is decided from its sketch's bounds where they allow it; the rest (see :func:`judged_published`) by counting
    the values of just those windows exactly, from the same shuffled readings. A row whose window has no values can't be
    judged and is left out, as is a NULL figure.
    """
    judged, readings = judged_published(aggregates, metrics, tolerance, k)
    exact = exact_percentile(judged.where(F.col("verdict") == "undecided"), readings, 0.95)
    both = judged.join(exact.withColumnsRenamed({"id": "__id", "exact": "__exact"}), F.col("id") == F.col("__id"), "left")
    late = (F.col("verdict") == "undecided") & (F.abs(F.col("published") - F.col("__exact")) > tolerance * F.col("__exact"))
    return both.where((F.col("verdict") == "wrong") | late).select("id", "published", F.coalesce("__exact", "p95").alias("p95"))


def exact_percentile(windows: DataFrame, readings: DataFrame, level: float) -> DataFrame:
    """id, exact: the exact percentile of each of ``windows`` (id, endpoint, method, window, window_start).

    A day stands for its hours. Values are counted by window and value before anything is ordered, so a task orders
    distinct values, not rows.
    """
    hours = F.when(F.col("window") == "day", F.sequence("window_start", F.col("window_start") + F.expr("interval 23 hours"), F.expr("interval 1 hour")))
    wanted = windows.select("id", F.col("endpoint").alias("e"), F.col("method").alias("m"), F.explode(F.coalesce(hours, F.array("window_start"))).alias("t"))
    counts = readings.join(wanted, same_window(window_start="t")).groupBy("id", "value").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("id").orderBy("value")
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("id")))
    at = (F.col("n") - 1) * F.lit(level)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    ends = placed.groupBy("id").agg(
        F.max(F.when(holds(F.floor(at)), F.col("value"))).alias("below"),
        F.max(F.when(holds(F.ceil(at)), F.col("value"))).alias("above"),
        F.max(at).alias("at"),
    )
    return ends.select("id", (F.col("below") + (F.col("above") - F.col("below")) * (F.col("at") - F.floor("at"))).alias("exact"))
