"""Scores and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The network's resource limits and fee steps.
LIMITS = {"instructions_step": 10_000, "fee_step": 25, "limit_tx": 100_000_000, "limit_ledger": 500_000_000, "limit_memory": 41_943_040}
#: Weights of the volatility index, and the levels' upper ends.
INDEX_WEIGHTS = (0.7, 0.3)
LEVELS = ((0.25, "Low"), (0.50, "Moderate"), (0.75, "High"))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in deviations; 0 where there is no deviation."""
    return F.when(deviation == 0, F.lit(0.0)).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))


def band(score: Column, low: float, medium: float, high: float) -> Column:
    """'low', 'medium' or 'high' above the given scores, else NULL."""
    return F.when(score > high, "high").when(score > medium, "medium").when(score > low, "low")


def volatility_level(index: Column) -> Column:
    """The index's level; an end belongs to the lower one."""
    level = F.when(F.lit(False), F.lit(None).cast("string"))
    for top, name in LEVELS:
        level = level.when(index <= top, name)
    return F.when(index.isNotNull(), level.otherwise("Extreme"))


def volatility_index(points: Column, mean: Column, deviation: Column, short: Column) -> Column:
    """Deviation over mean and distance of the newest tenth's mean from it, weighted, between 0 and 1; 0 below two points."""
    raw = F.when(mean > 0, deviation / F.nullif(mean, F.lit(0.0))).otherwise(0.0)
    ratio = F.when(mean > 0, short / F.nullif(mean, F.lit(0.0))).otherwise(1.0)
    index = raw * INDEX_WEIGHTS[0] + F.abs(ratio - 1) * INDEX_WEIGHTS[1]
    return F.when(points < 2, F.lit(0.0)).otherwise(F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0)))


def cpu_cost(instructions: Column, limit_ledger: int = LIMITS["limit_ledger"], limit_tx: int = LIMITS["limit_tx"]) -> dict[str, Column]:
    """increments (fee steps begun), fee, normalized (share of a transaction's limit), pressure (squared share of a ledger's), total."""
    increments = F.ceil(instructions / LIMITS["instructions_step"])
    fee, pressure = increments * LIMITS["fee_step"], F.pow(instructions / limit_ledger, F.lit(2.0))
    return {"increments": increments, "fee": fee, "normalized": instructions / limit_tx, "pressure": pressure, "total": fee * (1 + 0.5 * pressure)}


def memory_cost(used: Column, limit: int = LIMITS["limit_memory"], scale: float = 100.0) -> dict[str, Column]:
    """normalized (share of the limit), cost (grows as e^(5 * share))."""
    share = used / limit
    return {"normalized": share, "cost": scale * F.exp(5 * share)}


def satisfies(version: Column, wanted: str) -> Column:
    """Whether a version (numbers and dots) meets a range: >=x, ^x (same first number), ~x (same first two), or x itself."""
    numbers = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    sign = wanted[: len(wanted) - len(wanted.lstrip("<>=^~"))]
    parts = [int(x) for x in wanted[len(sign) :].split(".")]
    least = F.array(*map(F.lit, parts))
    same = lambda n: F.slice(numbers, 1, n) == F.array(*map(F.lit, parts[:n]))
    return {
        ">=": numbers >= least, ">": numbers > least, "<=": numbers <= least, "<": numbers < least, "^": (numbers >= least) & same(1), "~": (numbers >= least) & same(2),
        "": numbers == least, "=": numbers == least,
    }[sign]
