"""Irregular readings onto a regular grid: kernel-weighted local linear regression, with missing marks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of one source are laid out in blocks of this many, each an own row until it reaches its task.
BLOCK = 2016


def regular_grid(
    df: DataFrame,
    key: str,
    source: str,
    time: str,
    values: list[str],
    usable: Column,
    slot_s: int = 300,
    reach_s: int = 900,
    least_support: float = 2.0,
) -> DataFrame:
    """One row for each source and slot from that of its first to that of its last row.

    Columns: the source, slot_s, n_usable (usable readings inside the slot), support, status and one double for each of
    ``values``, estimated at the slot's middle. Method: each usable reading is indexed to the slots its kernel reaches
    (tricube of the distance over ``reach_s``) and adds its weighted moments there; a slot's local linear regression is
    then closed-form from the sums, so readings are summed up before the shuffle and a hot source isn't gathered
    anywhere. Where readings lie on one side only, the weighted mean stands in for the extrapolated line. ``support``
    is the effective number of readings (sum of weights squared over sum of squared weights). ``status`` is 'observed'
    (usable readings in the slot), 'filled' (none, but support of at least ``least_support`` from near ones) or
    'missing' (values NULL).

    A repeated ``key`` counts once (rows without key all count). Rows with NULL source or time are ignored; a row whose
    ``usable`` condition is false or NULL still extends its source's grid. An empty input gives an empty result.
    """
    step, reach = slot_s * 1_000_000, reach_s * 1_000_000
    rows = df.select(
        F.col(f"`{key}`").alias("__id"),
        F.col(f"`{source}`").alias("__src"),
        F.unix_micros(F.col(f"`{time}`").cast("timestamp")).alias("__t"),
        *[F.col(f"`{v}`").cast("double").alias(f"__y{i}") for i, v in enumerate(values)],
        F.coalesce(usable, F.lit(False)).alias("__ok"),
    ).where(F.col("__src").isNotNull() & F.col("__t").isNotNull())
    rows = rows.where(F.col("__id").isNotNull()).dropDuplicates(["__id"]).unionByName(rows.where(F.col("__id").isNull()))
    rows = rows.withColumn("__slot", F.floor(F.col("__t") / step))

    spread = math.ceil(reach / step + 0.5)
    offset = F.explode(F.sequence(F.lit(-spread), F.lit(spread))).alias("__k")
    near = rows.where("__ok").select("__src", "__t", "__slot", *[f"__y{i}" for i in range(len(values))], offset)
    near = near.withColumn("__d", (F.col("__t") - (F.col("__slot") + F.col("__k")) * step - step // 2) / float(reach))
    near = near.where(F.abs("__d") < 1)
    near = near.withColumn("__w", F.pow(1 - F.pow(F.abs("__d"), F.lit(3.0)), F.lit(3.0)))
    w, d = F.col("__w"), F.col("__d")
    moments = near.select(
        "__src",
        (F.col("__slot") + F.col("__k")).alias("__slot"),
        F.lit(0).alias("__grid"),
        (F.col("__k") == 0).cast("long").alias("__n"),
        w.alias("__s0"),
        (w * d).alias("__s1"),
        (w * d * d).alias("__s2"),
        (w * w).alias("__ww"),
        d.alias("__lo"),
        d.alias("__hi"),
        *[x for i in range(len(values)) for x in ((w * F.col(f"__y{i}")).alias(f"__t0_{i}"), (w * d * F.col(f"__y{i}")).alias(f"__t1_{i}"))],
    )
    spans = rows.groupBy("__src").agg(F.min("__slot").alias("__a"), F.max("__slot").alias("__b"))
    blocks = spans.select("__src", "__a", "__b", F.explode(F.sequence("__a", "__b", F.lit(BLOCK))).alias("__at"))
    blocks = blocks.repartition("__src", "__at")
    grid = blocks.select("__src", F.explode(F.sequence("__at", F.least(F.col("__at") + BLOCK - 1, "__b"))).alias("__slot"))
    none = F.lit(None).cast("double")
    grid = grid.select(
        "__src", "__slot", F.lit(1).alias("__grid"), F.lit(0).cast("long").alias("__n"),
        *[none.alias(c) for c in moments.columns[4:]],
    )
    sums = (
        moments.unionByName(grid)
        .groupBy("__src", "__slot")
        .agg(
            F.max("__grid").alias("__grid"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
            *[F.sum(c).alias(c) for c in moments.columns if c not in ("__src", "__slot", "__grid", "__lo", "__hi")],
        )
        .where(F.col("__grid") == 1)
    )
    support = F.coalesce(F.pow("__s0", F.lit(2.0)) / F.col("__ww"), F.lit(0.0))
    enough = (support >= least_support) | (F.col("__n") > 0)
    det = F.col("__s0") * F.col("__s2") - F.col("__s1") * F.col("__s1")
    sided = (F.col("__lo") <= 0) & (F.col("__hi") >= 0) & (det > 1e-9 * F.col("__s0") * F.col("__s0"))
    fitted = [
        F.when(
            enough,
            F.when(sided, (F.col("__s2") * F.col(f"__t0_{i}") - F.col("__s1") * F.col(f"__t1_{i}")) / det).otherwise(
                F.col(f"__t0_{i}") / F.col("__s0")
            ),
        ).alias(v)
        for i, v in enumerate(values)
    ]
    status = F.when(F.col("__n") > 0, "observed").when(enough, "filled").otherwise("missing")
    return sums.select(
        F.col("__src").alias(source),
        (F.col("__slot") * slot_s).alias("slot_s"),
        F.col("__n").alias("n_usable"),
        support.alias("support"),
        status.alias("status"),
        *fitted,
    )
