"""Monitors over streams: windowed counts, per-key snapshot state, and flags merged into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Snapshots kept for each key, and those before a snapshot that its averages cover.
KEPT, SPAN = 100, 10


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and mean of ``value``) by key and tumbling window; rows later than ``late`` are dropped, as batches don't."""
    w = F.window(time, width)
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.avg(value).alias("mean")] if value else [])
    by = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(*aggregates)
    return by.select(*keys, F.col("w.start").alias("start"), *by.columns[len(keys) + 1 :])


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by key: rows less than ``gap`` apart."""
    by = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return by.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def enrich(history: list[float], value: float) -> tuple[float, float, float]:
    """Change in percent from the last of ``history``, mean and variation of its last SPAN; what is undefined is 0."""
    last = history[-SPAN:]
    change = (value - history[-1]) / history[-1] * 100 if history and history[-1] > 0 else 0.0
    mean = sum(last) / len(last) if last else 0.0
    spread = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5 if last else 0.0
    return change, mean, min(spread / mean, 1.0) if len(last) > 1 and mean else 0.0


def snapshots(stream: DataFrame, key: str, order: str, value: str, late: str = "1 hour", idle_hours: int = 7 * 24) -> DataFrame:
    """Each row with its change, mean and variation against its key's earlier rows, which are kept as bounded state.

    Columns: key, order, value, change, mean, variation. Rows of one micro-batch pass in order; a row that comes in a
    later batch counts as later, whatever its order. NULL values are skipped. Where ``order`` is a
    time, the state of a key goes when the watermark (``late`` behind the newest row) is ``idle_hours`` past its last
    row, so that states don't pile up with every key ever seen; such a key begins anew.
    """
    kinds = dict(stream.dtypes)

    def step(k, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("at", kind="stable")
        out = []
        for at, v in zip(rows["at"], rows["value"]):
            out.append((k[0], at, v, *enrich(history, v)))
            history = [*history, v][-KEPT:]
        state.update((history,))
        if timed:
            newest = int(pd.Timestamp(rows["at"].max()).timestamp() * 1000) if len(rows) else 0
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_hours * 3_600_000)
        yield pd.DataFrame(out, columns=["key", "at", "value", "change", "mean", "variation"])

    timed = kinds[order] == "timestamp"
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    slim = stream.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("value"))
    slim = slim.withWatermark("at", late) if timed else slim
    return slim.groupBy("key").applyInPandasWithState(
        step, f"key {kinds[key]}, at {kinds[order]}, value double, change double, mean double, variation double", "history array<double>", "append", timeout
    )


def levels(rows: DataFrame, thresholds: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Add ``level`` (info, warning, critical or NULL): the highest any of the measures reaches."""
    rank = F.greatest(*[sum(((F.coalesce(F.col(m), F.lit(0.0)) >= t).cast("int") for t in ts), F.lit(0)) for m, ts in thresholds.items()], F.lit(0))
    return rows.withColumn("level", F.when(rank > 0, F.get(F.array(*map(F.lit, ["info", "warning", "critical"])), rank - 1)))


#: Thresholds (info, warning, critical) of each measure for all chains, which have the key 0.
THRESHOLDS = {
    0: {
        "base_fee_percentage": (15, 30, 40), "absolute_gwei": (50, 80, 100), "volatility_index": (0.40, 0.60, 0.75), "priority_fee_percentage": (30, 70, 100),
    }
}
#: An example of thresholds of one chain's own; what it leaves out is taken from key 0.
CHAIN_THRESHOLDS = {7: {"absolute_gwei": (10, 20, 30)}}


def threshold_levels(rows: DataFrame, key: str, thresholds: dict[int, dict[str, tuple[float, float, float]]]) -> DataFrame:
    """:func:`levels` with thresholds by key: a measure's are those of the row's key if it has some, else those of key 0.

    Measures that ``rows`` doesn't have are left out. The table of thresholds is a configuration, so it becomes part of
    the expression; nothing is joined.
    """
    ranks = []
    for measure, common in thresholds.get(0, {}).items():
        if measure not in rows.columns:
            continue
        value = F.coalesce(F.col(measure), F.lit(0.0))
        rank = lambda ts, value=value: sum(((value >= t).cast("int") for t in ts), F.lit(0))
        own = F.when(F.lit(False), F.lit(None).cast("int"))
        for k, by_measure in thresholds.items():
            if k != 0 and measure in by_measure:
                own = own.when(F.col(key) == k, rank(by_measure[measure]))
        ranks.append(own.otherwise(rank(common)))
    worst = F.greatest(*ranks, F.lit(0), F.lit(0))
    return rows.withColumn("level", F.when(worst > 0, F.get(F.array(*map(F.lit, ["info", "warning", "critical"])), worst - 1)))


#: Buckets of a flag table; a batch rewrites only those its keys fall into.
BUCKETS = 256


def merge_flags(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: fold a batch of flags (keys, flagged, worst) into the table at ``path``, read by :func:`flags`.

    The table lies in buckets of keys. A batch writes, for each bucket that it touches, a version of its own from the
    newest one of earlier batches, so that a batch that is run again gives the same table; all but the two newest
    versions of a bucket are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(*keys).agg(F.sum("flagged").alias("flagged"), F.max("worst").alias("worst"), F.count(F.lit(1)).alias("updates"))
        rows = rows.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        held = _versions(spark, path)
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
        for bucket in touched:
            earlier = [v for v in held.get(bucket, []) if v < number]
            if earlier:
                rows = rows.unionByName(spark.read.parquet(f"{path}/bucket={bucket}/version={earlier[-1]}").withColumn("bucket", F.lit(bucket)))
        rows = rows.groupBy(*keys, "bucket").agg(F.sum("flagged").alias("flagged"), F.max("worst").alias("worst"), F.sum("updates").alias("updates"))
        versioned = rows.withColumn("version", F.lit(number))
        versioned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        for bucket in touched:
            for old in [v for v in held.get(bucket, []) if v < number][:-1]:
                _remove(spark, f"{path}/bucket={bucket}/version={old}")

    return merge


def flags(spark: SparkSession, path: str) -> DataFrame:
    """The flag table at ``path``: the newest version of each bucket."""
    newest = [f"{path}/bucket={b}/version={vs[-1]}" for b, vs in _versions(spark, path).items()]
    return spark.read.parquet(*newest)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions that each bucket of a flag table has, in order."""
    files, place = _folder(spark, f"{path}/bucket=*/version=*")
    out: dict[int, list[int]] = {}
    for status in files.globStatus(place) or []:
        bucket, version = [part.partition("=")[2] for part in status.getPath().toString().split("/")[-2:]]
        out.setdefault(int(bucket), []).append(int(version))
    return {b: sorted(vs) for b, vs in out.items()}


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)
