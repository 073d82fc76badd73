"""Queries of the training-data problems (p5, p7 to p10) over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.net import with_canonical_ip
from lodestream.llm import distinct, leakage, packing, quantiles, truncation
from lodestream.tables import table


def _clients(spark: SparkSession, folder: str) -> DataFrame:
    metrics = table(spark, folder, "api_performance_metrics").select(F.to_date("timestamp").alias("day"), "endpoint", "ip")
    return with_canonical_ip(metrics, "ip", "client").select("day", "endpoint", "client")


def p5_distinct_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct client addresses by day and endpoint, by day, by endpoint, and over all, with the relative standard error."""
    return distinct.distinct_counts(_clients(spark, folder), ["day", "endpoint"], "client")


def p5_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The mergeable sketch of each day and endpoint."""
    return distinct.sketches(_clients(spark, folder), ["day", "endpoint"], "client")


def p5_within_error(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct user agents by day, by endpoint, by both and over all, counted exactly, and whether the estimate is within five errors."""
    rows = table(spark, folder, "api_performance_metrics").select(F.to_date("timestamp").alias("day"), "endpoint", F.col("requestId").alias("request"))
    estimates = distinct.distinct_counts(rows, ["day", "endpoint"], "request")
    exact = rows.cube("day", "endpoint").agg(F.count_distinct("request").alias("exact"), F.grouping_id().cast("int").alias("g"))
    exact = exact.where(F.col("exact") > 0).withColumnsRenamed({"day": "d", "endpoint": "e"})
    same = F.col("day").eqNullSafe(F.col("d")) & F.col("endpoint").eqNullSafe(F.col("e")) & (F.col("grouping") == F.col("g"))
    within = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(5 * F.col("standard_error") * F.col("exact"), F.lit(2.0))
    return exact.join(estimates, same, "left").select(
        F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("e").alias("endpoint"), F.col("g").alias("grouping"), "exact",
        F.coalesce(within, F.lit(False)).alias("within_error"),
    )


def p7_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of responseTime by endpoint, method and hour or day, with bounds."""
    return quantiles.endpoint_percentiles(table(spark, folder, "api_performance_metrics"))


def p7_within_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Each window with its number of readings, and whether the exact percentiles lie within the sketch's bounds."""
    metrics = table(spark, folder, "api_performance_metrics")
    rows = metrics.where((F.col("responseTime") >= 0) & F.col("timestamp").isNotNull()).select("id", "endpoint", "method", "timestamp", "responseTime").distinct()
    windows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.date_trunc(w, "timestamp").alias("start")) for w in ("hour", "day")]))
    rows = rows.select("endpoint", "method", "responseTime", windows.alias("w")).select("endpoint", "method", "responseTime", "w.window", F.col("w.start").alias("window_start"))
    levels = quantiles.LEVELS
    keys = ["endpoint", "method", "window", "window_start"]
    exact = rows.groupBy(*keys).agg(F.percentile("responseTime", F.array(*map(F.lit, levels.values()))).alias("true"))
    both = quantiles.endpoint_percentiles(metrics).join(exact, keys, "full")
    # Small windows have exact bounds, but for rounding.
    held = [F.col("true")[i].between(F.col(f"{name}_low") - 1e-6, F.col(f"{name}_high") + 1e-6) for i, name in enumerate(levels)]
    ok = F.array_min(F.array(*held))
    return both.select("endpoint", "method", "window", F.unix_seconds("window_start").alias("start_s"), "n", F.coalesce(ok, F.lit(False)).alias("within_bounds"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The published aggregates whose p95ResponseTime is wrong by more than a tenth."""
    return quantiles.wrong_published(
        table(spark, folder, "api_performance_aggregates"), table(spark, folder, "api_performance_metrics")
    ).select("id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of an oversized one, with its container of each capacity."""
    return packing.fill_containers(
        table(spark, folder, "documents"), "doc_id", packing.byte_tokens(F.col("text")), table(spark, folder, "context_windows")
    )


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill_report(p8_containers(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that had to be split, for each capacity."""
    return p8_containers(spark, folder).where("split").select("capacity", "doc_id").distinct()


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages like those of test items, with similarity and the length of the common run."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of item and document that share 12 or more consecutive words."""
    return leakage.full_matches(p9_leaks(spark, folder))


def p10_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its verdict."""
    return truncation.judged(table(spark, folder, "documents"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates, and at which length."""
    return truncation.truncation_rates(p10_verdicts(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose text was cut off."""
    return p10_verdicts(spark, folder).where("truncated").select("doc_id").distinct()


QUERIES = {
    "p5_distinct_clients": p5_distinct_clients,
    "p5_sketches": p5_sketches,
    "p5_within_error": p5_within_error,
    "p7_found": p7_found,
    "p7_within_bounds": p7_within_bounds,
    "p7_percentiles": p7_percentiles,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_verdicts": p10_verdicts,
    "p10_rates": p10_rates,
}

_WORDS = (
    "regexp_extract_all(lower(regexp_replace(regexp_replace(text, '<[^<>\\n]{0,200}>|&[a-z]+;|&#x?[0-9a-fA-F]+;|\\\\[nrt\"]', ' ', 'g'), "
    "'[\u00ad\u200b-\u200d\u2060\ufeff*_`~''\u2019]', '', 'g')), '[\\p{L}\\p{N}_]+')"
)

ORACLE = {
    "p9_found": f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from eval_items),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as s from d),
iw as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as s from i)
select distinct item_id, doc_id from dw join iw using (s)""",
    "p5_within_error": """
with r as (select cast(timestamp as date) as d, endpoint as e, requestId as r from api_performance_metrics)
select strftime(d, '%Y-%m-%d') as "day", e as endpoint, cast(grouping(d) * 2 + grouping(e) as integer) as "grouping", count(distinct r) as exact, true as within_error
from r group by cube (d, e) having count(distinct r) > 0""",
    "p7_within_bounds": """
with m as (select distinct id, endpoint, method, timestamp as t, responseTime as v from api_performance_metrics where responseTime >= 0 and timestamp is not null),
w as (select endpoint, method, unnest(['hour', 'day']) as w, t from m)
select endpoint, method, w as "window", epoch(case w when 'hour' then date_trunc('hour', t) else date_trunc('day', t) end) :: bigint as start_s, count(*) as n, true as within_bounds
from w group by 1, 2, 3, 4""",
    "p7_found": """
with m as (select distinct id, endpoint, method, timestamp as t, responseTime as v from api_performance_metrics where responseTime >= 0),
w as (
  select endpoint, method, 'hour' as w, date_trunc('hour', t) as s, quantile_cont(v, 0.95) as q from m group by 1, 2, 4
  union all select endpoint, method, 'day', date_trunc('day', t), quantile_cont(v, 0.95) from m group by 1, 2, 4)
select a.id from api_performance_aggregates a
join w on a.endpoint = w.endpoint and a.method = w.method and a.aggregationWindow = w.w and a.timestamp = w.s
where abs(cast(a.p95ResponseTime as double) - q) > 0.1 * q""",
    "p8_found": """
select capacity, doc_id from (select distinct capacity from context_windows) c
join documents d on strlen(d.text) + 1 > c.capacity""",
}
