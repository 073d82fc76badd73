"""Ordered series (W), sorts and top-k (T) and batch forms of the per-key monitors (Z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import newest, numbered, with_frames, with_recent
from lodestream.plans.aggregates import n_rows, ok
from lodestream.plans.query import Register
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add


def of_chain(v: Views, reach: int, **frames) -> DataFrame:
    """Prices with columns over the rows before them on their chain."""
    return with_frames(v.prices, ["chain_id"], ["ts", "event_id"], reach, frames)


@add("W01_percent_change", "prices", """
with l as (select chain_id, event_id, base_fee, lag(base_fee) over (partition by chain_id order by ts, event_id) as before from prices)
select chain_id, event_id, round(case when before is null or before <= 0 then 0 else (base_fee - before) / before * 100 end, 6) as change from l""")
def percent_change(v: Views) -> DataFrame:
    rows = of_chain(v, 1, before=lambda w: F.lag("base_fee").over(w))
    change = F.when(F.col("before") > 0, (F.col("base_fee") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    return rows.select("chain_id", "event_id", F.round(change, 6).alias("change"))


@add("W02_moving_average", "prices", """
select chain_id, event_id, round(coalesce(avg(base_fee) over (partition by chain_id order by ts, event_id rows between 10 preceding and 1 preceding), 0), 6) as mean from prices""")
def moving_average(v: Views) -> DataFrame:
    rows = of_chain(v, 10, mean=lambda w: F.avg("base_fee").over(w.rowsBetween(-10, -1)))
    return rows.select("chain_id", "event_id", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


@add("W03_rolling_variation", "prices", """
with w as (select chain_id, event_id, count(*) over f as n, avg(base_fee) over f as m, stddev_pop(base_fee) over f as s from prices
  window f as (partition by chain_id order by ts, event_id rows between 10 preceding and 1 preceding))
select chain_id, event_id, round(case when n < 2 or m = 0 then 0 else least(s / m, 1) end, 6) as variation from w""")
def rolling_variation(v: Views) -> DataFrame:
    over = lambda f: lambda w: f("base_fee").over(w.rowsBetween(-10, -1))
    rows = of_chain(v, 10, n=over(F.count), m=over(F.avg), s=over(F.stddev_pop))
    cv = F.when((F.col("n") < 2) | (F.col("m") == 0), 0.0).otherwise(F.least(F.col("s") / F.col("m"), F.lit(1.0)))
    return rows.select("chain_id", "event_id", F.round(cv, 6).alias("variation"))


@add("W04_ring_buffer", "prices", """
with r as (select chain_id, event_id, row_number() over (partition by chain_id order by ts desc, event_id desc) as k from prices) select chain_id, event_id from r where k <= 100""")
def ring_buffer(v: Views) -> DataFrame:
    return newest(v.prices, ["chain_id"], "ts", "event_id", 100).select("chain_id", "event_id")


@add("W05_exponential_average", "prices", """
with l as (select chain_id, list(base_fee order by ts, event_id) as xs from prices group by 1)
select chain_id, round(list_reduce(xs, lambda e, x: x * 0.08 + e * 0.92), 6) as ema from l""")
def exponential_average(v: Views) -> DataFrame:
    """Alpha 2 / 25, seeded by the first value. Closed form: every value adds its weight by its place, so only numbering needs an order, which is made day by day."""
    # The weight of the value k from the end is alpha * (1 - alpha)^k, of the first value (1 - alpha)^(n - 1).
    rows = numbered(v.prices.select("chain_id", "base_fee", "ts", "event_id"), ["chain_id"], ["ts", "event_id"])
    rows = rows.select("chain_id", "base_fee", (F.col("all_row") - 1 - F.col("at_row")).alias("k"))
    decay = F.pow(F.lit(0.92), F.col("k"))
    return rows.groupBy("chain_id").agg(
        F.round(F.sum(F.col("base_fee") * decay) * 0.08 + F.max_by("base_fee", "k") * F.pow(F.lit(0.92), F.max("k")) * 0.92, 6).alias("ema")
    )


@add("W06_mean_ratio", "prices", """
with r as (select chain_id, base_fee, row_number() over (partition by chain_id order by ts desc, event_id desc) as k, count(*) over (partition by chain_id) as n from prices)
select chain_id, round(avg(case when k <= greatest(1, n // 10) then base_fee end) / avg(base_fee), 6) as ratio from r group by 1""")
def mean_ratio(v: Views) -> DataFrame:
    rows = numbered(v.prices.select("chain_id", "base_fee", "ts", "event_id"), ["chain_id"], ["ts", "event_id"])
    recent = F.col("all_row") - F.col("at_row") <= F.greatest(F.lit(1), F.floor(F.col("all_row") / 10))
    return rows.groupBy("chain_id").agg(F.round(F.avg(F.when(recent, F.col("base_fee"))) / F.avg("base_fee"), 6).alias("ratio"))


@add("W07_daily_variation", "prices", """
with d as (select chain_id, cast(ts as date) as d, count(*) as n, avg(base_fee) as m, stddev_pop(base_fee) as s from prices where ts >= (select max(ts) from prices) - interval 7 day group by 1, 2)
select chain_id, round(avg(least(greatest(s / (case when m = 0 then 1 else m end), 0), 1)), 6) as variation from d where n >= 2 group by 1""")
def daily_variation(v: Views) -> DataFrame:
    since = v.prices.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    recent = v.prices.join(F.broadcast(since), F.col("ts") >= F.col("since"))
    days = recent.groupBy("chain_id", F.to_date("ts").alias("d")).agg(n_rows().alias("n"), F.avg("base_fee").alias("m"), F.stddev_pop("base_fee").alias("s"))
    cv = F.least(F.greatest(F.col("s") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")), F.lit(0.0)), F.lit(1.0))
    return days.where(F.col("n") >= 2).groupBy("chain_id").agg(F.round(F.avg(cv), 6).alias("variation"))


@add("W08_trend_halves", "prices", """
with r as (select chain_id, base_fee, row_number() over (partition by chain_id order by ts, event_id) as k, count(*) over (partition by chain_id) as n from prices),
h as (select chain_id, avg(case when k <= n // 2 then base_fee end) as a, avg(case when k > n // 2 then base_fee end) as b, stddev_pop(base_fee) as s from r group by 1)
select chain_id, round((b - a) / a * 100, 6) as change, case when (b - a) / a * 100 > 2 then 'up' when (b - a) / a * 100 < -2 then 'down' else 'stable' end as trend, round(greatest(0, 100 - 2 * s), 6) as confidence from h""")
def trend_halves(v: Views) -> DataFrame:
    rows = numbered(v.prices.select("chain_id", "base_fee", "ts", "event_id"), ["chain_id"], ["ts", "event_id"])
    early = F.col("at_row") < F.floor(F.col("all_row") / 2)
    halves = rows.groupBy("chain_id").agg(
        F.avg(F.when(early, F.col("base_fee"))).alias("a"), F.avg(F.when(~early, F.col("base_fee"))).alias("b"), F.stddev_pop("base_fee").alias("s")
    )
    change = (F.col("b") - F.col("a")) / F.col("a") * 100
    trend = F.when(change > 2, "up").when(change < -2, "down").otherwise("stable")
    return halves.select("chain_id", F.round(change, 6).alias("change"), trend.alias("trend"), F.round(F.greatest(F.lit(0.0), 100 - 2 * F.col("s")), 6).alias("confidence"))


@add("W09_rank_by_cost", "transactions", """
with c as (select chain_id, round(sum(fee) / count(*), 6) as cost from transactions group by 1) select chain_id, cost, row_number() over (order by cost, chain_id) as place from c""")
def rank_by_cost(v: Views) -> DataFrame:
    costs = v.transactions.groupBy("chain_id").agg(F.round(F.sum("fee") / n_rows(), 6).alias("cost"))
    return costs.withColumn("place", F.row_number().over(Window.orderBy("cost", "chain_id")))  # one row for each chain


@add("W10_leaderboard", "transactions chains", """
with m as (select chain_id, date_trunc('month', created_at) as mon, 100.0 * count(case when status = 'success' then 1 end) / count(*) as rate from transactions group by 1, 2),
l as (select *, row_number() over (partition by chain_id order by mon desc) as k from m)
select c.name, strftime(mon, '%Y-%m') as latest, round(rate, 6) as rate, row_number() over (order by round(rate, 6) desc, c.name) as place from l join chains c using (chain_id) where k = 1""")
def leaderboard(v: Views) -> DataFrame:
    months = v.transactions.groupBy("chain_id", F.date_trunc("month", "created_at").alias("mon")).agg((100.0 * F.count_if(ok()) / n_rows()).alias("rate"))
    latest = months.groupBy("chain_id").agg(F.max_by(F.struct("mon", "rate"), "mon").alias("m"))
    named = latest.join(v.chains, "chain_id").select("name", F.date_format("m.mon", "yyyy-MM").alias("latest"), F.round("m.rate", 6).alias("rate"))
    return named.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "name")))  # one row for each chain


@add("W11_bursts", "metrics", """
with b as (select user_id, event_id, count(*) over (partition by user_id order by ts range between interval 600 second preceding and current row) as n from metrics)
select user_id, event_id, n as nearby, case when n >= 15 then 'high' when n >= 8 then 'medium' else 'low' end as level from b where n >= 2""")
def bursts(v: Views) -> DataFrame:
    n = F.col("nearby")
    level = F.when(n >= 15, "high").when(n >= 8, "medium").otherwise("low")
    rows = with_recent(v.metrics, ["user_id"], "ts", 600_000_000, {"nearby": lambda w: F.count(F.lit(1)).over(w)})
    return rows.select("user_id", "event_id", "nearby").where(n >= 2).withColumn("level", level)


@add("W12_failure_window", "metrics", """
with f as (select user_id, event_id, avg(case when status_code >= 400 then 1.0 else 0.0 end) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as rate from metrics)
select user_id, event_id, round(rate, 6) as rate, case when rate >= 0.7 then 'high' when rate >= 0.5 then 'medium' else 'low' end as level from f where rate >= 0.3""")
def failure_window(v: Views) -> DataFrame:
    failing = lambda w: F.avg((F.col("status_code") >= 400).cast("double")).over(w.rowsBetween(-9, 0))
    r = F.col("r")
    level = F.when(r >= 0.7, "high").when(r >= 0.5, "medium").otherwise("low")
    rows = with_frames(v.metrics, ["user_id"], ["ts", "event_id"], 9, {"r": failing})
    return rows.where(r >= 0.3).select("user_id", "event_id", F.round(r, 6).alias("rate"), level.alias("level"))


@add("W13_spike_ratio", "tx_lines", """
with s as (select merchant_id, id, line, gas_used, avg(gas_used) over (partition by merchant_id order by ts, id, line rows between 49 preceding and 1 preceding) as mean from tx_lines)
select merchant_id, id, line, round(gas_used / mean, 6) as ratio from s where mean > 0 and gas_used / mean >= 1.5""")
def spike_ratio(v: Views) -> DataFrame:
    mean = lambda w: F.avg("gas_used").over(w.rowsBetween(-49, -1))
    rows = with_frames(v.tx_lines.select("merchant_id", "id", "line", "gas_used", "ts"), ["merchant_id"], ["ts", "id", "line"], 49, {"mean": mean})
    ratio = F.col("gas_used") / F.col("mean")
    return rows.where((F.col("mean") > 0) & (ratio >= 1.5)).select("merchant_id", "id", "line", F.round(ratio, 6).alias("ratio"))


@add("W14_detector_precedence", "metrics", """
with d as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seen,
    count(*) over (partition by user_id order by ts range between interval 600 second preceding and current row) as burst,
    avg(case when status_code >= 400 then 1.0 else 0.0 end) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as failing,
    response_time / nullif(avg(response_time) over (partition by user_id order by ts, event_id rows between 49 preceding and 1 preceding), 0) as spike from metrics)
select user_id, event_id, case when burst >= 3 then 'burst' when failing >= 0.4 then 'failures' else 'spike' end as detected from d where seen >= 5 and (burst >= 3 or failing >= 0.4 or spike >= 4)""")
def detector_precedence(v: Views) -> DataFrame:
    near = with_recent(v.metrics, ["user_id"], "ts", 600_000_000, {"burst": lambda w: F.count(F.lit(1)).over(w)})
    frames = {
        "failing": lambda w: F.avg((F.col("status_code") >= 400).cast("double")).over(w.rowsBetween(-9, 0)),
        "mean": lambda w: F.avg("response_time").over(w.rowsBetween(-49, -1)),
    }
    rows = with_frames(near, ["user_id"], ["ts", "event_id"], 49, frames)
    rows = rows.withColumns({"seen": F.col("at_row") + 1, "spike": F.col("response_time") / F.nullif(F.col("mean"), F.lit(0.0))})
    found = F.when(F.col("burst") >= 3, "burst").when(F.col("failing") >= 0.4, "failures").when(F.col("spike") >= 4, "spike")
    return rows.where((F.col("seen") >= 5) & found.isNotNull()).select("user_id", "event_id", found.alias("detected"))


@add("W15_consecutive_scans", "findings", """
with s as (select file, month, count(*) as n from findings group by 1, 2)
select file, strftime(month, '%Y-%m') as scan, n - lag(n) over (partition by file order by month) as change from s qualify lag(n) over (partition by file order by month) is not null""")
def consecutive_scans(v: Views) -> DataFrame:
    scans = v.findings.groupBy("file", "month").agg(n_rows().alias("n"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("file").orderBy("month"))
    return scans.select("file", F.date_format("month", "yyyy-MM").alias("scan"), change.alias("change")).where(F.col("change").isNotNull())


@add("W16_latest_series", "findings", """
with s as (select month, count(*) as issues from findings group by 1) select strftime(month, '%Y-%m') as scan, issues from s order by month desc limit 20""")
def latest_series(v: Views) -> DataFrame:
    return v.findings.groupBy("month").agg(n_rows().alias("issues")).orderBy(F.desc("month")).limit(20).select(
        F.date_format("month", "yyyy-MM").alias("scan"), "issues"
    )


@add("W17_arrival_gaps", "metrics", """
with g as (select endpoint, epoch_us(ts) - lag(epoch_us(ts)) over (partition by endpoint order by ts, event_id) as gap from metrics)
select endpoint, round(avg(gap) / 1000000.0, 4) as mean_gap_s, max(gap) as longest_us from g group by 1""")
def arrival_gaps(v: Views) -> DataFrame:
    rows = with_frames(v.metrics.select("endpoint", "ts", "event_id"), ["endpoint"], ["ts", "event_id"], 1, {"before": lambda w: F.lag("ts").over(w)})
    gaps = rows.select("endpoint", (F.unix_micros("ts") - F.unix_micros("before")).alias("gap"))
    return gaps.groupBy("endpoint").agg(F.round(F.avg("gap") / 1e6, 4).alias("mean_gap_s"), F.max("gap").alias("longest_us"))


@add("W18_recent_outliers", "tx_lines", """
with m as (select merchant_id, id, line, gas_used, avg(gas_used) over (partition by merchant_id order by ts, id, line rows between 9 preceding and current row) as mean from tx_lines)
select merchant_id, id, line, gas_used from m where gas_used > 1.8 * mean""")
def recent_outliers(v: Views) -> DataFrame:
    mean = lambda w: F.avg("gas_used").over(w.rowsBetween(-9, 0))
    rows = with_frames(v.tx_lines.select("merchant_id", "id", "line", "gas_used", "ts"), ["merchant_id"], ["ts", "id", "line"], 9, {"mean": mean})
    return rows.where(F.col("gas_used") > 1.8 * F.col("mean")).select("merchant_id", "id", "line", "gas_used")


@add("W19_growth_trend", "findings", """
with s as (select file, month, count(*) as n, sum(savings) as w from findings group by 1, 2),
f as (select file, arg_min(n, month) as n0, arg_max(n, month) as n1, arg_min(w, month) as w0, arg_max(w, month) as w1 from s group by 1)
select file, round((n1 - n0) * 100.0 / n0, 6) as growth, case when w1 > w0 * 1.1 then 'rising' when w1 < w0 * 0.9 then 'falling' else 'steady' end as trend from f""")
def growth_trend(v: Views) -> DataFrame:
    scans = v.findings.groupBy("file", "month").agg(n_rows().alias("n"), F.sum("savings").alias("w"))
    ends = scans.groupBy("file").agg(
        *[f(c, "month").alias(c + s) for c in ("n", "w") for f, s in ((F.min_by, "0"), (F.max_by, "1"))]
    )
    trend = F.when(F.col("w1") > F.col("w0") * 1.1, "rising").when(F.col("w1") < F.col("w0") * 0.9, "falling").otherwise("steady")
    return ends.select("file", F.round((F.col("n1") - F.col("n0")) * 100.0 / F.col("n0"), 6).alias("growth"), trend.alias("trend"))


@add("W20_newest_per_key", "transactions", """
with r as (select merchant_id, id, created_at, row_number() over (partition by merchant_id order by created_at desc, id desc) as k from transactions)
select merchant_id, id from r where k <= 5 and created_at >= timestamp '1996-01-01'""")
def newest_per_key(v: Views) -> DataFrame:
    kept = newest(v.transactions, ["merchant_id"], "created_at", "id", 5)
    return kept.where(F.col("created_at") >= F.lit("1996-01-01").cast("timestamp")).select("merchant_id", "id")


@add("W21_min_max_scores", "transactions", """
with b as (select chain_id, avg(fee) as cost, count(*) * 1.0 as speed from transactions group by 1), s as (select min(cost) as c0, max(cost) as c1, min(speed) as s0, max(speed) as s1 from b)
select chain_id, round(0.6 * (1 - case when c1 = c0 then 0 else (cost - c0) / (c1 - c0) end) + 0.4 * case when s1 = s0 then 0 else (speed - s0) / (s1 - s0) end, 6) as score from b, s""")
def min_max_scores(v: Views) -> DataFrame:
    base = v.transactions.groupBy("chain_id").agg(F.avg("fee").alias("cost"), (n_rows() * 1.0).alias("speed"))
    all_rows = Window.partitionBy()  # one row for each chain
    unit = lambda c: F.coalesce((F.col(c) - F.min(c).over(all_rows)) / F.nullif(F.max(c).over(all_rows) - F.min(c).over(all_rows), F.lit(0)), F.lit(0.0))
    return base.select("chain_id", F.round(0.6 * (1 - unit("cost")) + 0.4 * unit("speed"), 6).alias("score"))


@add("W22_ntile_and_distribution", "transactions", """
with c as (select chain_id, count(*) as n from transactions group by 1) select chain_id, ntile(4) over (order by n, chain_id) as quarter, round(cume_dist() over (order by n, chain_id), 6) as share, lead(chain_id) over (order by n, chain_id) as next_chain from c""")
def ntile_and_distribution(v: Views) -> DataFrame:
    w = Window.orderBy("n", "chain_id")  # one row for each chain
    counts = v.transactions.groupBy("chain_id").agg(n_rows().alias("n"))
    return counts.select("chain_id", F.ntile(4).over(w).alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("share"), F.lead("chain_id").over(w).alias("next_chain"))


@add("T01_high_gas", "transactions", "select id, gas_used from transactions where status = 'success' and gas_used > 100000 order by gas_used desc, id limit 10")
def high_gas(v: Views) -> DataFrame:
    return v.transactions.where(ok() & (F.col("gas_used") > 100_000)).select("id", "gas_used").orderBy(F.desc("gas_used"), "id").limit(10)


@add("T02_chain_ranking", "transactions", """
select chain_id, round(100.0 * count(case when status = 'success' then 1 end) / count(*), 6) as rate, count(*) as transactions from transactions group by 1 order by rate desc, transactions desc, chain_id limit 15""")
def chain_ranking(v: Views) -> DataFrame:
    by = v.transactions.groupBy("chain_id").agg(F.round(100.0 * F.count_if(ok()) / n_rows(), 6).alias("rate"), n_rows().alias("transactions"))
    return by.orderBy(F.desc("rate"), F.desc("transactions"), "chain_id").limit(15)


@add("T03_top_savings", "savings", "select scan_id, line, rule_id, gas_saved from savings order by gas_saved desc, scan_id, line limit 25")
def top_savings(v: Views) -> DataFrame:
    return v.savings.select("scan_id", "line", "rule_id", "gas_saved").orderBy(F.desc("gas_saved"), "scan_id", "line").limit(25)


@add("T04_paged", "transactions", "select id, created_at::varchar as created from transactions order by created_at desc, id limit 50 offset 100")
def paged(v: Views) -> DataFrame:
    page = v.transactions.orderBy(F.desc("created_at"), "id").offset(100).limit(50)
    return page.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@add("T06_latest_per_contract", "findings", "select file, arg_max(scan_id, (month, scan_id)) as scan_id from findings group by 1")
def latest_per_contract(v: Views) -> DataFrame:
    return v.findings.groupBy("file").agg(F.max_by("scan_id", F.struct("month", "scan_id")).alias("scan_id"))


@add("T07_history", "transactions", """
with m as (select date_trunc('month', created_at) as mon, count(*) as n from transactions where chain_id = 3 group by 1) select strftime(mon, '%Y-%m') as period, n from m order by mon desc limit 12""")
def history(v: Views) -> DataFrame:
    months = v.transactions.where(F.col("chain_id") == 3).groupBy(F.date_trunc("month", "created_at").alias("mon")).agg(n_rows().alias("n"))
    return months.orderBy(F.desc("mon")).limit(12).select(F.date_format("mon", "yyyy-MM").alias("period"), "n")


@add("T08_most_recent", sql="select doc_id from documents order by created_at desc, doc_id limit 10")
def most_recent(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", "created_at").orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(10).select("doc_id")


@add("T12_queue_positions", "transactions", """
select id, row_number() over (partition by chain_id order by priority, created_at, id) as place from transactions where status = 'pending'""")
def queue_positions(v: Views) -> DataFrame:
    w = Window.partitionBy("chain_id").orderBy("priority", "created_at", "id")
    return v.transactions.where(F.col("status") == "pending").select("id", F.row_number().over(w).alias("place"))


@add("T13_severity_order", "findings", """
select id, severity, confidence from findings order by list_position(['critical', 'high', 'medium', 'low', 'info'], severity), confidence desc, id limit 40""")
def severity_order(v: Views) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), F.col("severity"))
    return v.findings.select("id", "severity", "confidence").orderBy(rank, F.desc("confidence"), "id").limit(40)


@add("T14_top_scored", "findings", """
select id, round(savings * (1 + confidence), 6) as score from findings order by score desc, id limit 5""")
def top_scored(v: Views) -> DataFrame:
    return v.findings.select("id", F.round(F.col("savings") * (1 + F.col("confidence")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)


@add("T15_group_order", "findings", """
with g as (select rule_id, count(*) as members, max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity)) as worst from findings group by 1) select rule_id, members from g order by worst desc, members desc, rule_id limit 12""")
def group_order(v: Views) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ["info", "low", "medium", "high", "critical"])), F.col("severity"))
    groups = v.findings.groupBy("rule_id").agg(n_rows().alias("members"), F.max(rank).alias("worst"))
    return groups.orderBy(F.desc("worst"), F.desc("members"), "rule_id").limit(12).drop("worst")


@add("T17_two_top_lists", "findings", """
with m as (select rule_id, count(*) as n, avg(savings) as mean from findings group by 1)
(select 'invoked' as list, rule_id from m order by n desc, rule_id limit 5) union all (select 'slowest', rule_id from m order by round(mean, 6) desc, rule_id limit 5)""")
def two_top_lists(v: Views) -> DataFrame:
    by = v.findings.groupBy("rule_id").agg(n_rows().alias("n"), F.round(F.avg("savings"), 6).alias("mean"))
    top = lambda name, c: by.orderBy(F.desc(c), "rule_id").limit(5).select(F.lit(name).alias("list"), "rule_id")
    return top("invoked", "n").unionByName(top("slowest", "mean"))


@add("Z07_flag_upsert", sql="""
with p as (select distinct id, accountAddress as a, chainId as c, patternType as t, flaggedTransactions as f, deviationScore as d, severity as s, createdAt as at from suspicious_gas_patterns)
select a as account, c as chain, t as pattern, cast(sum(coalesce(f, 0)) as bigint) as flagged, cast(max(d) as double) as worst, count(*) as updates from p group by 1, 2, 3""")
def flag_upsert(v: Views) -> DataFrame:
    """The state each flag ends in: one row for each account, chain and type."""
    rows = v.raw("suspicious_gas_patterns").dropDuplicates(["id"])
    return rows.groupBy(F.col("accountAddress").alias("account"), F.col("chainId").alias("chain"), F.col("patternType").alias("pattern")).agg(
        F.sum(F.coalesce("flaggedTransactions", F.lit(0))).alias("flagged"), F.max("deviationScore").cast("double").alias("worst"), n_rows().alias("updates")
    )


@add("Z09_running_usage", sql="""
with l as (select distinct id, lower(trim(walletAddress)) as w, cast(amount as double) as a, timestamp as t from gas_subsidy_usage_logs where timestamp is not null)
select w as wallet, id, strftime(t, '%Y-%m-%d') as "day", row_number() over (partition by w, cast(t as date) order by t, id) as nth from l""")
def running_usage(v: Views) -> DataFrame:
    """The place of each log within its wallet's day; the period starts anew each day."""
    logs = v.raw("gas_subsidy_usage_logs").where(F.col("timestamp").isNotNull()).select(
        "id", F.lower(F.trim("walletAddress")).alias("wallet"), F.col("timestamp").alias("t")
    ).dropDuplicates(["id"])
    w = Window.partitionBy("wallet", F.to_date("t")).orderBy("t", "id")
    return logs.select("wallet", "id", F.date_format("t", "yyyy-MM-dd").alias("day"), F.row_number().over(w).cast("long").alias("nth"))


@add("Z12_sliding_limit", "metrics", """
with c as (select user_id, event_id, count(*) over (partition by user_id order by ts range between interval 3600 second preceding and current row) as hour_n from metrics) select user_id, event_id, hour_n from c where hour_n > 1""")
def sliding_limit(v: Views) -> DataFrame:
    rows = with_recent(v.metrics, ["user_id"], "ts", 3_600_000_000, {"hour_n": lambda w: F.count(F.lit(1)).over(w)})
    return rows.select("user_id", "event_id", "hour_n").where(F.col("hour_n") > 1)


@add("Z13_fixed_windows", "metrics", """
with b as (select user_id, unnest([60, 3600, 86400]) as width, epoch_us(ts) // 1000000 as s from metrics) select user_id, width, (s // width) * width as start_s, count(*) as requests from b group by 1, 2, 3 having count(*) > 2""")
def fixed_windows(v: Views) -> DataFrame:
    rows = v.metrics.select("user_id", F.explode(F.array(*map(F.lit, [60, 3600, 86400]))).alias("width"), F.unix_seconds("ts").alias("s"))
    start = F.floor(F.col("s") / F.col("width")) * F.col("width")
    return rows.groupBy("user_id", "width", start.alias("start_s")).agg(n_rows().alias("requests")).where(F.col("requests") > 2)


@add("Z15_tumbling", "prices", """
select chain_id, cast(time_bucket(interval 1 hour, ts) as varchar) as bucket, count(*) as n, round(avg(base_fee), 6) as mean from prices group by 1, 2""")
def tumbling(v: Views) -> DataFrame:
    w = F.window("ts", "1 hour")
    by = v.prices.groupBy("chain_id", w.alias("w")).agg(n_rows().alias("n"), F.round(F.avg("base_fee"), 6).alias("mean"))
    return by.select("chain_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n", "mean")


@add("Z31_sessions", "metrics", """
with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from metrics),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g)
select user_id, cast(min(ts) as varchar) as start_at, count(*) as events from s group by user_id, k""")
def sessions(v: Views) -> DataFrame:
    by = v.metrics.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(n_rows().alias("events"))
    return by.select("user_id", F.col("w.start").cast("string").alias("start_at"), "events")


@add("Z32_hopping", "metrics", """
with h as (select endpoint, unnest([0, 1, 2]) as k, epoch_us(ts) // 1000000 as s from metrics)
select endpoint, (s // 1200 - k) * 1200 as start_s, count(*) as n from h where s < (s // 1200 - k) * 1200 + 3600 group by 1, 2""")
def hopping(v: Views) -> DataFrame:
    by = v.metrics.groupBy("endpoint", F.window("ts", "1 hour", "20 minutes").alias("w")).agg(n_rows().alias("n"))
    return by.select("endpoint", F.unix_seconds("w.start").alias("start_s"), "n")
