"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.plans.query import Register
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add


def mean(column: str, digits: int = 4):
    """Average rounded so that the order of addition doesn't show."""
    return F.round(F.avg(column), digits)


def total(column: str, digits: int = 2):
    return F.round(F.sum(column), digits)


@add("A07_chain_reliability", "transactions chains", """
select c.chain_id, c.name, c.network, count(*) as transactions, count(case when status = 'success' then 1 end) as successful,
  round(count(case when status = 'success' then 1 end) * 100.0 / count(*), 6) as success_rate
from transactions t join chains c on t.chain_id = c.chain_id group by 1, 2, 3""")
def chain_reliability(v: Views) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return v.transactions.join(v.chains, "chain_id").groupBy("chain_id", "name", "network").agg(
        F.count(F.lit(1)).alias("transactions"), ok.alias("successful"),
        F.round(ok * 100.0 / F.count(F.lit(1)), 6).alias("success_rate"),
    )


AS_OF = "2001-06-30 00:00:00"


def ok():
    """The condition of success."""
    return F.col("status") == "success"


def n_rows():
    return F.count(F.lit(1))


@add("A01_daily_gas_by_merchant", "transactions", """
select merchant_id, strftime(created_at, '%Y-%m-%d') as "day", round(sum(gas_used), 2) as gas, round(avg(gas_used), 4) as avg_gas, count(*) as transactions
from transactions where status = 'success' group by 1, 2""")
def daily_gas(v: Views) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return v.transactions.where(ok()).groupBy("merchant_id", day).agg(
        total("gas_used").alias("gas"), mean("gas_used").alias("avg_gas"), n_rows().alias("transactions")
    )


@add("A02_success_metrics", "transactions", """
select count(*) as transactions, count(case when status = 'success' then 1 end) as successful, count(case when status = 'failed' then 1 end) as failed,
  round(avg(gas_used), 4) as avg_gas, round(sum(fee), 4) as fees from transactions""")
def success_metrics(v: Views) -> DataFrame:
    return v.transactions.agg(
        n_rows().alias("transactions"), F.count_if(ok()).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
        mean("gas_used").alias("avg_gas"), total("fee", 4).alias("fees"),
    )


@add("A03_volume_by_chain", "transactions", """
select chain_id, count(*) as transactions, round(sum(gas_used), 2) as gas, round(avg(gas_used), 4) as avg_gas, round(sum(fee), 4) as fees
from transactions group by 1""")
def volume_by_chain(v: Views) -> DataFrame:
    return v.transactions.groupBy("chain_id").agg(
        n_rows().alias("transactions"), total("gas_used").alias("gas"), mean("gas_used").alias("avg_gas"), total("fee", 4).alias("fees")
    )


@add("A04_failed_transactions", "transactions", """
select chain_id, error, count(*) as failures from transactions where status = 'failed' and error is not null
group by 1, 2 order by failures desc, chain_id, error limit 20""")
def failed_transactions(v: Views) -> DataFrame:
    failed = v.transactions.where((F.col("status") == "failed") & F.col("error").isNotNull())
    counts = failed.groupBy("chain_id", "error").agg(n_rows().alias("failures"))
    return counts.orderBy(F.desc("failures"), "chain_id", "error").limit(20)


@add("A05_merchant_analytics", "transactions merchants", """
select m.id, m.name, m.plan, m.country, count(*) as transactions, round(sum(t.gas_used), 2) as gas,
  count(case when t.status = 'success' then 1 end) as successful
from merchants m join transactions t on t.merchant_id = m.id group by 1, 2, 3, 4""")
def merchant_analytics(v: Views) -> DataFrame:
    # A left join whose right side is then filtered keeps matched merchants only.
    joined = v.merchants.join(v.transactions.drop("id"), F.col("id") == F.col("merchant_id"))
    return joined.groupBy("id", "name", "plan", "country").agg(
        n_rows().alias("transactions"), total("gas_used").alias("gas"), F.count_if(ok()).alias("successful")
    )


@add("A06_merchant_growth", "transactions", """
with f as (select merchant_id, min(created_at) as first_at, max(created_at) as last_at from transactions group by 1)
select count(*) as merchants, count(case when first_at >= timestamp '2001-01-01' then 1 end) as joined,
  count(case when last_at < timestamp '2001-01-01' then 1 end) as lapsed,
  round(count(case when first_at >= timestamp '2001-01-01' then 1 end) * 1.0 / count(*), 6) as growth from f""")
def merchant_growth(v: Views) -> DataFrame:
    spans = v.transactions.groupBy("merchant_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    border = F.lit("2001-01-01").cast("timestamp")
    joined = F.count_if(F.col("first_at") >= border)
    return spans.agg(
        n_rows().alias("merchants"), joined.alias("joined"), F.count_if(F.col("last_at") < border).alias("lapsed"),
        F.round(joined * 1.0 / n_rows(), 6).alias("growth"),
    )


@add("A08_gas_volatility", "transactions", """
select chain_id, round(stddev_samp(gas_used), 4) as volatility, round(avg(gas_used), 4) as avg_gas, min(gas_used) as least, max(gas_used) as most
from transactions group by 1 having count(*) > 100""")
def gas_volatility(v: Views) -> DataFrame:
    by = v.transactions.groupBy("chain_id").agg(
        F.round(F.stddev_samp("gas_used"), 4).alias("volatility"), mean("gas_used").alias("avg_gas"),
        F.min("gas_used").alias("least"), F.max("gas_used").alias("most"), n_rows().alias("n"),
    )
    return by.where(F.col("n") > 100).drop("n")


@add("A09_chain_refresh", "transactions chains", """
select c.chain_id, c.name, round(avg(gas_used), 4) as average_gas_price, round(stddev_samp(gas_used), 4) as gas_volatility, count(t.id) as transaction_count,
  round(100.0 * count(case when status = 'success' then 1 end) / greatest(count(t.id), 1), 6) as reliability
from chains c left join transactions t on t.chain_id = c.chain_id group by 1, 2""")
def chain_refresh(v: Views) -> DataFrame:
    count = F.count("id")
    return v.chains.join(v.transactions, "chain_id", "left").groupBy("chain_id", "name").agg(
        mean("gas_used").alias("average_gas_price"), F.round(F.stddev_samp("gas_used"), 4).alias("gas_volatility"),
        count.alias("transaction_count"), F.round(100.0 * F.count_if(ok()) / F.greatest(count, F.lit(1)), 6).alias("reliability"),
    )


@add("A10_analysis_summary", "findings", """
with s as (select scan_id, count(*) as violations, sum(savings) as savings from findings group by 1)
select count(*) as scans, round(avg(violations), 4) as avg_violations, cast(sum(violations) as bigint) as violations, cast(sum(savings) as bigint) as savings from s""")
def analysis_summary(v: Views) -> DataFrame:
    scans = v.findings.groupBy("scan_id").agg(n_rows().alias("violations"), F.sum("savings").alias("savings"))
    return scans.agg(n_rows().alias("scans"), mean("violations").alias("avg_violations"), F.sum("violations").alias("violations"), F.sum("savings").alias("savings"))


@add("A11_top_rules", "findings", """
select rule_id, count(*) as violations, cast(sum(savings) as bigint) as savings from findings group by 1 order by violations desc, rule_id limit 10""")
def top_rules(v: Views) -> DataFrame:
    by = v.findings.groupBy("rule_id").agg(n_rows().alias("violations"), F.sum("savings").alias("savings"))
    return by.orderBy(F.desc("violations"), "rule_id").limit(10)


@add("A12_language_distribution", "sources", """
select lang, count(*) as documents, round(avg(length(source)), 4) as avg_chars, cast(sum(length(source)) as bigint) as chars from sources group by 1""")
def language_distribution(v: Views) -> DataFrame:
    rows = v.sources.select("lang", F.length("source").alias("n"))
    return rows.groupBy("lang").agg(n_rows().alias("documents"), mean("n").alias("avg_chars"), F.sum("n").alias("chars"))


@add("A13_analysis_trend", "findings", """
select strftime(month, '%Y-%m') as "month", count(distinct scan_id) as scans, count(*) as violations from findings group by 1""")
def analysis_trend(v: Views) -> DataFrame:
    return v.findings.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count_distinct("scan_id").alias("scans"), n_rows().alias("violations")
    )


@add("A14_total_savings", "savings", "select cast(coalesce(sum(gas_saved), 0) as bigint) as total from savings")
def total_savings(v: Views) -> DataFrame:
    """Savings of every severity; 0 where there are none."""
    return v.savings.agg(F.coalesce(F.sum("gas_saved"), F.lit(0).cast("long")).alias("total"))


@add("A15_savings_by_project", "savings", """
select project_id, count(distinct scan_id) as scans, count(*) as suggestions, cast(sum(gas_saved) as bigint) as saved from savings group by 1""")
def savings_by_project(v: Views) -> DataFrame:
    return v.savings.groupBy("project_id").agg(
        F.count_distinct("scan_id").alias("scans"), n_rows().alias("suggestions"), F.sum("gas_saved").alias("saved")
    )


@add("A16_savings_by_file", "savings", """
select file, count(*) as suggestions, cast(sum(gas_saved) as bigint) as saved, round(avg(severity), 4) as avg_severity from savings group by 1""")
def savings_by_file(v: Views) -> DataFrame:
    return v.savings.groupBy("file").agg(n_rows().alias("suggestions"), F.sum("gas_saved").alias("saved"), mean("severity").alias("avg_severity"))


@add("A17_savings_by_rule", "savings", """
select rule_id, file as rule_group, count(*) as hits, cast(sum(gas_saved) as bigint) as saved, round(avg(gas_saved), 4) as avg_saved from savings group by 1, 2""")
def savings_by_rule(v: Views) -> DataFrame:
    return v.savings.groupBy("rule_id", F.col("file").alias("rule_group")).agg(
        n_rows().alias("hits"), F.sum("gas_saved").alias("saved"), mean("gas_saved").alias("avg_saved")
    )


@add("A18_savings_series", "savings", """
with b as (
  select gas_saved, scan_id, unnest(['hour', 'day', 'week', 'month']) as bucket, created_at from savings)
select bucket, case bucket when 'hour' then strftime(created_at, '%Y-%m-%d %H:00') when 'day' then strftime(created_at, '%Y-%m-%d')
    when 'week' then strftime(created_at, '%Y-') || lpad(cast((dayofyear(created_at) + 6 - (isodow(created_at) - 1)) // 7 + (case when isodow(date_trunc('year', created_at)) between 2 and 4 then 1 else 0 end) as varchar), 2, '0')
    else strftime(created_at, '%Y-%m') end as period,
  count(*) as suggestions, count(distinct scan_id) as scans, cast(sum(gas_saved) as bigint) as saved
from b group by 1, 2""")
def savings_series(v: Views) -> DataFrame:
    at = F.col("created_at")
    # Weeks begin on Monday; week 1 is the first with four or more days in the year, the days before it are week 0.
    monday = F.weekday(at)
    opening = F.weekday(F.date_trunc("year", at))
    week = F.floor((F.dayofyear(at) + 6 - monday) / 7) + F.when(opening.between(1, 3), 1).otherwise(0)
    forms = {
        "hour": F.date_format(at, "yyyy-MM-dd HH:00"), "day": F.date_format(at, "yyyy-MM-dd"),
        "week": F.concat(F.date_format(at, "yyyy-"), F.lpad(week.cast("string"), 2, "0")), "month": F.date_format(at, "yyyy-MM"),
    }
    buckets = F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), x.alias("period")) for k, x in forms.items()]))
    return v.savings.select("gas_saved", "scan_id", buckets.alias("b")).groupBy("b.bucket", "b.period").agg(
        n_rows().alias("suggestions"), F.count_distinct("scan_id").alias("scans"), F.sum("gas_saved").alias("saved")
    )


@add("A19_savings_by_severity", "savings", """
select ['Info', 'Warning', 'Error', 'Critical'][severity] as severity, count(*) as suggestions, cast(sum(gas_saved) as bigint) as saved from savings group by 1""")
def savings_by_severity(v: Views) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ["Info", "Warning", "Error", "Critical"])), F.col("severity").cast("int"))
    return v.savings.groupBy(label.alias("severity")).agg(n_rows().alias("suggestions"), F.sum("gas_saved").alias("saved"))


@add("A20_dashboard", "savings", """
select 'project' as section, cast(project_id as varchar) as name, cast(sum(gas_saved) as bigint) as saved from savings group by 2
union all select 'file', file, cast(sum(gas_saved) as bigint) from savings group by 2
union all select 'severity', cast(severity as varchar), cast(sum(gas_saved) as bigint) from savings group by 2
union all select 'all', 'all', cast(sum(gas_saved) as bigint) from savings
union all select 'recent', 'all', cast(coalesce(sum(gas_saved), 0) as bigint) from savings where created_at >= timestamp '2001-06-30' - interval 30 day""")
def dashboard(v: Views) -> DataFrame:
    # One pass: every row counts in each section it belongs to.
    recent = F.col("created_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 30 days")
    sections = F.array(
        F.struct(F.lit("project").alias("section"), F.col("project_id").cast("string").alias("name"), F.lit(True).alias("on")),
        F.struct(F.lit("file").alias("section"), F.col("file").alias("name"), F.lit(True).alias("on")),
        F.struct(F.lit("severity").alias("section"), F.col("severity").cast("string").alias("name"), F.lit(True).alias("on")),
        F.struct(F.lit("all").alias("section"), F.lit("all").alias("name"), F.lit(True).alias("on")),
        F.struct(F.lit("recent").alias("section"), F.lit("all").alias("name"), recent.alias("on")),
    )
    rows = v.savings.select("gas_saved", F.explode(sections).alias("s"))
    saved = F.coalesce(F.sum(F.when(F.col("s.on"), F.col("gas_saved"))), F.lit(0).cast("long"))
    return rows.groupBy("s.section", "s.name").agg(saved.alias("saved"))


@add("A21_monthly_spending", "transactions", """
with f as (select chain_id, status, count(*) as n, sum(gas_used) as gas from transactions where created_at >= timestamp '2000-01-01' and created_at < timestamp '2000-02-01' group by 1, 2)
select chain_id, cast(sum(n) as bigint) as transactions, round(sum(gas), 2) as gas, string_agg(status || ':' || n, ',' order by status) as by_status from f group by 1""")
def monthly_spending(v: Views) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp") for x in ("2000-01-01", "2000-02-01"))
    month = v.transactions.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    fine = month.groupBy("chain_id", "status").agg(n_rows().alias("n"), F.sum("gas_used").alias("gas"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string"))))
    return fine.groupBy("chain_id").agg(F.sum("n").alias("transactions"), total("gas").alias("gas"), F.array_join(parts, ",").alias("by_status"))


@add("A22_merchant_detail", "transactions", """
select merchant_id, "year"(created_at) as y, "month"(created_at) as m, count(*) as transactions, round(sum(gas_used), 2) as gas,
  count(distinct status) as statuses, string_agg(distinct status, ',' order by status) as status_set from transactions group by 1, 2, 3""")
def merchant_detail(v: Views) -> DataFrame:
    return v.transactions.groupBy("merchant_id", F.year("created_at").alias("y"), F.month("created_at").alias("m")).agg(
        n_rows().alias("transactions"), total("gas_used").alias("gas"), F.count_distinct("status").alias("statuses"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status_set"),
    )


@add("A23_merchant_hours", "tx_lines", """
select merchant_id, "hour"(ts) as hour_of_day, count(*) as transactions, round(sum(gas_used), 2) as gas,
  round(sum(coalesce(gas_price, 0)) / count(*), 6) as avg_price, round(min(nullif(gas_price, 0)), 6) as least_price, round(max(nullif(gas_price, 0)), 6) as most_price
from tx_lines group by 1, 2""")
def merchant_hours(v: Views) -> DataFrame:
    # Missing prices count as 0 in the average but not in the extremes.
    price = F.nullif(F.col("gas_price"), F.lit(0.0))
    return v.tx_lines.groupBy("merchant_id", F.hour("ts").alias("hour_of_day")).agg(
        n_rows().alias("transactions"), total("gas_used").alias("gas"), F.round(F.sum(F.coalesce("gas_price", F.lit(0.0))) / n_rows(), 6).alias("avg_price"),
        F.round(F.min(price), 6).alias("least_price"), F.round(F.max(price), 6).alias("most_price"),
    )


@add("A24_chain_costs", "transactions", """
select chain_id, round(sum(fee) / count(*), 4) as cost_per_transaction, round(sum(fee), 4) as fees from transactions group by 1""")
def chain_costs(v: Views) -> DataFrame:
    return v.transactions.groupBy("chain_id").agg(F.round(F.sum("fee") / n_rows(), 4).alias("cost_per_transaction"), total("fee", 4).alias("fees"))


@add("A25_report", "transactions", """
select merchant_id, chain_id, count(*) as transactions, count(case when status = 'success' then 1 end) as successful,
  count(case when status <> 'success' then 1 end) as failed, round(sum(fee), 4) as fees from transactions group by 1, 2""")
def report(v: Views) -> DataFrame:
    return v.transactions.groupBy("merchant_id", "chain_id").agg(
        n_rows().alias("transactions"), F.count_if(ok()).alias("successful"), F.count_if(~ok()).alias("failed"), total("fee", 4).alias("fees")
    )


@add("A26_period_anomalies", "transactions", """
with m as (select chain_id, date_trunc('month', created_at) as mon, sum(gas_used) as gas, 100.0 * count(case when status = 'success' then 1 end) / count(*) as rate from transactions group by 1, 2),
l as (select *, lag(gas) over (partition by chain_id order by mon) as gas0, lag(rate) over (partition by chain_id order by mon) as rate0 from m)
select chain_id, strftime(mon, '%Y-%m') as period, round(gas, 2) as gas, gas > 1.5 * gas0 as gas_jump, abs(rate - rate0) > 10 as rate_shift
from l where gas > 1.5 * gas0 or abs(rate - rate0) > 10""")
def period_anomalies(v: Views) -> DataFrame:
    months = v.transactions.groupBy("chain_id", F.date_trunc("month", "created_at").alias("mon")).agg(
        F.sum("gas_used").alias("gas"), (100.0 * F.count_if(ok()) / n_rows()).alias("rate")
    )
    w = Window.partitionBy("chain_id").orderBy("mon")
    both = months.withColumn("gas0", F.lag("gas").over(w)).withColumn("rate0", F.lag("rate").over(w))
    jump, shift = F.col("gas") > 1.5 * F.col("gas0"), F.abs(F.col("rate") - F.col("rate0")) > 10
    return both.where(jump | shift).select(
        "chain_id", F.date_format("mon", "yyyy-MM").alias("period"), F.round("gas", 2).alias("gas"), jump.alias("gas_jump"), shift.alias("rate_shift")
    )


@add("A27_merchant_chain_metrics", "transactions", """
select merchant_id, chain_id, count(*) as transactions, count(case when status = 'success' then 1 end) as success, count(case when status = 'failed' then 1 end) as failed,
  count(case when status = 'pending' then 1 end) as pending, round(100.0 * count(case when status = 'success' then 1 end) / count(*), 2) as rate,
  cast(floor(avg(gas_used) + 0.5) as bigint) as mean_gas from transactions group by 1, 2""")
def merchant_chain_metrics(v: Views) -> DataFrame:
    by = {s: F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "pending")}
    return v.transactions.groupBy("merchant_id", "chain_id").agg(
        n_rows().alias("transactions"), *by.values(), F.round(100.0 * F.count_if(ok()) / n_rows(), 2).alias("rate"), F.floor(F.avg("gas_used") + 0.5).alias("mean_gas")
    )


@add("A28_all_chain_metrics", "transactions", """
select chain_id, count(*) as transactions, round(100.0 * count(case when status = 'success' then 1 end) / count(*), 2) as rate from transactions group by 1""")
def all_chain_metrics(v: Views) -> DataFrame:
    return v.transactions.groupBy("chain_id").agg(n_rows().alias("transactions"), F.round(100.0 * F.count_if(ok()) / n_rows(), 2).alias("rate"))


@add("A29_time_series", "transactions", """
with b as (select unnest(['daily', 'monthly']) as grain, created_at, status, gas_used from transactions)
select grain, case grain when 'daily' then strftime(created_at, '%Y-%m-%d') else strftime(created_at, '%Y-%m') end as bucket,
  count(*) as transactions, count(case when status = 'success' then 1 end) as successful, round(sum(gas_used), 2) as gas from b group by 1, 2""")
def time_series(v: Views) -> DataFrame:
    grains = F.array(
        F.struct(F.lit("daily").alias("grain"), F.date_format("created_at", "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("monthly").alias("grain"), F.date_format("created_at", "yyyy-MM").alias("bucket")),
    )
    return v.transactions.select("status", "gas_used", F.explode(grains).alias("b")).groupBy("b.grain", "b.bucket").agg(
        n_rows().alias("transactions"), F.count_if(ok()).alias("successful"), total("gas_used").alias("gas")
    )


@add("A30_rate_alerts", "transactions", """
with r as (select merchant_id, 100.0 * count(case when status = 'success' then 1 end) / count(*) as rate from transactions group by 1)
select merchant_id, round(rate, 4) as rate, case when rate < 85 then 'critical' else 'warning' end as level from r where rate < 95""")
def rate_alerts(v: Views) -> DataFrame:
    rates = v.transactions.groupBy("merchant_id").agg((100.0 * F.count_if(ok()) / n_rows()).alias("rate"))
    level = F.when(F.col("rate") < 85, "critical").otherwise("warning")
    return rates.where(F.col("rate") < 95).select("merchant_id", F.round("rate", 4).alias("rate"), level.alias("level"))


@add("A31_failure_costs", "transactions", """
with c as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'UNKNOWN']) as category),
f as (select priority, count(*) as failures, sum(cast(round(gas_used * 100) as bigint)) as waste from transactions where status = 'failed' group by 1)
select category, coalesce(failures, 0) as failures, cast(coalesce(waste, 0) as bigint) as waste, cast(coalesce(waste // failures, 0) as bigint) as mean_waste
from c left join f on f.priority = c.category""")
def failure_costs(v: Views) -> DataFrame:
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "UNKNOWN"]
    categories = v.spark.createDataFrame([(n,) for n in names], "category string")
    failed = v.transactions.where(F.col("status") == "failed").groupBy(F.col("priority").alias("category")).agg(
        n_rows().alias("failures"), F.sum(F.round(F.col("gas_used") * 100).cast("long")).alias("waste")
    )
    zero = F.lit(0).cast("long")
    return categories.join(failed, "category", "left").select(
        "category", F.coalesce("failures", zero).alias("failures"), F.coalesce("waste", zero).alias("waste"),
        F.coalesce(F.expr("waste div failures"), zero).alias("mean_waste"),
    )


@add("A32_failure_categories", "transactions", "select priority as category, count(*) as failures from transactions where status = 'failed' group by 1")
def failure_categories(v: Views) -> DataFrame:
    return v.transactions.where(F.col("status") == "failed").groupBy(F.col("priority").alias("category")).agg(n_rows().alias("failures"))


@add("A33_chain_failures", "transactions", """
with c as (select chain_id, priority, count(*) as n from transactions where status = 'failed' group by 1, 2)
select chain_id, cast(sum(n) as bigint) as failures, arg_min(priority, (-n, priority)) as commonest from c group by 1""")
def chain_failures(v: Views) -> DataFrame:
    counts = v.transactions.where(F.col("status") == "failed").groupBy("chain_id", "priority").agg(n_rows().alias("n"))
    first = F.min_by("priority", F.struct(-F.col("n"), F.col("priority")))
    return counts.groupBy("chain_id").agg(F.sum("n").alias("failures"), first.alias("commonest"))


@add("A34_most_active_chain", "transactions", """
with c as (select merchant_id, chain_id, count(*) as n from transactions group by 1, 2)
select merchant_id, coalesce(arg_min(chain_id, (-n, chain_id)), 1) as chain_id from c group by 1""")
def most_active_chain(v: Views) -> DataFrame:
    counts = v.transactions.groupBy("merchant_id", "chain_id").agg(n_rows().alias("n"))
    first = F.min_by("chain_id", F.struct(-F.col("n"), F.col("chain_id")))
    return counts.groupBy("merchant_id").agg(F.coalesce(first, F.lit(1)).alias("chain_id"))


@add("A35_wallet_summary", "transactions", """
select merchant_id, count(case when created_at >= timestamp '2001-06-23' then 1 end) as last_7d, count(case when created_at >= timestamp '2001-05-31' then 1 end) as last_30d,
  round(count(case when status = 'failed' and created_at >= timestamp '2001-05-31' then 1 end) / 30.0, 6) as failures_per_day
from transactions where created_at < timestamp '2001-06-30' group by 1""")
def wallet_summary(v: Views) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp")
    week, month = (F.col("created_at") >= now - F.expr(f"interval {n} days") for n in (7, 30))
    return v.transactions.where(F.col("created_at") < now).groupBy("merchant_id").agg(
        F.count_if(week).alias("last_7d"), F.count_if(month).alias("last_30d"),
        F.round(F.count_if((F.col("status") == "failed") & month) / 30.0, 6).alias("failures_per_day"),
    )


@add("A36_endpoint_stats", sql="""
with m as (select distinct id, endpoint, method, responseTime as t from api_performance_metrics)
select endpoint, method, count(*) as requests, round(avg(t), 4) as mean, min(t) as least, max(t) as most from m where t >= 0 group by 1, 2""")
def endpoint_stats(v: Views) -> DataFrame:
    rows = v.raw("api_performance_metrics").select("id", "endpoint", "method", F.col("responseTime").alias("t"))
    return rows.dropDuplicates(["id"]).where(F.col("t") >= 0).groupBy("endpoint", "method").agg(
        n_rows().alias("requests"), mean("t").alias("mean"), F.min("t").alias("least"), F.max("t").alias("most")
    )


@add("A37_latency_aggregate", "metrics", """
select endpoint, date_trunc('day', ts)::varchar as bucket, count(*) as requests, count(case when status_code >= 200 and status_code < 400 then 1 end) as successful,
  round(quantile_cont(response_time, 0.5), 6) as p50, round(quantile_cont(response_time, 0.9), 6) as p90, round(quantile_cont(response_time, 0.95), 6) as p95,
  round(quantile_cont(response_time, 0.99), 6) as p99, round(stddev_pop(response_time), 6) as deviation from metrics group by 1, 2""")
def latency_aggregate(v: Views) -> DataFrame:
    ranks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    by = v.metrics.groupBy("endpoint", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(
        n_rows().alias("requests"), F.count_if(F.col("status_code").between(200, 399)).alias("successful"),
        F.percentile("response_time", F.array(*[F.lit(r) for r in ranks.values()])).alias("p"), F.round(F.stddev_pop("response_time"), 6).alias("deviation"),
    )
    return by.select("endpoint", "bucket", "requests", "successful", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(ranks)], "deviation")


@add("A38_realtime_summary", "metrics", """
with h as (select * from metrics where ts >= (select max(ts) from metrics) - interval 1 hour)
select endpoint, count(*) as requests, count(case when status_code >= 400 then 1 end) as errors, round(quantile_cont(response_time, 0.95), 6) as p95 from h group by 1""")
def realtime_summary(v: Views) -> DataFrame:
    last = v.metrics.agg(F.max("ts").alias("last"))
    rows = v.metrics.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 1 hour"))
    return rows.groupBy("endpoint").agg(
        n_rows().alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.percentile("response_time", 0.95), 6).alias("p95")
    )


@add("A39_price_stats", "prices", """
select chain_id, round(avg(base_fee), 6) as mean, min(base_fee) as least, max(base_fee) as most, round(stddev_pop(base_fee), 6) as deviation from prices group by 1""")
def price_stats(v: Views) -> DataFrame:
    return v.prices.groupBy("chain_id").agg(
        mean("base_fee", 6).alias("mean"), F.min("base_fee").alias("least"), F.max("base_fee").alias("most"), F.round(F.stddev_pop("base_fee"), 6).alias("deviation")
    )


@add("A40_best_hours", "prices", """
select "hour"(ts) as hour_of_day, round(avg(base_fee + priority_fee), 6) as mean from prices group by 1 order by mean, hour_of_day limit 5""")
def best_hours(v: Views) -> DataFrame:
    by = v.prices.groupBy(F.hour("ts").alias("hour_of_day")).agg(F.round(F.avg(F.col("base_fee") + F.col("priority_fee")), 6).alias("mean"))
    return by.orderBy("mean", "hour_of_day").limit(5)


@add("A41_interval_buckets", "prices", """
with b as (select chain_id, unnest([60, 300, 3600]) as width, epoch_us(ts) // 1000000 as s, cast(floor(base_fee) as bigint) as fee, event_id from prices)
select chain_id, width, (s // width) * width as bucket_s, cast(sum(fee) // count(*) as bigint) as mean_fee, arg_max(event_id, event_id) as last_block from b group by 1, 2, 3""")
def interval_buckets(v: Views) -> DataFrame:
    rows = v.prices.select(
        "chain_id", F.unix_seconds("ts").alias("s"), F.floor("base_fee").alias("fee"), "event_id", F.explode(F.array(*map(F.lit, [60, 300, 3600]))).alias("width")
    )
    return rows.groupBy("chain_id", "width", (F.floor(F.col("s") / F.col("width")) * F.col("width")).alias("bucket_s")).agg(
        F.expr("sum(fee) div count(1)").alias("mean_fee"), F.max_by("event_id", "event_id").alias("last_block")
    )


@add("A42_account_baseline", "tx_lines", """
with c as (select merchant_id, type, count(*) as n from tx_lines where status = 'success' group by 1, 2),
r as (select merchant_id, type, row_number() over (partition by merchant_id order by n desc, type) as k from c),
t as (select merchant_id, string_agg(type, ',' order by k) as types from r where k <= 3 group by 1),
b as (select merchant_id, count(*) as samples, round(avg(gas_used), 4) as mean_gas, round(stddev_pop(gas_used), 4) as deviation,
  round(count(*) / greatest((epoch(max(ts)) - epoch(min(ts))) / 3600.0, 1.0), 8) as per_hour from tx_lines where status = 'success' group by 1)
select merchant_id, samples, mean_gas, deviation, per_hour, types from b join t using (merchant_id) where samples >= 10""")
def account_baseline(v: Views) -> DataFrame:
    good = v.tx_lines.where(ok())
    counts = good.groupBy("merchant_id", "type").agg(n_rows().alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct(-F.col("n"), "type"))), 1, 3)
    types = counts.groupBy("merchant_id").agg(F.array_join(F.transform(ranked, lambda x: x["type"]), ",").alias("types"))
    hours = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 3600.0
    base = good.groupBy("merchant_id").agg(
        n_rows().alias("samples"), mean("gas_used").alias("mean_gas"), F.round(F.stddev_pop("gas_used"), 4).alias("deviation"),
        F.round(n_rows() / F.greatest(hours, F.lit(1.0)), 8).alias("per_hour"),
    )
    return base.where(F.col("samples") >= 10).join(types, "merchant_id")


@add("A43_chain_scores", "transactions", """
with b as (select chain_id, 100.0 * count(case when status = 'success' then 1 end) / count(*) as rate, avg(gas_used) as mean, stddev_pop(gas_used) as sd from transactions group by 1)
select chain_id, round(rate, 2) as success_rate, round(mean, 2) as mean_gas, round(sd / mean, 6) as volatility, round(rate * (1 - least(sd / mean, 1)), 4) as stability from b""")
def chain_scores(v: Views) -> DataFrame:
    base = v.transactions.groupBy("chain_id").agg(
        (100.0 * F.count_if(ok()) / n_rows()).alias("rate"), F.avg("gas_used").alias("mean"), F.stddev_pop("gas_used").alias("sd")
    )
    cv = F.col("sd") / F.col("mean")
    return base.select(
        "chain_id", F.round("rate", 2).alias("success_rate"), F.round("mean", 2).alias("mean_gas"), F.round(cv, 6).alias("volatility"),
        F.round(F.col("rate") * (1 - F.least(cv, F.lit(1.0))), 4).alias("stability"),
    )


@add("A44_flag_statistics", sql="""
with p as (select distinct id, severity, status, createdAt from suspicious_gas_patterns)
select severity, status, count(*) as flags, count(case when createdAt >= (select max(createdAt) from p) - interval 1 day then 1 end) as last_day from p group by 1, 2""")
def flag_statistics(v: Views) -> DataFrame:
    flags = v.raw("suspicious_gas_patterns").select("id", "severity", "status", "createdAt").dropDuplicates(["id"])
    last = flags.agg((F.max("createdAt") - F.expr("interval 1 day")).alias("since"))
    return flags.join(F.broadcast(last)).groupBy("severity", "status").agg(
        n_rows().alias("flags"), F.count_if(F.col("createdAt") >= F.col("since")).alias("last_day")
    )


@add("A45_patterns_by_chain", sql="select chainId as chain_id, count(distinct id) as patterns from suspicious_gas_patterns group by 1")
def patterns_by_chain(v: Views) -> DataFrame:
    return v.raw("suspicious_gas_patterns").groupBy(F.col("chainId").alias("chain_id")).agg(F.count_distinct("id").alias("patterns"))


@add("A46_cap_summary", sql="""
with c as (select distinct id, status, currentUsage as u, userId from gas_subsidy_caps)
select coalesce(status, '?') as status, count(*) as caps, cast(sum(u) as double) as used from c group by 1""")
def cap_summary(v: Views) -> DataFrame:
    caps = v.raw("gas_subsidy_caps").select("id", "status", "currentUsage").dropDuplicates(["id"])
    return caps.groupBy(F.coalesce("status", F.lit("?")).alias("status")).agg(n_rows().alias("caps"), F.sum("currentUsage").cast("double").alias("used"))


@add("A50_endpoint_health", sql="""
with m as (select distinct id, endpoint, statusCode as c, responseTime as t from api_performance_metrics)
select endpoint, round(100.0 * count(case when c < 500 then 1 end) / count(*), 6) as uptime, round(avg(case when c < 500 and t >= 0 then t end), 4) as mean_ms,
  min(case when c < 500 and t >= 0 then t end) as least_ms, max(case when c < 500 and t >= 0 then t end) as most_ms from m group by 1""")
def endpoint_health(v: Views) -> DataFrame:
    rows = v.raw("api_performance_metrics").select("id", "endpoint", F.col("statusCode").alias("c"), F.col("responseTime").alias("t")).dropDuplicates(["id"])
    up = F.when((F.col("c") < 500) & (F.col("t") >= 0), F.col("t"))
    return rows.groupBy("endpoint").agg(
        F.round(100.0 * F.count_if(F.col("c") < 500) / n_rows(), 6).alias("uptime"), F.round(F.avg(up), 4).alias("mean_ms"), F.min(up).alias("least_ms"), F.max(up).alias("most_ms")
    )


@add("A52_scan_breakdown", "findings", """
select scan_id, severity, count(*) as issues from findings group by 1, 2""")
def scan_breakdown(v: Views) -> DataFrame:
    maps = v.findings.groupBy("scan_id", "severity").agg(n_rows().alias("n")).groupBy("scan_id").agg(
        F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity")
    )
    return maps.select("scan_id", F.explode("by_severity").alias("severity", "issues"))


@add("A53_scan_statistics", "findings", """
select count(distinct scan_id) as scans, count(distinct file) as contracts, count(*) as issues, strftime(min(month), '%Y-%m') as first_month, strftime(max(month), '%Y-%m') as last_month from findings""")
def scan_statistics(v: Views) -> DataFrame:
    return v.findings.agg(
        F.count_distinct("scan_id").alias("scans"), F.count_distinct("file").alias("contracts"), n_rows().alias("issues"),
        F.date_format(F.min("month"), "yyyy-MM").alias("first_month"), F.date_format(F.max("month"), "yyyy-MM").alias("last_month"),
    )


@add("A54_contract_summary", "findings", """
with s as (select file, scan_id, month, count(*) as n from findings group by 1, 2, 3)
select file, count(distinct scan_id) as scans, arg_max(scan_id, (month, scan_id)) as latest, cast(sum(n) as bigint) as issues, round(sum(n) * 1.0 / count(distinct scan_id), 6) as mean_issues from s group by 1""")
def contract_summary(v: Views) -> DataFrame:
    per = v.findings.groupBy("file", "scan_id", "month").agg(n_rows().alias("n"))
    scans = F.count_distinct("scan_id")
    return per.groupBy("file").agg(
        scans.alias("scans"), F.max_by("scan_id", F.struct("month", "scan_id")).alias("latest"), F.sum("n").alias("issues"),
        F.round(F.sum("n") * 1.0 / scans, 6).alias("mean_issues"),
    )


@add("A55_zero_filled_statistics", "sources", """
with k as (select unnest(['en', 'de', 'fr', 'es', 'it', 'pt']) as lang)
select k.lang, count(s.file) as documents, round(coalesce(avg(length(s.source)), 0), 4) as mean_chars from k left join sources s on s.lang = k.lang group by 1""")
def zero_filled_statistics(v: Views) -> DataFrame:
    known = v.spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it", "pt")], "lang string")
    counts = v.sources.groupBy("lang").agg(n_rows().alias("n"), F.avg(F.length("source")).alias("mean"))
    return known.join(counts, "lang", "left").select(
        "lang", F.coalesce("n", F.lit(0).cast("long")).alias("documents"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean_chars")
    )


@add("A56_finding_summary", "findings", """
select count(*) as total, count(case when severity = 'critical' then 1 end) as critical, count(case when severity = 'high' then 1 end) as high,
  count(case when severity = 'medium' then 1 end) as medium, count(case when severity = 'low' then 1 end) as low, count(case when severity = 'info' then 1 end) as info,
  cast(nullif(sum(savings), 0) as bigint) as savings from findings""")
def finding_summary(v: Views) -> DataFrame:
    return v.findings.agg(
        n_rows().alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.nullif(F.sum("savings"), F.lit(0).cast("long")).alias("savings"),
    )


@add("A57_rule_metrics", "findings", """
select rule_id, count(*) as runs, cast(sum(savings) as bigint) as total, min(savings) as least, max(savings) as most, round(avg(savings), 6) as mean,
  count(case when severity = 'critical' then 1 end) as errors from findings group by 1""")
def rule_metrics(v: Views) -> DataFrame:
    return v.findings.groupBy("rule_id").agg(
        n_rows().alias("runs"), F.sum("savings").alias("total"), F.min("savings").alias("least"), F.max("savings").alias("most"), mean("savings", 6).alias("mean"),
        F.count_if(F.col("severity") == "critical").alias("errors"),
    )


@add("A59_coverage", "findings", """
with r as (select split_part(rule_id, ' ', 1) as category, rule_id, max(case when severity = 'critical' then 1 else 0 end) as hit from findings group by 1, 2)
select category, count(*) as rules, cast(sum(hit) as bigint) as executed, round(100.0 * sum(hit) / count(*), 4) as coverage from r group by 1""")
def coverage(v: Views) -> DataFrame:
    rules = v.findings.groupBy(F.split("rule_id", " ")[0].alias("category"), "rule_id").agg(F.max((F.col("severity") == "critical").cast("long")).alias("hit"))
    return rules.groupBy("category").agg(n_rows().alias("rules"), F.sum("hit").alias("executed"), F.round(100.0 * F.sum("hit") / n_rows(), 4).alias("coverage"))


@add("A60_node_coverage", "findings", """
select file, count(distinct line_no) as analysed, round(coalesce(100.0 * count(distinct case when severity <> 'info' then line_no end) / nullif(count(distinct line_no), 0), 100), 4) as coverage from findings group by 1""")
def node_coverage(v: Views) -> DataFrame:
    lines, useful = F.count_distinct("line_no"), F.count_distinct(F.when(F.col("severity") != "info", F.col("line_no")))
    share = F.coalesce(100.0 * useful / F.nullif(lines, F.lit(0).cast("long")), F.lit(100.0))
    return v.findings.groupBy("file").agg(lines.alias("analysed"), F.round(share, 4).alias("coverage"))


@add("A61_correlation_groups", "findings", """
with g as (select file, line_no, count(*) as members, count(distinct rule_id) as rules, string_agg(distinct severity, ',' order by severity) as severities from findings group by 1, 2)
select * from g where members >= 2""")
def correlation_groups(v: Views) -> DataFrame:
    groups = v.findings.groupBy("file", "line_no").agg(
        n_rows().alias("members"), F.count_distinct("rule_id").alias("rules"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities")
    )
    return groups.where(F.col("members") >= 2)


@add("A62_summary_figures", "findings", """
select count(distinct rule_id) as rules, count(distinct file) as files, round(avg(confidence), 3) as confidence, count(*) as findings from findings""")
def summary_figures(v: Views) -> DataFrame:
    return v.findings.agg(
        F.count_distinct("rule_id").alias("rules"), F.count_distinct("file").alias("files"), mean("confidence", 3).alias("confidence"), n_rows().alias("findings")
    )


@add("A64_conflict_summary", "findings", """
with p as (select a.file, a.line_no, least(a.rule_id, b.rule_id) as left_rule, greatest(a.rule_id, b.rule_id) as right_rule
  from (select distinct file, line_no, rule_id from findings) a join (select distinct file, line_no, rule_id from findings) b on a.file = b.file and a.line_no = b.line_no and a.rule_id < b.rule_id)
select left_rule, right_rule, count(*) as conflicts from p group by 1, 2 order by conflicts desc, left_rule, right_rule limit 5""")
def conflict_summary(v: Views) -> DataFrame:
    one = v.findings.select("file", "line_no", "rule_id").distinct()
    other = one.select("file", "line_no", F.col("rule_id").alias("right_rule"))
    pairs = one.withColumnRenamed("rule_id", "left_rule").join(other, ["file", "line_no"]).where(F.col("left_rule") < F.col("right_rule"))
    counts = pairs.groupBy("left_rule", "right_rule").agg(n_rows().alias("conflicts"))
    return counts.orderBy(F.desc("conflicts"), "left_rule", "right_rule").limit(5)


@add("A66_estimate_totals", "tx_lines", """
select type, round(sum(gas_used), 2) as before, round(sum(gas_used * case status when 'success' then 0.8 else 1.0 end), 2) as after,
  round(100.0 * (1 - sum(gas_used * case status when 'success' then 0.8 else 1.0 end) / sum(gas_used)), 6) as saving from tx_lines group by 1""")
def estimate_totals(v: Views) -> DataFrame:
    after = F.sum(F.col("gas_used") * F.when(ok(), 0.8).otherwise(1.0))
    return v.tx_lines.groupBy("type").agg(
        total("gas_used").alias("before"), F.round(after, 2).alias("after"), F.round(100.0 * (1 - after / F.sum("gas_used")), 6).alias("saving")
    )


@add("A67_rule_gas_report", "findings savings", """
with e as (select rule_id, avg(gas_saved) as estimate from savings group by 1)
select f.rule_id, count(*) as findings, round(sum(estimate), 4) as estimated from findings f join e on f.rule_id = e.rule_id group by 1""")
def rule_gas_report(v: Views) -> DataFrame:
    # The estimate is the same for all findings of a rule, so the counts meet it instead of the rows.
    counts = v.findings.groupBy("rule_id").agg(n_rows().alias("findings"))
    estimates = v.savings.groupBy("rule_id").agg(F.avg("gas_saved").alias("estimate"))
    return counts.join(estimates, "rule_id").select("rule_id", "findings", F.round(F.col("findings") * F.col("estimate"), 4).alias("estimated"))


@add("A68_frequency_diff", "findings", """
with a as (select rule_id, count(*) as n from findings where month < timestamp '1998-01-01' group by 1), b as (select rule_id, count(*) as n from findings where month >= timestamp '1998-01-01' group by 1)
select coalesce(a.rule_id, b.rule_id) as rule_id, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.rule_id = b.rule_id""")
def frequency_diff(v: Views) -> DataFrame:
    # Both sides come from one scan: a later finding counts 1, an earlier one -1.
    late = F.col("month") >= F.lit("1998-01-01").cast("timestamp")
    return v.findings.groupBy("rule_id").agg(F.sum(F.when(late, 1).otherwise(-1)).alias("delta"))


@add("A69_hotspots", "tx_lines", """
select merchant_id, count(case when type = 'R' then 1 end) as reads, count(case when type <> 'R' then 1 end) as writes, count(*) as accesses from tx_lines group by 1""")
def hotspots(v: Views) -> DataFrame:
    read = F.col("type") == "R"
    return v.tx_lines.groupBy("merchant_id").agg(F.count_if(read).alias("reads"), F.count_if(~read).alias("writes"), n_rows().alias("accesses"))


@add("A70_single_rule_rollup", "findings", """
select file, count(case when severity = 'high' then 1 end) * 2.5 as kilobytes from findings group by 1""")
def single_rule_rollup(v: Views) -> DataFrame:
    return v.findings.groupBy("file").agg((F.count_if(F.col("severity") == "high") * 2.5).alias("kilobytes"))


@add("A71_user_features", "metrics", """
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from metrics)
select user_id, count(*) as events, round(avg(gap) / 1000000.0, 4) as mean_gap_s, round(avg(case when status_code >= 400 then 1.0 else 0.0 end), 6) as error_rate from g group by 1""")
def user_features(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = v.metrics.withColumn("gap", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w))
    return rows.groupBy("user_id").agg(
        n_rows().alias("events"), F.round(F.avg("gap") / 1e6, 4).alias("mean_gap_s"), F.round(F.avg((F.col("status_code") >= 400).cast("double")), 6).alias("error_rate")
    )


@add("A72_z_scores", "metrics", """
with f as (select user_id, count(*) as n, avg(response_time) as mean from metrics group by 1), s as (select avg(n) as an, stddev_pop(n) as sn, avg(mean) as am, stddev_pop(mean) as sm from f)
select user_id, round(case when sn = 0 then 0 else (n - an) / sn end, 6) as z_events, round(case when sm = 0 then 0 else (mean - am) / sm end, 6) as z_mean from f, s""")
def z_scores(v: Views) -> DataFrame:
    features = v.metrics.groupBy("user_id").agg(n_rows().alias("n"), F.avg("response_time").alias("mean"))
    model = features.agg(
        F.avg("n").alias("an"), F.stddev_pop("n").alias("sn"), F.avg("mean").alias("am"), F.stddev_pop("mean").alias("sm")
    )  # one row
    z = lambda x, a, s: F.round(F.when(F.col(s) == 0, 0.0).otherwise((F.col(x) - F.col(a)) / F.col(s)), 6)
    return features.join(F.broadcast(model)).select("user_id", z("n", "an", "sn").alias("z_events"), z("mean", "am", "sm").alias("z_mean"))


@add("A73_audit_summary", "findings", """
with k as (select unnest(['info', 'low', 'medium', 'high', 'critical', 'blocker']) as severity)
select k.severity, count(f.id) as findings, cast(coalesce(sum(f.savings), 0) as bigint) as savings from k left join findings f on f.severity = k.severity group by 1""")
def audit_summary(v: Views) -> DataFrame:
    known = v.spark.createDataFrame([(x,) for x in ("info", "low", "medium", "high", "critical", "blocker")], "severity string")
    counts = v.findings.groupBy("severity").agg(n_rows().alias("n"), F.sum("savings").alias("s"))
    zero = F.lit(0).cast("long")
    return known.join(counts, "severity", "left").select("severity", F.coalesce("n", zero).alias("findings"), F.coalesce("s", zero).alias("savings"))


@add("A74_labelled_histograms", "metrics", """
select 'response' as name, 'code=' || status_code || ',endpoint=' || endpoint as labels, count(*) as n, round(sum(response_time), 4) as total,
  min(response_time) as least, max(response_time) as most, arg_max(response_time, (ts, event_id)) as gauge from metrics group by 2""")
def labelled_histograms(v: Views) -> DataFrame:
    labels = F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("code"), F.col("status_code").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return v.metrics.groupBy(F.lit("response").alias("name"), text.alias("labels")).agg(
        n_rows().alias("n"), F.round(F.sum("response_time"), 4).alias("total"), F.min("response_time").alias("least"), F.max("response_time").alias("most"),
        F.max_by("response_time", F.struct("ts", "event_id")).alias("gauge"),
    )


@add("A75_dominant_language", "sources", """
with c as (select origin, coalesce(lang, 'unknown') as lang, count(*) as n from sources group by 1, 2) select origin, arg_min(lang, (-n, lang)) as lang from c group by 1""")
def dominant_language(v: Views) -> DataFrame:
    counts = v.sources.groupBy("origin", F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(n_rows().alias("n"))
    return counts.groupBy("origin").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))


@add("A77_grouped_and_sorted", "findings", """
select file, rule_id, severity, row_number() over (partition by file, rule_id, severity order by savings desc nulls last, id) as place, id,
  count(*) over (partition by file, rule_id, severity) as members from findings""")
def grouped_and_sorted(v: Views) -> DataFrame:
    """Every finding with its place in its group of file, rule and severity, by savings (most first, none last) and id.

    Rows are ordered only within a chunk, the findings of a group with the same savings; chunks are placed by their
    counts.
    """
    keys = ["file", "rule_id", "severity"]
    # A struct of NULLs equals another, so that groups without a file or rule and findings without savings stay.
    rows = v.findings.select(F.struct(*keys, "savings").alias("chunk"), F.struct(*keys).alias("group"), "id")
    counts = rows.groupBy("chunk", "group").agg(n_rows().alias("n"))
    group = Window.partitionBy("group")
    before = F.sum("n").over(group.orderBy(F.col("chunk.savings").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    chunks = counts.select("chunk", F.coalesce(before, F.lit(0).cast("long")).alias("before"), F.sum("n").over(group).alias("members"))
    placed = rows.select("chunk", "id", F.row_number().over(Window.partitionBy("chunk").orderBy("id")).alias("k")).join(chunks, "chunk")
    return placed.select(*(F.col(f"chunk.{k}").alias(k) for k in keys), (F.col("before") + F.col("k")).alias("place"), "id", "members")


@add("A80_rollup", "transactions", """
select chain_id, status, grouping(chain_id) * 2 + grouping(status) as level, count(*) as transactions, round(sum(gas_used), 2) as gas
from transactions group by rollup (chain_id, status)""")
def rollup(v: Views) -> DataFrame:
    return v.transactions.rollup("chain_id", "status").agg(F.grouping_id().alias("level"), n_rows().alias("transactions"), total("gas_used").alias("gas"))


@add("A81_approximate", "metrics", """
select endpoint, count(*) as requests, true as close_median, true as close_users from metrics group by 1""")
def approximate(v: Views) -> DataFrame:
    """Approximate median and distinct count, each held against the exact one."""
    exact, rough = F.percentile("response_time", 0.5), F.percentile_approx("response_time", 0.5, 1000)
    users, about = F.count_distinct("user_id"), F.approx_count_distinct("user_id", 0.02)
    both = v.metrics.groupBy("endpoint").agg(n_rows().alias("requests"), exact.alias("e"), rough.alias("r"), users.alias("u"), about.alias("a"))
    return both.select(
        "endpoint", "requests", (F.abs(F.col("e") - F.col("r")) <= 0.05 * F.abs("e") + 1).alias("close_median"),
        (F.abs(F.col("u") - F.col("a")) <= 0.1 * F.col("u") + 1).alias("close_users"),
    )
