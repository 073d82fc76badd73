"""Queries of the core data-processing problems (p1 to p4 and p6) over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import name_key
from lodestream.operators import grid, intervals, outliers, rolling, units
from lodestream.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous periods of each wallet and cap type, and the gaps between them."""
    caps = table(spark, folder, "gas_subsidy_caps").select(
        name_key(F.col("walletAddress")).alias("wallet_address"), name_key(F.col("capType")).alias("cap_type"), "periodStart", "periodEnd"
    )
    return intervals.periods_and_gaps(caps, ["wallet_address", "cap_type"], "periodStart", "periodEnd")


#: Physical bounds of the readings: whole gas units up to the block limit, a positive price, a score of at least zero.
LOG_BOUNDS = {
    "gasUsed": lambda v: (v > 0) & (v == F.floor(v)) & (v <= 60_000_000),
    "gasPrice": lambda v: v > 0,
}
PATTERN_BOUNDS = {"deviationScore": lambda v: v >= 0}


def p2_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every implausible reading of the two tables: record_table, id, account, measure, reason, score, excess."""
    parts = []
    for name, bounds in (("gas_pattern_detection_logs", LOG_BOUNDS), ("suspicious_gas_patterns", PATTERN_BOUNDS)):
        flagged = outliers.flag_implausible(table(spark, folder, name), "id", "accountAddress", "createdAt", bounds)
        parts.append(
            flagged.select(F.lit(name).alias("record_table"), "id", F.col("accountAddress").alias("account"), "measure", "reason", "score", "excess")
        )
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the two tables with an impossible or stuck reading, or a spike beyond the account's range by more than its width."""
    certain = (F.col("reason") != "spike") | (F.col("excess") > 0)
    return p2_readings(spark, folder).where(certain).select("record_table", "id").distinct()


def p3_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of cost and gas for each merchant and day."""
    return rolling.trailing_totals(
        table(spark, folder, "gas_transactions"), ["transactionHash"], "createdAt", name_key(F.col("merchantId")), "timestamp",
        {"cost_usd": "totalGasCostUsd", "gas": "gasUsed"}, entity_name="merchant_id",
    )


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of :func:`p3_rolling` the columns that are exact whole numbers, and maxima: for the check against SQL."""
    return p3_rolling(spark, folder).select(
        "merchant_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days", "n_rows",
        F.col("active_days").cast("long").alias("active_days"), F.col("sum_gas").cast("long").alias("sum_gas"), "max_cost_usd",
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The days whose trailing window has no transaction of the merchant."""
    return p3_rolling(spark, folder).where(F.col("n_rows") == 0).select(
        "merchant_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days"
    )


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """recommendedFeeRate and networkLoad on five-minute slots for each chain, filled or marked missing."""
    usable = (F.col("recommendedFeeRate") > 0) & F.col("networkLoad").between(0, 100)
    return regular(spark, folder, usable)


def regular(spark: SparkSession, folder: str, usable) -> DataFrame:
    return grid.regular_grid(
        table(spark, folder, "gas_price_snapshots"), "id", "chainId", "timestamp", ["recommendedFeeRate", "networkLoad"], usable
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The slots without a usable reading."""
    return p4_grid(spark, folder).where(F.col("n_usable") == 0).select(F.col("chainId").alias("chain_id"), "slot_s")


def p6_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every cap, usage log and estimate with its amount in wei or stroops."""
    conversions = units.conversion_table(spark)
    records = units.cap_units(table(spark, folder, "gas_subsidy_caps"))
    records = records.unionByName(units.usage_units(table(spark, folder, "gas_subsidy_usage_logs")))
    records = records.unionByName(units.estimate_units(table(spark, folder, "dynamic_gas_estimates")))
    return units.canonical_amounts(records, conversions)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records whose recorded number isn't in wei or stroops, with the power of ten that turns it into them."""
    return p6_amounts(spark, folder).where((F.col("exp10") != 0) & F.col("amount").isNotNull()).select("record_table", "id", "exp10")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_readings": p2_readings,
    "p3_found": p3_found,
    "p3_rolling": p3_rolling,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p6_found": p6_found,
    "p6_amounts": p6_amounts,
}

_KEY = "lower(trim(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')))"
_P3 = f"""
with v as (
  select transactionHash as h, {_KEY.format('merchantId')} as m, timestamp as ts, totalGasCostUsd as c, gasUsed as g,
         row_number() over (partition by transactionHash order by createdAt desc) as k
  from gas_transactions where merchantId is not null and trim(merchantId) <> '' and timestamp is not null),
t as (select h, m, ts, case when cast(c as varchar) like '%nan' then null else c end as c, g from v where k = 1),
d as (select m, cast(ts as date) as d, count(*) as n, max(c) as c, coalesce(sum(g), 0) as g from t group by 1, 2),
k as (select m, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from d group by 1),
w as (select m, d, unnest([7, 30]) as w from k),
r as (
  select w.m as merchant_id, strftime(w.d, '%Y-%m-%d') as "day", w.w as window_days, coalesce(sum(d.n), 0) as n_rows,
         count(d.d) as active_days, coalesce(sum(d.g), 0) as sum_gas, max(d.c) as max_cost_usd
  from w left join d on d.m = w.m and d.d between w.d - (w.w - 1) and w.d group by 1, 2, 3)
"""
_P2_BLOCK = """
{0}_k as (select distinct id, accountAddress as a, createdAt as t, cast({2} as double) as v from {1} where id is not null and accountAddress is not null),
{0}_n as (select a from {0}_k group by a having count(*) >= 30),
{0}_v as (select id, a, t, v, {3} as ok, case when {3} and v > 0 then log10(v) end as l from {0}_k where v is not null),
{0}_q as (select a, quantile_disc(l, 0.1) as q1, quantile_disc(l, 0.9) as q9, count(*) as n from {0}_v group by a),
{0}_z as (select a, count(distinct v) as dv from {0}_v group by a),
{0}_s as (select v.a, min(l) as lo, max(l) as hi from {0}_v v join {0}_q q on v.a = q.a where l between q1 - (q9 - q1) and q9 + (q9 - q1) group by v.a),
{0}_i as (select id, a, v, row_number() over (partition by a order by t, id) - row_number() over (partition by a, v order by t, id) as island from {0}_v),
{0}_r as (select id, a, count(*) over (partition by a, v, island) as run from {0}_i),
{0}_f as (
  select id from {0}_v where not ok
  union select v.id from {0}_v v join {0}_n using (a) join {0}_s s on v.a = s.a where greatest(l - hi, lo - l) > hi - lo and greatest(l - hi, lo - l) > 0
  union select r.id from {0}_r r join {0}_n using (a) join {0}_q q on r.a = q.a join {0}_z z on r.a = z.a where run >= 6 and dv >= 0.5 * q.n)
"""

ORACLE = {
    "p1_found": f"""
with r as (
  select {_KEY.format('walletAddress')} as w, {_KEY.format('capType')} as c, epoch_us(periodStart) as s, epoch_us(periodEnd) as e
  from gas_subsidy_caps where periodEnd > periodStart and walletAddress is not null and capType is not null),
m as (select *, max(e) over (partition by w, c order by s, e rows between unbounded preceding and 1 preceding) as before from r),
g as (select *, sum(case when before is null or s > before + 1000000 then 1 else 0 end) over (partition by w, c order by s, e rows unbounded preceding) as i from m),
p as (select w, c, min(s) as s, max(e) as e from g group by w, c, i),
n as (select *, lead(s) over (partition by w, c order by s) as next from p)
select w as wallet_address, c as cap_type, 'period' as kind, s as start_us, e as end_us from p
union all select w, c, 'gap', e, next from n where next is not null""",
    "p2_found": "with "
    + ",".join(
        [
            _P2_BLOCK.format("g", "gas_pattern_detection_logs", "gasUsed", "(v > 0 and v = floor(v) and v <= 60000000)"),
            _P2_BLOCK.format("p", "gas_pattern_detection_logs", "gasPrice", "(v > 0)"),
            _P2_BLOCK.format("d", "suspicious_gas_patterns", "deviationScore", "(v >= 0)"),
        ]
    )
    + """
select 'gas_pattern_detection_logs' as record_table, id from (select id from g_f union select id from p_f)
union all select 'suspicious_gas_patterns', id from d_f""",
    "p3_found": _P3 + "select merchant_id, \"day\", window_days from r where n_rows = 0",
    "p3_counts": _P3
    + """select merchant_id, "day", window_days, cast(n_rows as bigint) as n_rows, active_days, cast(sum_gas as bigint) as sum_gas, max_cost_usd from r""",
    "p4_found": """
with r as (
  select chainId as c, epoch_us(timestamp) // 300000000 as s, coalesce(recommendedFeeRate > 0 and networkLoad between 0 and 100, false) as ok
  from gas_price_snapshots where chainId is not null and timestamp is not null),
g as (select c, unnest(generate_series(min(s), max(s))) as s from r group by c)
select g.c as chain_id, g.s * 300 as slot_s from g anti join (select c, s from r where ok) u on g.c = u.c and g.s = u.s""",
}
