"""Reading and writing as plans (S, K), and batch forms of further monitors (Z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import newest, with_frames
from lodestream.plans.aggregates import n_rows
from lodestream.plans.query import Register
from lodestream.plans.relational import matching, stamp
from lodestream.plans.views import Views
from lodestream.sources.files import path_filter
from lodestream.sources.sinks import csv_line, fixed, retained, sarif_result

QUERIES = Register()
add = QUERIES.add


@add("S02_filtered_find", "transactions", "select id from transactions where merchant_id = 7 and created_at between timestamp '1993-01-01' and timestamp '1997-12-31'")
def filtered_find(v: Views) -> DataFrame:
    return matching(v.transactions, merchant_id=7).where(F.col("created_at").between(stamp("1993-01-01"), stamp("1997-12-31"))).select("id")


@add("S03_collection_scan", sql="""
select transactionHash as hash, max(case when regexp_matches(totalGasCostEth, '^[0-9]+(\\.[0-9]+)?$') then cast(totalGasCostEth as double) end) as eth from gas_transactions where transactionHash is not null group by 1""")
def collection_scan(v: Views) -> DataFrame:
    """Numbers held as text become numbers where they are written plainly, else NULL."""
    eth = F.when(F.col("totalGasCostEth").rlike(r"^[0-9]+(\.[0-9]+)?$"), F.col("totalGasCostEth").try_cast("double"))
    return v.raw("gas_transactions").where(F.col("transactionHash").isNotNull()).groupBy(F.col("transactionHash").alias("hash")).agg(F.max(eth).alias("eth"))


@add("S05_directory_scan", "sources", "select file, len(regexp_extract_all(source, 'require')) as violations from sources where contains(source, 'require')")
def directory_scan(v: Views) -> DataFrame:
    """Files with what was found in them; those with nothing are left out."""
    found = F.regexp_count("source", F.lit("require")).cast("long")
    return v.sources.select("file", found.alias("violations")).where(F.col("violations") > 0)


@add("S06_multi_project_scan", "sources", "select origin, count(*) as files, cast(sum(len(regexp_extract_all(source, '\\brequire\\b'))) as bigint) as violations from sources group by 1")
def multi_project_scan(v: Views) -> DataFrame:
    return v.sources.groupBy("origin").agg(n_rows().alias("files"), F.sum(F.regexp_count("source", F.lit(r"\brequire\b"))).cast("long").alias("violations"))


@add("S07_path_filter", "findings", "select distinct file from findings where (regexp_matches(file, '^Brand#1[^/]*$') or contains(file, '#2')) and not contains(file, '#13')")
def paths(v: Views) -> DataFrame:
    return path_filter(v.findings, "file", ["Brand#1*", "#2"], ["#13"]).select("file").distinct()


@add("S11_event_normalisation", sql="""
select event_id, case when event_type = 'purchase' then 'invoke' when event_type = 'click' then 'contract' when json_extract_string(props, '$.k') is not null and cast(json_extract_string(props, '$.k') as integer) >= 50 then 'topic' else 'transaction' end as kind from events""")
def event_normalisation(v: Views) -> DataFrame:
    """An event's kind by the first sign it has, in order of precedence."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "purchase", "invoke").when(F.col("event_type") == "click", "contract").when(k >= 50, "topic").otherwise("transaction")
    return v.raw("events").select("event_id", kind.alias("kind"))


@add("S12_range_scan", sql="select blockNumber // 2000 * 2000 as start, count(distinct transactionHash) as hashes from gas_transactions where blockNumber is not null group by 1")
def range_scan(v: Views) -> DataFrame:
    """Distinct transactions by chunk of 2,000 blocks; a hash and its chunk are united before the shuffle."""
    chunk = F.col("blockNumber") - F.pmod(F.col("blockNumber"), F.lit(2000))
    rows = v.raw("gas_transactions").where(F.col("blockNumber").isNotNull()).select(chunk.alias("start"), "transactionHash").distinct()
    return rows.groupBy("start").agg(F.count("transactionHash").alias("hashes"))


@add("S13_receipts", sql="""
with w as (select lower(trim(walletAddress)) as w, min(periodStart) as a, max(periodEnd) as b from gas_subsidy_caps group by 1)
select l.id from (select distinct id, lower(trim(walletAddress)) as w, timestamp as t from gas_subsidy_usage_logs) l join w using (w) where t between a and b""")
def receipts(v: Views) -> DataFrame:
    """Usage by a known wallet within its time: one row for each wallet meets the logs."""
    key = F.lower(F.trim("walletAddress")).alias("w")
    wallets = v.raw("gas_subsidy_caps").groupBy(key).agg(F.min("periodStart").alias("a"), F.max("periodEnd").alias("b"))
    logs = v.raw("gas_subsidy_usage_logs").select("id", key, F.col("timestamp").alias("t")).distinct()
    return logs.join(wallets, "w").where(F.col("t").between(F.col("a"), F.col("b"))).select("id")


@add("S14_raw_ingest", "prices", "select chain_id, date_trunc('hour', ts) as bucket, count(*) as n, round(avg((base_fee + priority_fee) / 1e9) * 1e9, 6) as scaled from prices group by 1, 2")
def raw_ingest(v: Views) -> DataFrame:
    """Backfill of hourly buckets; ingesting an hour twice gives the same row, as the bucket is its key."""
    gwei = (F.col("base_fee") + F.col("priority_fee")) / 1e9
    return v.prices.groupBy("chain_id", F.date_trunc("hour", "ts").alias("bucket")).agg(n_rows().alias("n"), F.round(F.avg(gwei) * 1e9, 6).alias("scaled"))


@add("K01_gas_usage_csv", "tx_lines", """
select id, line, id || ',' || line || ',' || type || ',' || status || ',' || printf('%.4f', gas_price) || ',' || printf('%.8f', gas_used / 1e6) as row from tx_lines""")
def gas_usage_csv(v: Views) -> DataFrame:
    """Lines of the export: prices with four decimals, native amounts with eight; text quoted where it must be."""
    cells = [F.col("id").cast("string"), F.col("line").cast("string"), F.col("type"), F.col("status"), fixed(F.col("gas_price"), 4), fixed(F.col("gas_used") / 1e6, 8)]
    return v.tx_lines.select("id", "line", csv_line(cells).alias("row"))


@add("K02_audit_export", sql="select event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' as row from events where event_type in ('error', 'click')")
def audit_export(v: Views) -> DataFrame:
    rows = matching(v.raw("events"), event_type=["error", "click"])
    return rows.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("row"))


@add("K04_json_report", "findings", """
select id, '{"rule":"' || rule_id || '","severity":"' || severity || '","location":{"file":"' || file || '","line":' || line_no || '},"category":"' || case when severity in ('critical', 'high') then 'security' else 'gas' end || '"}' as row from findings""")
def json_report(v: Views) -> DataFrame:
    category = F.when(F.col("severity").isin("critical", "high"), "security").otherwise("gas")
    place = F.struct("file", F.col("line_no").alias("line"))
    row = F.struct(F.col("rule_id").alias("rule"), "severity", place.alias("location"), category.alias("category"))
    return v.findings.select("id", F.to_json(row).alias("row"))


@add("K05_findings_csv", sql="""
select doc_id, doc_id || ',' || case when regexp_matches(text, '[",\\n\\r]') then '"' || replace(text, '"', '""') || '"' else text end as row from documents where text is not null""")
def findings_csv(v: Views) -> DataFrame:
    rows = v.raw("documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", csv_line([F.col("doc_id").cast("string"), F.col("text")]).alias("row"))


@add("K06_sarif_results", "findings", """
select id, '{"ruleId":"' || rule_id || '","level":"' || case severity when 'critical' then 'error' when 'high' then 'error' when 'medium' then 'warning' else 'note' end || '","message":{"text":"' || message
  || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || greatest(line_no, 1) || '}}}]}' as result from findings""")
def sarif_results(v: Views) -> DataFrame:
    """Each finding as a result of the standard's format; a log is their concatenation, so none has to be gathered."""
    rows = v.findings.withColumn("line", F.col("line_no"))
    return rows.select("id", F.to_json(sarif_result()).alias("result"))


@add("K10_summary", "findings", "select severity, rule_id, count(*) as findings, grouping(severity) * 2 + grouping(rule_id) as level from findings group by grouping sets ((severity), (rule_id), ())")
def summary(v: Views) -> DataFrame:
    sets = v.findings.groupingSets([["severity"], ["rule_id"], []], "severity", "rule_id")
    return sets.agg(n_rows().alias("findings"), F.grouping_id().alias("level"))


@add("K13_comment_lines", "findings", """
with t as (select id, rule_id, savings from findings order by savings desc, id limit 10)
select '- ' || rule_id || ' ' || id || ': ' || savings as line from t union all select 'and ' || (count(*) - 10) || ' more, ' || sum(savings) || ' in all' from findings""")
def comment_lines(v: Views) -> DataFrame:
    """The ten largest savings, and the others as a sum."""
    top = v.findings.select("id", "rule_id", "savings").orderBy(F.desc("savings"), "id").limit(10)
    lines = top.select(F.format_string("- %s %s: %d", "rule_id", "id", "savings").alias("line"))
    rest = v.findings.agg(n_rows().alias("n"), F.sum("savings").alias("s"))
    return lines.unionByName(rest.select(F.format_string("and %d more, %d in all", F.col("n") - 10, F.col("s")).alias("line")))


@add("K16_graph_export", sql="select 'n' || p_partkey || ' --> n' || p_partkey // 2 as edge from part where p_partkey > 1")
def graph_export(v: Views) -> DataFrame:
    keys = v.raw("part").where("p_partkey > 1")
    return keys.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit(" --> n"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("edge"))


@add("K17_retention", "metrics", "select event_id from metrics where ts >= timestamp '2024-01-15'")
def retention(v: Views) -> DataFrame:
    return retained(v.metrics, "ts", "2024-01-15").select("event_id")


@add("K18_retention_newest", "metrics", """
with r as (select event_id, ts, row_number() over (partition by endpoint order by ts desc) as k from metrics where ts >= timestamp '2024-01-10') select event_id from r where k <= 20""")
def retention_newest(v: Views) -> DataFrame:
    return retained(v.metrics, "ts", "2024-01-10", ["endpoint"], 20).select("event_id")


@add("Z06_merchant_activity", "metrics", """
with r as (select user_id, status_code, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as k from metrics)
select user_id, count(*) as held, count(case when status_code >= 400 then 1 end) as failed, max(ts) as latest from r where k <= 50 group by 1""")
def merchant_activity(v: Views) -> DataFrame:
    """What the state of the last fifty rows of each user holds."""
    last = newest(v.metrics, ["user_id"], "ts", "event_id", 50)
    return last.groupBy("user_id").agg(n_rows().alias("held"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.max("ts").alias("latest"))


@add("Z10_rising_alerts", "metrics", """
with l as (select user_id, event_id, ts, case when response_time >= 15 then 2 when response_time >= 5 then 1 else 0 end as level from metrics),
p as (select *, coalesce(max(level) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding), 0) as before from l)
select user_id, event_id, level from p where level > before""")
def rising_alerts(v: Views) -> DataFrame:
    """An alert only where the level is above that of all alerts among the user's last twenty rows."""
    rt = F.col("response_time")
    rows = v.metrics.select("user_id", "event_id", "ts", F.when(rt >= 15, 2).when(rt >= 5, 1).otherwise(0).alias("level"))
    held = with_frames(rows, ["user_id"], ["ts", "event_id"], 20, {"before": lambda w: F.max("level").over(w.rowsBetween(-20, -1))})
    return held.where(F.col("level") > F.coalesce("before", F.lit(0))).select("user_id", "event_id", "level")


@add("Z11_flag_escalation", "metrics", "select user_id, count(*) as flags, least(count(*), 10) as severity from metrics where status_code >= 400 group by 1")
def flag_escalation(v: Views) -> DataFrame:
    """Every flag raises the severity by one, up to ten: a count, whatever the order."""
    flags = v.metrics.where(F.col("status_code") >= 400).groupBy("user_id").agg(n_rows().alias("flags"))
    return flags.withColumn("severity", F.least("flags", F.lit(10)))


@add("Z21_failure_tracking", "metrics", "select user_id, strftime(ts, '%Y-%m-%d') as \"day\", count(*) as failures, max(ts) as latest from metrics where status_code >= 400 group by 1, 2")
def failure_tracking(v: Views) -> DataFrame:
    failed = v.metrics.where(F.col("status_code") >= 400)
    return failed.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n_rows().alias("failures"), F.max("ts").alias("latest"))


@add("Z22_retries", "transactions", """
with t as (select id, status, id % 5 as attempts from transactions where status <> 'pending')
select id, case when status = 'success' then 'done' when attempts >= 3 then 'failed' else 'queued' end as state from t""")
def retries(v: Views) -> DataFrame:
    done = v.transactions.where(F.col("status") != "pending").withColumn("attempts", F.col("id") % 5)
    state = F.when(F.col("status") == "success", "done").when(F.col("attempts") >= 3, "failed").otherwise("queued")
    return done.select("id", state.alias("state"))


@add("Z24_endpoint_probe", "metrics", "select endpoint, strftime(ts, '%Y-%m-%d') as \"day\", count(*) as probes, round(count(case when response_time < 20 then 1 end) * 100.0 / count(*), 4) as uptime from metrics group by 1, 2")
def endpoint_probe(v: Views) -> DataFrame:
    up = F.count_if(F.col("response_time") < 20)
    return v.metrics.groupBy("endpoint", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n_rows().alias("probes"), F.round(up * 100.0 / n_rows(), 4).alias("uptime"))


@add("Z25_fee_index", "prices", """
with t as (select n_nationkey as chain_id, (n_nationkey + 1) * 0.5 as usd from nation)
select p.event_id, round(coalesce(p.base_fee * t.usd, 0), 6) as fee from prices p left join t using (chain_id)""")
def fee_index(v: Views) -> DataFrame:
    """Prices times the chain's token price, 0 where there is none: a small table of prices meets the stream of rows."""
    prices = v.raw("nation").select(F.col("n_nationkey").cast("long").alias("chain_id"), ((F.col("n_nationkey") + 1) * 0.5).alias("usd"))
    return v.prices.join(prices, "chain_id", "left").select("event_id", F.round(F.coalesce(F.col("base_fee") * F.col("usd"), F.lit(0.0)), 6).alias("fee"))
