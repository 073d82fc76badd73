"""Further filters, joins, aggregates, orders, set operations and monitors (F, J, A, T, O, Z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import costs
from lodestream.operators import findings as ops
from lodestream.plans.aggregates import n_rows
from lodestream.plans.query import Register
from lodestream.plans.relational import matching, stamp
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add

_LEVEL = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity)"
_PLACED = "placed as (select id, rule_id, file, line_no as line, severity, message, confidence from findings)"


def level():
    return F.array_position(F.array(*map(F.lit, ["info", "low", "medium", "high", "critical"])), F.col("severity"))


def placed(v: Views) -> DataFrame:
    return v.findings.select("id", "rule_id", "file", F.col("line_no").alias("line"), "severity", "message", "confidence")


class Query:
    """A chain of filters, orders and pages over a frame; nothing runs before the result is read."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self._skip, self._limit = df, 0, None

    def where(self, **wanted) -> Query:
        self.df = matching(self.df, **wanted)
        return self

    def having(self, condition) -> Query:
        self.df = self.df.where(condition)
        return self

    def sort_by(self, *columns, descending: bool = False) -> Query:
        self.df = self.df.orderBy(*[F.desc(c) if descending and i == 0 else F.asc(c) for i, c in enumerate(columns)])
        return self

    def skip(self, n: int) -> Query:
        self._skip = n
        return self

    def limit(self, n: int) -> Query:
        self._limit = n or None
        return self

    def execute(self) -> DataFrame:
        df = self.df.offset(self._skip) if self._skip else self.df
        return df.limit(self._limit) if self._limit else df


@add("F10_fluent_query", "findings", "select id, savings from findings where severity = 'critical' and confidence > 0.05 order by savings desc, id limit 20 offset 5")
def fluent_query(v: Views) -> DataFrame:
    return Query(v.findings).where(severity="critical").having(F.col("confidence") > 0.05).sort_by("savings", "id", descending=True).skip(5).limit(20).execute().select("id", "savings")


@add("F12_criteria", "transactions", "select id from transactions where chain_id in (1, 2) and status = 'failed' and fee between 500 and 2000")
def criteria(v: Views) -> DataFrame:
    return matching(v.transactions, chain_id=[1, 2], status="failed", fee=(500, 2000)).select("id")


@add("F13_any_tag", sql="select p_partkey as part from part where len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) > 0")
def any_tag(v: Views) -> DataFrame:
    return v.raw("part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select(F.col("p_partkey").alias("part"))


@add("F15_marketplace_search", sql="select p_partkey as part from part where contains(lower(p_name), 'gear') and len(list_intersect([p_type, p_brand], ['PROMO', 'Brand#8'])) > 0")
def marketplace(v: Views) -> DataFrame:
    """Text and any of the tags."""
    tags = F.arrays_overlap(F.array("p_type", "p_brand"), F.array(F.lit("PROMO"), F.lit("Brand#8")))
    return v.raw("part").where(F.lower("p_name").contains("gear") & tags).select(F.col("p_partkey").alias("part"))


@add("F16_description_search", sql="select p_partkey as part from part where contains(lower(p_name), 'anvil') or contains(lower(p_type), 'pro')")
def description(v: Views) -> DataFrame:
    return v.raw("part").where(F.lower("p_name").contains("anvil") | F.exists(F.array("p_type"), lambda t: F.lower(t).contains("pro"))).select(F.col("p_partkey").alias("part"))


@add("F20_pattern_filter", "findings", f"select id from findings where file in ('Brand#1', 'Brand#2') and rule_id = 'SMALL' and {_LEVEL} >= 4")
def pattern_filter(v: Views) -> DataFrame:
    return matching(v.findings, file=["Brand#1", "Brand#2"], rule_id="SMALL").where(level() >= 4).select("id")


@add("F24_reports_by_period", "transactions", "select id, created_at from transactions where created_at >= timestamp '1996-01-01' and created_at + interval 7 day <= timestamp '1996-03-01' order by created_at desc, id")
def reports_by_period(v: Views) -> DataFrame:
    """Reports of a week each that lie wholly in a period, newest first."""
    inside = (F.col("created_at") >= stamp("1996-01-01")) & (F.col("created_at") + F.expr("interval 7 days") <= stamp("1996-03-01"))
    return v.transactions.where(inside).orderBy(F.desc("created_at"), "id").select("id", "created_at")


@add("F25_paging", "transactions", "with p as (select id from transactions where merchant_id < 40 and status = 'success' order by id limit 50 offset 10) select id, (select count(*) from p) as total from p")
def paging(v: Views) -> DataFrame:
    """A page, with its own length as the total."""
    page = v.transactions.where((F.col("merchant_id") < 40) & (F.col("status") == "success")).orderBy("id").offset(10).limit(50).select("id")
    return page.join(F.broadcast(page.agg(n_rows().alias("total"))))


@add("F26_expiry", sql="""
with k as (select id, periodEnd as e from gas_subsidy_caps where periodEnd is not null), n as (select timestamp '2024-06-01' as t)
select id, case when e <= t - interval 24 hour then 'gone' when e <= t then 'expired' when e <= t + interval 14 day then 'expiring' else 'valid' end as state from k, n""")
def expiry(v: Views) -> DataFrame:
    """What has expired (within or past a grace of 24 hours), expires in 14 days, or is valid, at a fixed time."""
    at, e = stamp("2024-06-01"), F.col("periodEnd")
    state = F.when(e <= at - F.expr("interval 24 hours"), "gone").when(e <= at, "expired").when(e <= at + F.expr("interval 14 days"), "expiring").otherwise("valid")
    return v.raw("gas_subsidy_caps").where(e.isNotNull()).select("id", state.alias("state"))


@add("J02_chain_transactions", "chains transactions", "select c.name, c.network, count(*) as transactions, round(sum(t.gas_used), 2) as gas from chains c join transactions t on c.chain_id = t.chain_id group by 1, 2")
def chain_transactions(v: Views) -> DataFrame:
    """Summed up by chain before the names are joined."""
    by = v.transactions.groupBy("chain_id").agg(n_rows().alias("transactions"), F.round(F.sum("gas_used"), 2).alias("gas"))
    return v.chains.join(by, "chain_id").select("name", "network", "transactions", "gas")


@add("J07_report_lookup", "chains transactions", "with t as (select chain_id + 5 as chain_id, sum(fee) as fee from transactions group by 1) select coalesce(c.name, cast(t.chain_id as varchar)) as chain, round(fee, 2) as fee from t left join chains c on c.chain_id = t.chain_id")
def report_lookup(v: Views) -> DataFrame:
    by = v.transactions.groupBy((F.col("chain_id") + 5).alias("chain_id")).agg(F.sum("fee").alias("fee"))
    return by.join(v.chains, "chain_id", "left").select(F.coalesce("name", F.col("chain_id").cast("string")).alias("chain"), F.round("fee", 2).alias("fee"))


@add("J08_leaderboard", "chains transactions", """
with s as (select chain_id + 5 as chain_id, round(avg(case when status = 'success' then 100.0 else 0 end), 4) as score from transactions group by 1)
select name, score, row_number() over (order by score desc, name) as rank from s join chains using (chain_id)""")
def leaderboard(v: Views) -> DataFrame:
    """Chains without a name are skipped before ranks are given; there is one row for each chain."""
    score = F.round(F.avg(F.when(F.col("status") == "success", 100.0).otherwise(0.0)), 4)
    by = v.transactions.groupBy((F.col("chain_id") + 5).alias("chain_id")).agg(score.alias("score")).join(v.chains, "chain_id")
    return by.select("name", "score", F.row_number().over(Window.orderBy(F.desc("score"), "name")).alias("rank"))


@add("J13_file_hashes", "sources", """
with a as (select file, sha256(source) as h from sources), b as (select file + 1 as file, sha256(source) as h from sources where file % 3 <> 0)
select case when a.file is null then 'added' when b.file is null then 'deleted' when a.h = b.h then 'unchanged' else 'modified' end as change, count(*) as files from a full join b using (file) group by 1""")
def file_hashes(v: Views) -> DataFrame:
    """Two states of a tree as one grouping by file."""
    hashed = v.sources.select("file", F.sha2("source", 256).alias("h"))
    both = hashed.select("file", F.col("h").alias("a"), F.lit(None).cast("string").alias("b"))
    both = both.unionByName(hashed.where("file % 3 <> 0").select((F.col("file") + 1).alias("file"), F.lit(None).cast("string").alias("a"), F.col("h").alias("b")))
    one = both.groupBy("file").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return one.groupBy(change.alias("change")).agg(n_rows().alias("files"))


@add("J15_suppressions", "findings", f"""
with {_PLACED}, m as (select distinct file, rule_id, line from placed where id like '%-1' and severity = 'low'),
w as (select file, rule_id, line from m union select file, rule_id, line + 1 from m)
select p.id, case when w.file is not null then 'inline' when p.rule_id = 'SMALL' and p.file like 'Brand#1%' then 'config' when p.rule_id = 'PROMO' then 'config' end as suppressed_by
from placed p left join w on w.file = p.file and w.rule_id = p.rule_id and w.line = p.line""")
def suppressions(v: Views) -> DataFrame:
    """Marks on a finding's line or the one before, and rules of the configuration; a mark wins."""
    rows = placed(v)
    marks = rows.where(F.col("id").endswith("-1") & (F.col("severity") == "low")).select("file", "line", "rule_id")
    return ops.suppressed(rows, marks, [("SMALL", "Brand#1*"), ("PROMO", "global")]).select("id", "suppressed_by")


@add("J20_similar_rules", sql="""
with r as (select distinct p_name as d, p_type as deps, list_distinct(string_split(p_name, ' ') || [p_type]) as t from part),
s as (select a.d as a, a.deps as deps, b.d as b, len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(a.t || b.t)) as j from r a join r b on a.deps = b.deps and a.d < b.d)
select deps, a, b, case when length(b) > length(a) then b else a end as kept from s where j >= 0.5""")
def similar_rules(v: Views) -> DataFrame:
    """Rules of the same dependencies whose tokens are alike: pairs only meet that share a token; the longer description is kept."""
    rules = v.raw("part").select(F.col("p_name").alias("d"), F.col("p_type").alias("deps")).distinct()
    rules = rules.withColumn("t", F.array_distinct(F.concat(F.split("d", " "), F.array("deps"))))
    # The shared dependency is in every set, so it is no token to meet on.
    left = rules.select("deps", F.col("d").alias("a"), F.col("t").alias("ta"), F.explode(F.array_except("t", F.array("deps"))).alias("x"))
    right = rules.select("deps", F.col("d").alias("b"), F.col("t").alias("tb"), F.explode(F.array_except("t", F.array("deps"))).alias("x"))
    pairs = left.join(right, ["deps", "x"]).where(F.col("a") < F.col("b")).dropDuplicates(["deps", "a", "b"])
    alike = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")) >= 0.5
    return pairs.where(alike).select("deps", "a", "b", F.when(F.length("b") > F.length("a"), F.col("b")).otherwise(F.col("a")).alias("kept"))


@add("J23_conflicts_in_place", "findings", f"""
with {_PLACED} select file, line, count(*) as findings, count(distinct rule_id) as rules from placed group by 1, 2 having count(distinct case when severity in ('critical', 'info') then severity end) = 2 and count(*) > 2""")
def conflicts_in_place(v: Views) -> DataFrame:
    """Places with opposite suggestions: what a pair-wise search asks, answered by grouping."""
    opposed = F.count_distinct(F.when(F.col("severity").isin("critical", "info"), F.col("severity")))
    by = placed(v).groupBy("file", "line").agg(n_rows().alias("findings"), F.count_distinct("rule_id").alias("rules"), opposed.alias("o"))
    return by.where("o = 2 and findings > 2").drop("o")


@add("J25_source_map", "findings", "select f.id, n.n_name as place from findings f left join nation n on n.n_nationkey = f.line_no - 10")
def source_map(v: Views) -> DataFrame:
    places = v.raw("nation").select((F.col("n_nationkey") + 10).cast("long").alias("line_no"), F.col("n_name").alias("place"))
    return v.findings.select("id", "line_no").join(places, "line_no", "left").select("id", "place")


@add("J26_join_hints", "chains transactions", "select network, count(*) as n from transactions join chains using (chain_id) group by 1")
def join_hints(v: Views) -> DataFrame:
    """The same join by three strategies; they must agree."""
    counted = lambda hint: v.transactions.join(v.chains.hint(hint), "chain_id").groupBy("network").agg(n_rows().alias("n"))
    return counted("broadcast").intersect(counted("merge")).intersect(counted("shuffle_hash"))


@add("A47_suggestion_summary", "findings", """
select cast(sum(case when confidence >= 0.05 then savings end) as bigint) as pending_savings, count(case when confidence >= 0.05 then 1 end) as pending, count(case when confidence < 0.05 then 1 end) as dismissed,
  count(case when severity in ('critical', 'high') then 1 end) as urgent from findings""")
def suggestion_summary(v: Views) -> DataFrame:
    pending = F.col("confidence") >= 0.05
    return v.findings.agg(
        F.sum(F.when(pending, F.col("savings"))).alias("pending_savings"), F.count_if(pending).alias("pending"), F.count_if(F.col("confidence") < 0.05).alias("dismissed"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"),
    )


@add("A48_queue_by_priority", "transactions", "select priority, count(*) as queued, min(created_at) as oldest from transactions where status = 'pending' group by 1")
def queue_by_priority(v: Views) -> DataFrame:
    return v.transactions.where(F.col("status") == "pending").groupBy("priority").agg(n_rows().alias("queued"), F.min("created_at").alias("oldest"))


@add("A49_queue_and_processed", "transactions", "select status, count(*) as n from (select status from transactions where status = 'pending' union all select status from transactions where status <> 'pending' and chain_id < 10) group by 1")
def queue_and_processed(v: Views) -> DataFrame:
    """Counts over the union of queue and processed items: one scan with the condition of either."""
    either = (F.col("status") == "pending") | (F.col("chain_id") < 10)
    return v.transactions.where(either).groupBy("status").agg(n_rows().alias("n"))


@add("A51_cache_metrics", "metrics", """
select endpoint, user_id % 5 as chain_id, count(case when response_time < 5 then 1 end) as hits, count(case when response_time >= 5 then 1 end) as misses, round(avg(response_time), 6) as mean_ms,
  round(count(case when response_time < 5 then 1 end) * 100.0 / count(*), 4) as hit_rate from metrics group by 1, 2""")
def cache_metrics(v: Views) -> DataFrame:
    hit = F.col("response_time") < 5
    return v.metrics.groupBy("endpoint", (F.col("user_id") % 5).alias("chain_id")).agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.avg("response_time"), 6).alias("mean_ms"),
        F.round(F.count_if(hit) * 100.0 / n_rows(), 4).alias("hit_rate"),
    )


@add("A58_rule_metrics", "findings", "select rule_id, count(*) as runs, cast(sum(savings) as bigint) as total, min(savings) as least, max(savings) as most, round(avg(savings), 6) as mean from findings group by 1")
def rule_metrics(v: Views) -> DataFrame:
    return v.findings.groupBy("rule_id").agg(
        n_rows().alias("runs"), F.sum("savings").alias("total"), F.min("savings").alias("least"), F.max("savings").alias("most"), F.round(F.avg("savings"), 6).alias("mean")
    )


@add("A65_place_scores", "findings", f"select file, line_no, count(*) as findings, cast(sum({_LEVEL}) as bigint) as score, row_number() over (partition by file order by sum({_LEVEL}) desc, line_no) as place from findings group by 1, 2")
def place_scores(v: Views) -> DataFrame:
    """Findings by place, scored, and ranked within their file; places are grouped before any are ordered."""
    by = v.findings.groupBy("file", "line_no").agg(n_rows().alias("findings"), F.sum(level()).cast("long").alias("score"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "line_no")))


@add("A76_merged_optimisations", "findings", """
select file, rule_id, line_no, count(*) as merged, cast(sum(savings) as bigint) as saved from findings group by 1, 2, 3 having not (bool_or(severity = 'critical') and bool_or(severity = 'info'))""")
def merged_optimisations(v: Views) -> DataFrame:
    """Findings of one rule and place merged, those that contradict one another left out."""
    by = v.findings.groupBy("file", "rule_id", "line_no").agg(
        n_rows().alias("merged"), F.sum("savings").alias("saved"), F.bool_or(F.col("severity") == "critical").alias("a"), F.bool_or(F.col("severity") == "info").alias("b")
    )
    return by.where("not (a and b)").drop("a", "b")


@add("A78_issues_grouped", "findings", "select 'severity' as \"by\", severity as key, count(*) as issues, min(id) as first_id, max(id) as last_id from findings group by severity union all select 'file', file, count(*), min(id), max(id) from findings group by file")
def issues_grouped(v: Views) -> DataFrame:
    """Groups under several criteria from one pass; a group's rows are counted, not gathered."""
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("key")) for c in ("severity", "file")]))
    rows = v.findings.select("id", keys.alias("k"))
    return rows.groupBy(F.col("k.by").alias("by"), F.col("k.key").alias("key")).agg(n_rows().alias("issues"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@add("A79_partial_and_final", "tx_lines", "select merchant_id, count(*) as n, round(sum(gas_used), 2) as gas, round(stddev_samp(gas_used), 3) as deviation from tx_lines group by 1")
def partial_and_final(v: Views) -> DataFrame:
    """Sums made by day first and merged into those of the merchant, as partitions' results are."""
    g = F.col("gas_used")
    days = v.tx_lines.groupBy("merchant_id", F.to_date("ts").alias("day")).agg(n_rows().alias("n"), F.sum(g).alias("s"), F.sum(g * g).alias("q"))
    all_ = days.groupBy("merchant_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)))
    return all_.select("merchant_id", "n", F.round("s", 2).alias("gas"), F.round(spread, 3).alias("deviation"))


@add("T05_by_any_column", "transactions", "select id, status, fee from transactions order by status, fee desc, id limit 25")
def by_any_column(v: Views) -> DataFrame:
    return v.transactions.orderBy("status", F.desc("fee"), "id").select("id", "status", "fee").limit(25)


@add("T09_suggestion_order", "findings", f"select id from findings order by {_LEVEL} desc, month desc, id limit 30")
def suggestion_order(v: Views) -> DataFrame:
    return v.findings.orderBy(F.desc(level()), F.desc("month"), "id").select("id").limit(30)


@add("T10_top_mitigations", "findings", f"with m as (select distinct rule_id, message, severity from findings) select rule_id, message from m order by {_LEVEL} desc, rule_id, message limit 5")
def top_mitigations(v: Views) -> DataFrame:
    return v.findings.select("rule_id", "message", "severity").distinct().orderBy(F.desc(level()), "rule_id", "message").select("rule_id", "message").limit(5)


@add("T11_refund_queue", "transactions", "select id, priority from transactions where status = 'failed' order by priority, created_at, id limit 40")
def refund_queue(v: Views) -> DataFrame:
    return v.transactions.where(F.col("status") == "failed").orderBy("priority", "created_at", "id").select("id", "priority").limit(40)


@add("T16_refactor_order", "findings", f"select id, severity from findings where rule_id = 'PROMO' order by {_LEVEL} desc, id limit 15")
def refactor_order(v: Views) -> DataFrame:
    return v.findings.where(F.col("rule_id") == "PROMO").orderBy(F.desc(level()), "id").select("id", "severity").limit(15)


@add("O02_findings_united", "findings", "select file, count(*) as n from (select file from findings where severity = 'low' union all select file from findings where confidence > 0.08) group by 1")
def findings_united(v: Views) -> DataFrame:
    low, sure = F.when(F.col("severity") == "low", 1).otherwise(0), F.when(F.col("confidence") > 0.08, 1).otherwise(0)
    return v.findings.groupBy("file").agg(F.sum(low + sure).alias("n")).where("n > 0")


@add("O06_key_union", "findings", """
with a as (select rule_id || ':' || line_no as key, count(*) as n from findings where month < timestamp '1994-01-01' group by 1), b as (select rule_id || ':' || line_no as key, count(*) as n from findings where month >= timestamp '1994-01-01' group by 1)
select coalesce(a.key, b.key) as key, coalesce(b.n, 0) - coalesce(a.n, 0) as difference from a full join b on a.key = b.key""")
def key_union(v: Views) -> DataFrame:
    later = F.when(F.col("month") >= stamp("1994-01-01"), 1).otherwise(-1)
    return v.findings.groupBy(F.concat_ws(":", "rule_id", F.col("line_no").cast("string")).alias("key")).agg(F.sum(later).alias("difference"))


_DEDUP = f"""with {_PLACED}, r as (select *, {{0}} as k, row_number() over (partition by {{0}} order by list_position(['critical', 'high', 'medium', 'low', 'info'], severity), -confidence, id) as o, count(*) over (partition by {{0}}) as copies from placed)
select id as canonical_id, rule_id, file, line, severity, copies from r where o = 1"""


@add("O07_duplicates_normalised", "findings", _DEDUP.format("(rule_id, file, line, lower(trim(regexp_replace(message, '\\s+', ' ', 'g'))))"))
def duplicates_normalised(v: Views) -> DataFrame:
    return ops.deduplicated(placed(v), "normalised", "confidence")


@add("O07_duplicates_same_location", "findings", _DEDUP.format("(file, line)"))
def duplicates_same_location(v: Views) -> DataFrame:
    return ops.deduplicated(placed(v), "same_location", "confidence")


@add("O07_duplicates_exact", "findings", _DEDUP.format("(rule_id, file, line, severity, message)"))
def duplicates_exact(v: Views) -> DataFrame:
    return ops.deduplicated(placed(v), "exact", "confidence")


@add("Z08_detector_chain", "tx_lines", """
with b as (select merchant_id, avg(gas_used) as m, stddev_pop(gas_used) as s, avg(gas_price) as p, count(*) as n from tx_lines group by 1),
c as (select merchant_id, date_trunc('hour', ts) as h, count(*) as c from tx_lines group by 1, 2),
r as (select t.id, t.line, case when s = 0 then 0 else (gas_used - m) / s end as z, c / 1.5 as f, gas_price / p as q from tx_lines t join b using (merchant_id) join c on c.merchant_id = t.merchant_id and c.h = date_trunc('hour', t.ts) where b.n >= 10)
select id, line, case when z > 1.6 then 'abnormal_gas_usage' when f > 1.2 then 'frequency_anomaly' else 'gas_price_manipulation' end as pattern from r where z > 1.6 or f > 1.2 or q > 1.5""")
def detector_chain(v: Views) -> DataFrame:
    """Gas usage, then frequency, then price: the first that strikes names the pattern; accounts of ten rows or more."""
    base = v.tx_lines.groupBy("merchant_id").agg(F.avg("gas_used").alias("m"), F.stddev_pop("gas_used").alias("s"), F.avg("gas_price").alias("p"), n_rows().alias("n")).where("n >= 10")
    hour = F.date_trunc("hour", "ts")
    hours = v.tx_lines.groupBy("merchant_id", hour.alias("h")).agg(n_rows().alias("c"))
    rows = v.tx_lines.withColumn("h", hour).join(base, "merchant_id").join(hours, ["merchant_id", "h"])
    z = costs.z_score(F.col("gas_used"), F.col("m"), F.col("s"))
    first = F.when(z > 1.6, "abnormal_gas_usage").when(F.col("c") / 1.5 > 1.2, "frequency_anomaly").when(F.col("gas_price") / F.col("p") > 1.5, "gas_price_manipulation")
    return rows.select("id", "line", first.alias("pattern")).where(F.col("pattern").isNotNull())


@add("Z14_window_reset", "metrics", "select event_id, (epoch_us(ts) // 60000000) * 60 as window_s, (epoch_us(ts) // 60000000 + 1) * 60 as reset_s from metrics")
def window_reset(v: Views) -> DataFrame:
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    return v.metrics.select("event_id", (minute * 60).alias("window_s"), ((minute + 1) * 60).alias("reset_s"))


@add("Z19_calmest_chain", "prices", "with i as (select chain_id, stddev_pop(base_fee) / avg(base_fee) as i, count(*) as n from prices group by 1) select chain_id, round(i, 9) as index from i where n > 1 order by i, chain_id limit 1")
def calmest_chain(v: Views) -> DataFrame:
    by = v.prices.groupBy("chain_id").agg((F.stddev_pop("base_fee") / F.avg("base_fee")).alias("i"), n_rows().alias("n")).where("n > 1")
    return by.agg(F.min(F.struct("i", "chain_id")).alias("b")).select("b.chain_id", F.round("b.i", 9).alias("index"))


@add("Z23_rule_stream", "findings", "select rule_id, month, count(*) as runs, min(savings) as least, max(savings) as most, round(avg(savings), 6) as mean from findings group by 1, 2")
def rule_stream(v: Views) -> DataFrame:
    """Figures by rule and month, as a stream in update mode keeps them."""
    return v.findings.groupBy("rule_id", "month").agg(n_rows().alias("runs"), F.min("savings").alias("least"), F.max("savings").alias("most"), F.round(F.avg("savings"), 6).alias("mean"))


@add("Z26_incremental_rescan", "sources", """
with c as (select distinct sha256(source) as h from sources where file % 4 = 0), s as (select file, sha256(source) in (select h from c) as cached from sources)
select case when cached then 'cached' else 'scanned' end as state, count(*) as files from s group by 1""")
def incremental_rescan(v: Views) -> DataFrame:
    """Files whose content was scanned before, wherever it lay, need no scan: a join on the content's hash."""
    hashed = v.sources.select("file", F.sha2("source", 256).alias("h"))
    known = hashed.where("file % 4 = 0").select("h").distinct().withColumn("cached", F.lit(True))
    state = F.when(F.col("cached"), "cached").otherwise("scanned")
    return hashed.join(known, "h", "left").groupBy(state.alias("state")).agg(n_rows().alias("files"))


@add("Z27_reverse_dependencies", sql="""
with d as (select p_partkey as a, p_partkey // 2 as b from part where p_partkey > 1), m as (select p_partkey as n from part where p_partkey % 10 = 3)
select n as node, 'modified' as why from m union all select distinct a, 'dependent' from d where b in (select n from m) and a not in (select n from m)""")
def reverse_dependencies(v: Views) -> DataFrame:
    """What changed, and what depends on it directly."""
    keys = v.raw("part").select(F.col("p_partkey").alias("node"))
    links = keys.where("node > 1").select(F.col("node").alias("a"), F.floor(F.col("node") / 2).alias("b"))
    modified = keys.where("node % 10 = 3")
    near = links.join(modified, F.col("b") == F.col("node"), "left_semi").select(F.col("a").alias("node")).distinct().join(modified, "node", "left_anti")
    return modified.withColumn("why", F.lit("modified")).unionByName(near.withColumn("why", F.lit("dependent")))
