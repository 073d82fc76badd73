"""Filters (F), joins (J) and set operations (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import jaccard, levenshtein_similarity, squeeze, tokens
from lodestream.operators.ordered import with_latest
from lodestream.operators.similarity import near_duplicate_classes
from lodestream.plans.aggregates import n_rows, ok
from lodestream.plans.query import Register
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Keep the rows that meet the given conditions only; an argument of None asks for nothing (F01).

    A list asks for one of its values, a (low, high) tuple for a value between them, both ends included.
    """
    for column, value in wanted.items():
        if isinstance(value, list):
            df = df.where(F.col(column).isin(value))
        elif isinstance(value, tuple):
            df = df.where(F.col(column).between(*[F.lit(x) for x in value]))
        elif value is not None:
            df = df.where(F.col(column) == value)
    return df


def stamp(text: str):
    return F.lit(text).cast("timestamp")


@add("F01_optional_filter", "transactions", "select id, fee from transactions where chain_id = 7 and status = 'success'")
def optional_filter(v: Views) -> DataFrame:
    return matching(v.transactions, chain_id=7, status="success", merchant_id=None).select("id", "fee")


@add("F02_between", "transactions", "select id from transactions where created_at between timestamp '1998-01-01' and timestamp '1998-03-31'")
def between(v: Views) -> DataFrame:
    return v.transactions.where(F.col("created_at").between(stamp("1998-01-01"), stamp("1998-03-31"))).select("id")


@add("F03_half_open", "transactions", "select id from transactions where created_at >= timestamp '1998-02-01' and created_at < timestamp '1998-03-01'")
def half_open(v: Views) -> DataFrame:
    return v.transactions.where((F.col("created_at") >= stamp("1998-02-01")) & (F.col("created_at") < stamp("1998-03-01"))).select("id")


@add("F04_in", "transactions", "select id from transactions where status in ('success', 'failed')")
def one_of(v: Views) -> DataFrame:
    return matching(v.transactions, status=["success", "failed"]).select("id")


@add("F05_not_null", "transactions", "select id, error from transactions where error is not null")
def not_null(v: Views) -> DataFrame:
    return v.transactions.where(F.col("error").isNotNull()).select("id", "error")


@add("F06_rolling_cutoff", "transactions", "select distinct merchant_id from transactions where created_at >= timestamp '2001-06-30' - interval 90 day")
def rolling_cutoff(v: Views) -> DataFrame:
    return v.transactions.where(F.col("created_at") >= stamp("2001-06-30") - F.expr("interval 90 days")).select("merchant_id").distinct()


@add("F07_filter_and_page", "transactions", "select id, fee from transactions where status = 'failed' and chain_id <= 12 order by fee desc, id limit 50 offset 50")
def filter_and_page(v: Views) -> DataFrame:
    rows = matching(v.transactions, status="failed", chain_id=(0, 12)).select("id", "fee")
    return rows.orderBy(F.desc("fee"), "id").offset(50).limit(50)


@add("F08_pattern_filter", sql="""
select distinct id from suspicious_gas_patterns where severity in ('high', 'critical') and deviationScore >= 3 and reviewedAt is null""")
def pattern_filter(v: Views) -> DataFrame:
    rows = matching(v.raw("suspicious_gas_patterns"), severity=["high", "critical"])
    return rows.where((F.col("deviationScore") >= 3) & F.col("reviewedAt").isNull()).select("id").distinct()


@add("F09_nested_filter", "findings", """
with s as (select scan_id, list(severity) as severities, list(rule_id) as rules from findings group by 1)
select scan_id from s where list_has_all(severities, ['high', 'low']) and len(list_filter(rules, lambda r: r like '%STEEL%' or r like 'PROMO%')) > 0""")
def nested_filter(v: Views) -> DataFrame:
    scans = v.findings.groupBy("scan_id").agg(F.collect_set("severity").alias("severities"), F.collect_set("rule_id").alias("rules"))
    wanted = F.array(F.lit("high"), F.lit("low"))
    every = F.forall(wanted, lambda s: F.array_contains("severities", s))
    some = F.exists("rules", lambda r: r.contains("STEEL") | r.startswith("PROMO"))
    return scans.where(every & some).select("scan_id")


@add("F11_any_tag", "sources", "select file from sources where len(list_intersect(string_split(lower(origin), '_'), ['wiki', 'chat', 'docs'])) > 0")
def any_tag(v: Views) -> DataFrame:
    tags = F.array(*map(F.lit, ["wiki", "chat", "docs"]))
    return v.sources.where(F.arrays_overlap(F.split(F.lower("origin"), "_"), tags)).select("file")


@add("F14_text_search", "sources", "select file from sources where (contains(lower(source), 'retry budget') or contains(lower(origin), 'wiki')) and lang = 'en'")
def text_search(v: Views) -> DataFrame:
    hit = F.lower("source").contains("retry budget") | F.lower("origin").contains("wiki")
    return v.sources.where(hit & (F.col("lang") == "en")).select("file")


@add("F17_confidence_and_suppressions", "findings", """
with s as (select * from (values ('PROMO BRUSHED TIN', null, null), (null, 'Brand#12', null), (null, null, 7)) t(rule_id, file, line_no))
select id from findings f where confidence >= 0.05 and not exists (
  select 1 from s where (s.rule_id is null or s.rule_id = f.rule_id) and (s.file is null or s.file = f.file) and (s.line_no is null or s.line_no = f.line_no))""")
def confidence_and_suppressions(v: Views) -> DataFrame:
    """NULL in a suppression stands for anything. The suppressions are written by hand: a literal table."""
    rows = [("PROMO BRUSHED TIN", None, None), (None, "Brand#12", None), (None, None, 7)]
    suppressions = v.spark.createDataFrame(rows, "s_rule string, s_file string, s_line int")
    match = (
        (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule_id"))) & (F.col("s_file").isNull() | (F.col("s_file") == F.col("file")))
        & (F.col("s_line").isNull() | (F.col("s_line") == F.col("line_no")))
    )
    return v.findings.where(F.col("confidence") >= 0.05).join(F.broadcast(suppressions), match, "left_anti").select("id")


@add("F18_tuned_filter", "findings", """
with t as (select * from (values ('info', false, 0.0), ('low', true, -0.02), ('high', true, 0.03)) t(severity, on_, boost))
select id, round(least(greatest(confidence + coalesce(boost, 0), 0), 1), 6) as confidence from findings f left join t using (severity)
where coalesce(on_, true) and least(greatest(confidence + coalesce(boost, 0), 0), 1) >= 0.06""")
def tuned_filter(v: Views) -> DataFrame:
    tuning = v.spark.createDataFrame([("info", False, 0.0), ("low", True, -0.02), ("high", True, 0.03)], "severity string, enabled boolean, boost double")
    rows = v.findings.join(F.broadcast(tuning), "severity", "left").where(F.coalesce("enabled", F.lit(True)))
    tuned = F.least(F.greatest(F.col("confidence") + F.coalesce("boost", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.where(tuned >= 0.06).select("id", F.round(tuned, 6).alias("confidence"))


@add("F19_expensive", "tx_lines", "select id, line from tx_lines where gas_used > 49000")
def expensive(v: Views) -> DataFrame:
    return v.tx_lines.where(F.col("gas_used") > 49_000).select("id", "line")


@add("F21_labels", "savings", "select scan_id, line, coalesce(['Info', 'Warning', 'Error', 'Critical'][severity], 'Unknown') as label from savings")
def labels(v: Views) -> DataFrame:
    names = F.array(*map(F.lit, ["Info", "Warning", "Error", "Critical"]))
    return v.savings.select("scan_id", "line", F.coalesce(F.get(names, F.col("severity").cast("int") - 1), F.lit("Unknown")).alias("label"))


@add("F22_json_field", sql="select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(v: Views) -> DataFrame:
    return v.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@add("F23_scheduled", sql="select distinct id from gas_subsidy_caps where status = 'active' and (lastUsageAt is null or lastUsageAt <= timestamptz '2024-01-01 00:00:00+00')")
def scheduled(v: Views) -> DataFrame:
    due = F.col("lastUsageAt").isNull() | (F.col("lastUsageAt") <= stamp("2024-01-01"))
    return matching(v.raw("gas_subsidy_caps"), status="active").where(due).select("id").distinct()


@add("F27_subset", "transactions", "select chain_id, count(*) as transactions from transactions where chain_id in (1, 3, 5, 8) group by 1")
def subset(v: Views) -> DataFrame:
    wanted = [int(x) for x in "1,3,5,8".split(",")]
    return matching(v.transactions, chain_id=wanted).groupBy("chain_id").agg(n_rows().alias("transactions"))


@add("J01_merchant_transactions", "merchants transactions", """
select m.name, count(*) as transactions from merchants m left join transactions t on t.merchant_id = m.id where t.status = 'failed' group by 1""")
def merchant_transactions(v: Views) -> DataFrame:
    # The condition on the right side drops merchants without a match: an inner join.
    failed = matching(v.transactions, status="failed").groupBy("merchant_id").agg(n_rows().alias("transactions"))
    return v.merchants.join(failed, F.col("id") == F.col("merchant_id")).groupBy("name").agg(F.sum("transactions").alias("transactions"))


@add("J03_unnest_outer", "findings", """
with s as (select scan_id, list(rule_id) filter (severity = 'critical') as rules from findings group by 1)
select r.rule_id, count(*) as scans from s left join lateral (select unnest(s.rules) as rule_id) r on true group by 1""")
def unnest_outer(v: Views) -> DataFrame:
    scans = v.findings.groupBy("scan_id").agg(F.collect_list(F.when(F.col("severity") == "critical", F.col("rule_id"))).alias("rules"))
    return scans.select(F.explode_outer("rules").alias("rule_id")).groupBy("rule_id").agg(n_rows().alias("scans"))


@add("J04_latest_by_time_only", "transactions", """
with l as (select chain_id, max(created_at) as latest from transactions group by 1) select t.id from transactions t join (select distinct latest from l) l on t.created_at = l.latest""")
def latest_by_time_only(v: Views) -> DataFrame:
    """The join is on the time alone, as written: rows of other chains at that instant come too."""
    latest = v.transactions.groupBy("chain_id").agg(F.max("created_at").alias("at")).select("at").distinct()
    return v.transactions.join(latest, F.col("created_at") == F.col("at")).select("id")


@add("J05_latest_by_chain", "transactions", "select chain_id, arg_max(id, (created_at, id)) as id from transactions group by 1")
def latest_by_chain(v: Views) -> DataFrame:
    return v.transactions.groupBy("chain_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@add("J06_lookup_or_key", "transactions chains", """
select coalesce(c.name, cast(t.k as varchar)) as chain, count(*) as transactions from (select chain_id + 5 as k from transactions) t left join chains c on c.chain_id = t.k group by 1""")
def lookup_or_key(v: Views) -> DataFrame:
    counts = v.transactions.groupBy((F.col("chain_id") + 5).alias("k")).agg(n_rows().alias("n"))
    named = counts.join(v.chains, F.col("k") == F.col("chain_id"), "left")
    return named.groupBy(F.coalesce("name", F.col("k").cast("string")).alias("chain")).agg(F.sum("n").alias("transactions"))


def two_runs(v: Views) -> tuple[DataFrame, DataFrame]:
    """The distinct findings of the years before and after 1998 of each file, keyed by rule, file and line."""
    border = stamp("1998-01-01")
    keys = v.findings.select("rule_id", "file", "line_no", "month")
    return tuple(keys.where(c).drop("month").distinct() for c in (F.col("month") < border, F.col("month") >= border))  # type: ignore[return-value]


_RUNS = """with a as (select distinct rule_id, file, line_no from findings where month < timestamp '1998-01-01'), b as (select distinct rule_id, file, line_no from findings where month >= timestamp '1998-01-01') """


@add("J09_result_diff", "findings", _RUNS + """
select case when a.rule_id is null then 'new' when b.rule_id is null then 'fixed' else 'persistent' end as change, count(*) as findings
from a full join b on a.rule_id = b.rule_id and a.file = b.file and a.line_no = b.line_no group by 1""")
def result_diff(v: Views) -> DataFrame:
    """Which findings are new, fixed or persistent: a full outer join, made as one grouping of both runs."""
    keyed = v.findings.groupBy("rule_id", "file", "line_no").agg(
        F.bool_or(F.col("month") < stamp("1998-01-01")).alias("before"), F.bool_or(F.col("month") >= stamp("1998-01-01")).alias("after")
    )
    change = F.when(~F.col("before"), "new").when(~F.col("after"), "fixed").otherwise("persistent")
    return keyed.groupBy(change.alias("change")).agg(n_rows().alias("findings"))


@add("J10_scan_diff", "findings", _RUNS + """
select coalesce(a.file, b.file) as file, count(case when a.file is null then 1 end) as added, count(case when b.file is null then 1 end) as removed
from a full join b on a.rule_id = b.rule_id and a.file = b.file and a.line_no = b.line_no group by 1""")
def scan_diff(v: Views) -> DataFrame:
    a, b = two_runs(v)
    keys = ["rule_id", "file", "line_no"]
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), keys, "full")
    return both.groupBy("file").agg(F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"))


@add("J11_key_diff", "findings", """
with a as (select rule_id, sum(savings) as s from findings where month < timestamp '1998-01-01' group by 1), b as (select rule_id, sum(savings) as s from findings where month >= timestamp '1998-01-01' group by 1)
select coalesce(a.rule_id, b.rule_id) as key, case when a.s is null then 'added' when b.s is null then 'removed' else 'modified' end as change from a full join b on a.rule_id = b.rule_id where a.s is distinct from b.s""")
def key_diff(v: Views) -> DataFrame:
    late = F.col("month") >= stamp("1998-01-01")
    both = v.findings.groupBy(F.col("rule_id").alias("key")).agg(F.sum(F.when(~late, F.col("savings"))).alias("a"), F.sum(F.when(late, F.col("savings"))).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("key", change.alias("change"))


@add("J12_hash_diff", sql="""
with a as (select doc_id, sha256(text) as h from documents), b as (select doc_id + 1 as doc_id, sha256(text) as h from documents)
select case when a.h is null then 'added' when b.h is null then 'deleted' when a.h = b.h then 'unchanged' else 'modified' end as state, count(*) as files from a full join b using (doc_id) group by 1""")
def hash_diff(v: Views) -> DataFrame:
    hashes = v.raw("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    later = hashes.select((F.col("doc_id") + 1).alias("doc_id"), F.col("h").alias("k"))
    state = F.when(F.col("h").isNull(), "added").when(F.col("k").isNull(), "deleted").when(F.col("h") == F.col("k"), "unchanged").otherwise("modified")
    return hashes.join(later, "doc_id", "full").groupBy(state.alias("state")).agg(n_rows().alias("files"))


@add("J14_semi_and_anti", "findings", _RUNS + """
select 'new' as kind, count(*) as n from b where not exists (select 1 from a where a.rule_id = b.rule_id and a.line_no = b.line_no)
union all select 'fixed', count(*) from a where not exists (select 1 from b where a.rule_id = b.rule_id and a.line_no = b.line_no)
union all select 'unchanged', count(*) from b where exists (select 1 from a where a.rule_id = b.rule_id and a.line_no = b.line_no)""")
def semi_and_anti(v: Views) -> DataFrame:
    a, b = two_runs(v)
    keys = ["rule_id", "line_no"]
    parts = {"new": b.join(a, keys, "left_anti"), "fixed": a.join(b, keys, "left_anti"), "unchanged": b.join(a, keys, "left_semi")}
    counted = [d.agg(n_rows().alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@add("J16_first_owner", "findings", """
select id, case when severity = 'critical' then 'security' when starts_with(rule_id, 'PROMO') then 'marketing' when starts_with(file, 'Brand#1') then 'core' else 'triage' end as owner from findings""")
def first_owner(v: Views) -> DataFrame:
    """The first rule that matches gives the owner; the rules are one expression, so no row meets another."""
    rules = [("critical", None, None, "security"), (None, "PROMO", None, "marketing"), (None, None, "Brand#1", "core"), (None, None, None, "triage")]
    owners = []
    for severity, prefix, file, owner in rules:
        match = F.lit(True)
        if severity:
            match = match & (F.col("severity") == severity)
        if prefix:
            match = match & F.col("rule_id").startswith(prefix)
        if file:
            match = match & F.col("file").startswith(file)
        owners.append(F.when(match, F.lit(owner)))
    return v.findings.select("id", F.coalesce(*owners).alias("owner"))


@add("J17_subscriptions", "findings", """
with s as (select * from (values ('a', [1, 2, 3], 3), ('b', [], 5), ('c', [4], 1)) t(hook, projects, least_level)),
f as (select id, project_id, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) as level from findings)
select hook, count(*) as alerts from f join s on (len(projects) = 0 or list_contains(projects, project_id)) and level >= least_level group by 1""")
def subscriptions(v: Views) -> DataFrame:
    hooks = v.spark.createDataFrame([("a", [1, 2, 3], 3), ("b", [], 5), ("c", [4], 1)], "hook string, projects array<long>, least_level int")
    level = F.array_position(F.array(*map(F.lit, ["info", "low", "medium", "high", "critical"])), F.col("severity"))
    counts = v.findings.groupBy("project_id", level.alias("level")).agg(n_rows().alias("n"))
    match = ((F.size("projects") == 0) | F.array_contains("projects", F.col("project_id"))) & (F.col("level") >= F.col("least_level"))
    return counts.join(F.broadcast(hooks), match).groupBy("hook").agg(F.sum("n").alias("alerts"))


@add("J18_exact_duplicates", sql="""
with h as (select doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as h from documents) select min(doc_id) as representative, count(*) as copies from h group by h having count(*) > 1""")
def exact_duplicates(v: Views) -> DataFrame:
    """Classes of texts equal but for case and white space; one row for each class instead of all its pairs."""
    hashes = v.raw("documents").select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("h"))
    classes = hashes.groupBy("h").agg(F.min("doc_id").alias("representative"), n_rows().alias("copies"))
    return classes.where(F.col("copies") > 1).select("representative", "copies")


@add("J19_near_duplicates")
def near_duplicates(v: Views) -> DataFrame:
    """Documents by class of near-equal texts: five-word shingles, similarity of 0.8 or more."""
    return near_duplicate_classes(v.raw("documents"), "doc_id", "text")


@add("J22_conflicts", "findings", """
with f as (select distinct file, line_no, rule_id, severity from findings)
select file, line_no, count(distinct rule_id) as rules from f group by 1, 2 having count(distinct rule_id) > 1 and bool_or(severity = 'critical') and bool_or(severity = 'info')""")
def conflicts(v: Views) -> DataFrame:
    """Places whose findings pull in opposite directions; decided by grouping, not by pairs."""
    by = v.findings.groupBy("file", "line_no").agg(
        F.count_distinct("rule_id").alias("rules"), F.bool_or(F.col("severity") == "critical").alias("a"), F.bool_or(F.col("severity") == "info").alias("b")
    )
    return by.where((F.col("rules") > 1) & F.col("a") & F.col("b")).select("file", "line_no", "rules")


@add("J24_suggestions", "findings", """
with s as (select rule_id, list(id) as related from findings where severity = 'critical' group by 1)
select f.id, count(*) as suggestions from findings f join (select unnest(related) as id from s) r using (id) group by 1""")
def suggestions(v: Views) -> DataFrame:
    ids = v.findings.where(F.col("severity") == "critical").select("id")
    return v.findings.select("id").join(ids, "id").groupBy("id").agg(n_rows().alias("suggestions"))


@add("J27_as_of", "prices", """
with p as (select chain_id, ts, event_id, base_fee from prices where event_id % 2 = 0), q as (select chain_id, ts, event_id from prices where event_id % 2 = 1)
select q.event_id, p.event_id as price_event from q asof left join p on q.chain_id = p.chain_id and q.ts >= p.ts""")
def as_of(v: Views) -> DataFrame:
    """The latest even-numbered price at or before each odd-numbered event of its chain: one ordering of both sides."""
    rows = v.prices.select("chain_id", "ts", "event_id", (F.col("event_id") % 2 == 0).alias("price"))
    rows = rows.withColumn("later", ~F.col("price"))  # prices come first among rows of one time
    placed = with_latest(rows, ["chain_id"], ["ts", "later", "event_id"], F.when(F.col("price"), F.col("event_id")), "price_event")
    return placed.where("later").select("event_id", "price_event")


@add("O01_union_all", "findings", "select rule_id from findings where severity = 'critical' union all select rule_id from findings where confidence > 0.09")
def union_all(v: Views) -> DataFrame:
    rules = v.findings.select("rule_id", "severity", "confidence")
    return rules.where(F.col("severity") == "critical").select("rule_id").unionByName(rules.where(F.col("confidence") > 0.09).select("rule_id"))


@add("O03_shared_signals", "findings", """
with f as (select file, rule_id, count(distinct severity) as n, (select 1) as one from findings group by 1, 2), s as (select distinct file, rule_id, severity from findings), g as (select file, count(distinct rule_id) as rules from findings group by 1)
select s.file, string_agg(severity, ',' order by severity) as shared from (select file, severity, count(distinct rule_id) as n from s group by 1, 2) s join g using (file) where s.n = g.rules group by 1""")
def shared_signals(v: Views) -> DataFrame:
    """The severities that every rule of a file has: the intersection of the rules' sets."""
    sets = v.findings.groupBy("file", "rule_id").agg(F.collect_set("severity").alias("s"))
    shared = F.reduce(F.collect_list("s"), F.array(*map(F.lit, ["info", "low", "medium", "high", "critical"])), lambda a, b: F.array_intersect(a, b))
    common = sets.groupBy("file").agg(F.array_join(F.array_sort(shared), ",").alias("shared"))
    return common.where(F.col("shared") != "")


@add("O04_except", "findings", """
select distinct rule_id, file, line_no, project_id from findings where month >= timestamp '1998-01-01' except select rule_id, file, line_no, project_id from findings where month < timestamp '1998-01-01'""")
def difference(v: Views) -> DataFrame:
    """Findings of the later run that no project had before: keyed difference, made as one grouping of both runs."""
    late = F.col("month") >= stamp("1998-01-01")
    keyed = v.findings.groupBy("rule_id", "file", "line_no", "project_id").agg(F.bool_and(late).alias("new"))
    return keyed.where("new").drop("new")


@add("O05_sorted_distinct", "findings", "select file, string_agg(distinct severity, ',' order by severity) as severities from findings group by 1")
def sorted_distinct(v: Views) -> DataFrame:
    return v.findings.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))


@add("O08_canonical", "findings", """
with r as (select file, line_no, id, row_number() over (partition by file, line_no order by list_position(['critical', 'high', 'medium', 'low', 'info'], severity), confidence desc, id) as k from findings) select file, line_no, id from r where k = 1""")
def canonical(v: Views) -> DataFrame:
    """One finding for each place: highest severity, then confidence, then id; kept by a mergeable minimum."""
    rank = F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), F.col("severity"))
    return v.findings.groupBy("file", "line_no").agg(F.min_by("id", F.struct(rank, -F.col("confidence"), F.col("id"))).alias("id"))


@add("O09_rule_dedup", "findings", """
with r as (select rule_id, message, row_number() over (partition by rule_id order by length(message) desc, message) as k from findings) select rule_id, message from r where k = 1""")
def rule_dedup(v: Views) -> DataFrame:
    return v.findings.groupBy("rule_id").agg(F.min_by("message", F.struct(-F.length("message"), F.col("message"))).alias("message"))


@add("O10_drop_duplicates", sql="select distinct transactionHash as hash from gas_transactions where transactionHash is not null")
def drop_duplicates(v: Views) -> DataFrame:
    return v.raw("gas_transactions").select(F.col("transactionHash").alias("hash")).where(F.col("hash").isNotNull()).dropDuplicates()


@add("O11_set_operations", "transactions", """
select merchant_id from transactions where status = 'success' intersect select merchant_id from transactions where status = 'failed' except select merchant_id from transactions where status = 'pending'""")
def set_operations(v: Views) -> DataFrame:
    """In success and failed but not in pending: one grouping of the rows instead of three scans."""
    has = {s: F.bool_or(F.col("status") == s).alias(s) for s in ("success", "failed", "pending")}
    return v.transactions.groupBy("merchant_id").agg(*has.values()).where("success and failed and not pending").select("merchant_id")


@add("X01_levenshtein", sql="""
with p as (select distinct p_name as t from part) select a.t as a, b.t as b, round(1 - levenshtein(lower(a.t), lower(b.t)) * 1.0 / greatest(length(a.t), length(b.t)), 6) as similarity
from p a join p b on split_part(a.t, ' ', 1) = split_part(b.t, ' ', 1) and a.t < b.t""")
def levenshtein_pairs(v: Views) -> DataFrame:
    """Names that share their first word, with their similarity (the blocks are bounded by the vocabulary)."""
    pairs = named_pairs(v)
    return pairs.select("a", "b", F.round(levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def named_pairs(v: Views) -> DataFrame:
    left = v.raw("part").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.split("a", " ")[0])
    return left.join(left.withColumnRenamed("a", "b"), "k").where(F.col("a") < F.col("b"))


@add("X02_jaccard", sql="""
with p as (select distinct p_name as t from part) select a.t as a, b.t as b, round(len(list_intersect(string_split(lower(a.t), ' '), string_split(lower(b.t), ' '))) * 1.0 / len(list_distinct(string_split(lower(a.t), ' ') || string_split(lower(b.t), ' '))), 6) as similarity
from p a join p b on split_part(a.t, ' ', 1) = split_part(b.t, ' ', 1) and a.t < b.t""")
def jaccard_pairs(v: Views) -> DataFrame:
    return named_pairs(v).select("a", "b", F.round(jaccard(tokens(F.col("a")), tokens(F.col("b"))), 6).alias("similarity"))


@add("X04_fingerprint", "sources", """
select file, sha256(trim(regexp_replace(regexp_replace(source, '//[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))) as fingerprint from sources""")
def fingerprint(v: Views) -> DataFrame:
    bare = F.trim(F.regexp_replace(F.regexp_replace("source", r"//[^\n]*", ""), r"\s+", " "))
    return v.sources.select("file", F.sha2(bare, 256).alias("fingerprint"))


@add("X05_structural_hash", "sources", """
select file, sha256(array_to_string(list_filter(string_split(source, chr(10)), lambda l: regexp_matches(l, '^\\s*(pub )?(fn|struct|impl|trait|enum|function|contract)\\b')), chr(10))) as h from sources""")
def structural_hash(v: Views) -> DataFrame:
    lines = F.filter(F.split("source", "\n"), lambda x: x.rlike(r"^\s*(pub )?(fn|struct|impl|trait|enum|function|contract)\b"))
    return v.sources.select("file", F.sha2(F.array_join(lines, "\n"), 256).alias("h"))


@add("X63_line_diff", "sources", """
with l as (select file, unnest(string_split(source, chr(10))) as t, generate_subscripts(string_split(source, chr(10)), 1) as k from sources),
d as (select a.file, case when b.t is null then 'deleted' when a.t = b.t then 'same' else 'modified' end as c from l a left join l b on b.file = a.file + 1 and a.k = b.k)
select file, count(case when c = 'deleted' then 1 end) as deleted, count(case when c = 'modified' then 1 end) as modified from d group by 1""")
def line_diff(v: Views) -> DataFrame:
    """Each text against the next one, line by line in place: arrays zipped, so lines aren't joined one by one."""
    texts = v.sources.select("file", F.split("source", "\n").alias("a"))
    following = texts.select((F.col("file") - 1).alias("file"), F.col("a").alias("b"))
    both = texts.join(following, "file", "left")
    other = F.coalesce("b", F.array().cast("array<string>"))
    same_place = F.slice(F.arrays_zip(F.col("a").alias("x"), other.alias("y")), 1, F.size("a"))
    rows = both.select("file", F.size("a").alias("na"), F.size(other).alias("nb"), same_place.alias("z"))
    changed = F.size(F.filter("z", lambda p: p["y"].isNotNull() & (p["x"] != p["y"])))
    return rows.select("file", F.greatest(F.col("na") - F.col("nb"), F.lit(0)).cast("long").alias("deleted"), changed.cast("long").alias("modified"))
