"""Scalar functions (X): text, time, scores and lines, each over a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import costs
from lodestream.functions.text import slug, squeeze, titled
from lodestream.operators.findings import annotated, applied_fixes, inline_suppressions, snippets
from lodestream.plans.query import Register
from lodestream.plans.views import Views
from lodestream.sources.files import glob_pattern
from lodestream.streaming.monitors import CHAIN_THRESHOLDS, THRESHOLDS, threshold_levels

QUERIES = Register()
add = QUERIES.add


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


@add("X03_normalised", "sources", "select file, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) as text from sources")
def normalised(v: Views) -> DataFrame:
    return v.sources.select("file", squeeze(F.col("source")).alias("text"))


@add("X06_globs", "findings", "select distinct file from findings where regexp_matches(file, '^Brand#1[^/]*$')")
def globs(v: Views) -> DataFrame:
    return v.findings.where(F.col("file").rlike(glob_pattern("Brand#1*"))).select("file").distinct()


@add("X07_inline_suppressions", "sources", """
with l as (select file, unnest(string_split(source, chr(10))) as t, generate_subscripts(string_split(source, chr(10)), 1) as line from sources),
c as (select file, line, trim(substr(t, strpos(t, '//') + 2)) as c from l where contains(t, '//')),
r as (select file, line, trim(substr(c, 10)) as r from c where lower(c) like 'redundant%'),
p as (select file, line, string_split(r, '--') as parts from r)
select file, cast(line as integer) as line, rule_id, coalesce(nullif(trim(array_to_string(parts[2:], '--')), ''), 'No reason provided') as reason
from (select file, line, parts, trim(unnest(string_split(parts[1], ','))) as rule_id from p) where rule_id <> ''""")
def suppressions(v: Views) -> DataFrame:
    """Comments that begin with a word, here one that the texts have, read as suppressions of the rules they name."""
    return inline_suppressions(v.sources, "redundant")


@add("X08_slugs", "findings", """
select distinct rule_id || ' ' || message as name, trim(regexp_replace(lower(rule_id || ' ' || message), '[^a-z0-9]+', '-', 'g'), '-') as slug from findings""")
def slugs(v: Views) -> DataFrame:
    names = v.findings.select(F.concat_ws(" ", "rule_id", "message").alias("name")).distinct()
    return names.select("name", slug(F.col("name")).alias("slug"))


@add("X09_quoted", "sources", """select file, case when regexp_matches(source, '[",\\n\\r]') then '"' || replace(source, '"', '""') || '"' else source end as field from sources""")
def quoted(v: Views) -> DataFrame:
    """A text as a field of a comma-separated line: quoted where it must be, quotes doubled."""
    text = F.col("source")
    return v.sources.select("file", F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text).alias("field"))


@add("X10_templates", "findings", "select id, 'line ' || line_no || ' of ' || file || ': ' || message as text from findings")
def templates(v: Views) -> DataFrame:
    text = F.lit("line {line} of {file}: {snippet}")
    for mark, column in (("{line}", F.col("line_no").cast("string")), ("{file}", F.col("file")), ("{snippet}", F.col("message"))):
        text = F.replace(text, F.lit(mark), column)
    return v.findings.select("id", text.alias("text"))


@add("X11_buckets", "metrics", """
select event_id, strftime(ts, '%Y-%m-%d %H:00') as "hour", strftime(ts, '%Y-%m-%d') as "day", strftime(date_trunc('week', ts), '%Y-%m-%d') as "week", strftime(ts, '%Y-%m') as "month" from metrics""")
def buckets(v: Views) -> DataFrame:
    return v.metrics.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"), day("ts").alias("day"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.date_format("ts", "yyyy-MM").alias("month"),
    )


@add("X12_week_and_month_bounds", "metrics", """
select event_id, strftime(date_trunc('week', ts) - interval 7 day, '%Y-%m-%d') as last_week_from, strftime(date_trunc('week', ts) - interval 1 day, '%Y-%m-%d') as last_week_to,
  strftime(date_trunc('month', ts), '%Y-%m-%d') as month_from, strftime(last_day(ts), '%Y-%m-%d') as month_to from metrics""")
def bounds(v: Views) -> DataFrame:
    monday = F.to_date(F.date_trunc("week", "ts"))
    return v.metrics.select(
        "event_id", day(F.date_sub(monday, 7)).alias("last_week_from"), day(F.date_sub(monday, 1)).alias("last_week_to"),
        day(F.date_trunc("month", "ts")).alias("month_from"), day(F.last_day("ts")).alias("month_to"),
    )


@add("X13_period_end", sql="""
select id, case lower(trim(capType)) when 'daily' then strftime(date_trunc('day', periodStart) + interval 1 day, '%Y-%m-%d') when 'weekly' then strftime(date_trunc('week', periodStart) + interval 7 day, '%Y-%m-%d')
  when 'monthly' then strftime(date_trunc('month', periodStart) + interval 1 month, '%Y-%m-%d') end as ends from gas_subsidy_caps""")
def period_end(v: Views) -> DataFrame:
    """When a cap's period ends: the next day, Monday or first of the month after its start; a lifetime never."""
    kind, start = F.lower(F.trim("capType")), F.col("periodStart")
    ends = F.when(kind == "daily", F.date_add(F.to_date(start), 1)).when(kind == "weekly", F.date_add(F.to_date(F.date_trunc("week", start)), 7))
    ends = ends.when(kind == "monthly", F.to_date(F.add_months(F.to_date(F.date_trunc("month", start)), 1)))
    return v.raw("gas_subsidy_caps").select("id", F.date_format(ends, "yyyy-MM-dd").alias("ends"))


@add("X14_range_start", "metrics", """
with m as (select max(ts) as t from metrics), r as (select unnest(['24h', '7d', '30d']) as r, unnest([24, 168, 720]) as h)
select r as "range", count(*) as events from metrics, m, r where ts >= t - h * interval 1 hour group by 1""")
def range_start(v: Views) -> DataFrame:
    """Events of the last 24 hours, 7 and 30 days before the newest: one pass, counted under each range."""
    newest = v.metrics.agg(F.max("ts").alias("t"))
    rows = v.metrics.join(F.broadcast(newest)).select(((F.unix_micros("t") - F.unix_micros("ts")) / 3_600_000_000).alias("age"))
    counts = rows.agg(*[F.count_if(F.col("age") <= h).alias(k) for k, h in (("24h", 24), ("7d", 168), ("30d", 720))])
    return counts.unpivot([], ["24h", "7d", "30d"], "range", "events")


@add("X15_durations", "metrics", """
select event_id, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' else s // 3600 || 'h' end as duration from (select event_id, cast(floor(response_time * 60) as bigint) as s from metrics)""")
def durations(v: Views) -> DataFrame:
    s = F.floor(F.col("response_time") * 60).cast("long")
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
    return v.metrics.select("event_id", text.otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).alias("duration"))


@add("X24_z_scores", "tx_lines", """
with b as (select merchant_id, avg(gas_used) as m, stddev_pop(gas_used) as s from tx_lines group by 1)
select t.id, t.line, round(case when s = 0 then 0 else (gas_used - m) / s end, 6) as z, case when s = 0 then null when (gas_used - m) / s > 5 then 'high' when (gas_used - m) / s > 3 then 'medium' when (gas_used - m) / s > 1.5 then 'low' end as band
from tx_lines t join b using (merchant_id)""")
def z_scores(v: Views) -> DataFrame:
    """Distance from the account's mean in deviations, and its band; a join with the per-account figures, no window over rows."""
    base = v.tx_lines.groupBy("merchant_id").agg(F.avg("gas_used").alias("m"), F.stddev_pop("gas_used").alias("s"))
    rows = v.tx_lines.join(base, "merchant_id")
    z = costs.z_score(F.col("gas_used"), F.col("m"), F.col("s"))
    return rows.select("id", "line", F.round(z, 6).alias("z"), costs.band(z, 1.5, 3, 5).alias("band"))


@add("X27_volatility_level", "prices", """
with i as (select chain_id, least(greatest(stddev_pop(base_fee) / avg(base_fee), 0), 1) as i from prices group by 1)
select chain_id, round(i, 6) as index, case when i <= 0.25 then 'Low' when i <= 0.5 then 'Moderate' when i <= 0.75 then 'High' else 'Extreme' end as level from i""")
def volatility_level(v: Views) -> DataFrame:
    index = F.least(F.greatest(F.stddev_pop("base_fee") / F.avg("base_fee"), F.lit(0.0)), F.lit(1.0))
    by = v.prices.groupBy("chain_id").agg(index.alias("index"))
    return by.select("chain_id", F.round("index", 6).alias("index"), costs.volatility_level(F.col("index")).alias("level"))


@add("X28_volatility_index", "prices", """
with n as (select *, row_number() over (partition by chain_id order by ts desc, event_id desc) as k, count(*) over (partition by chain_id) as n from prices),
a as (select chain_id, count(*) as points, avg(base_fee) as m, stddev_pop(base_fee) as s, avg(case when k <= greatest(1, floor(n * 0.1)) then base_fee end) as short from n group by 1)
select chain_id, points, round(case when points < 2 then 0 else least(greatest(case when m > 0 then s / m else 0 end * 0.7 + abs(case when m > 0 then short / m else 1 end - 1) * 0.3, 0), 1) end, 6) as index from a""")
def volatility_index(v: Views) -> DataFrame:
    """Deviation over mean (weight 0.7) and the newest tenth's mean over the whole's (0.3), between 0 and 1.

    The newest tenth is cut off by count: points are first counted by chain and hour, so that only hours are ordered.
    """
    hours = v.prices.withColumn("hour", F.date_trunc("hour", "ts"))
    counts = hours.groupBy("chain_id", "hour").agg(F.count(F.lit(1)).alias("c"))
    chain = Window.partitionBy("chain_id")
    later = F.coalesce(F.sum("c").over(chain.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("chain_id", "hour", later.alias("later"), F.sum("c").over(chain).alias("n"))
    place = F.row_number().over(Window.partitionBy("chain_id", "hour").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = hours.withColumn("k", place).join(counts, ["chain_id", "hour"])
    short = F.when(F.col("later") + F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), F.col("base_fee"))
    by = rows.groupBy("chain_id").agg(F.count(F.lit(1)).alias("points"), F.avg("base_fee").alias("m"), F.stddev_pop("base_fee").alias("s"), F.avg(short).alias("short"))
    return by.select("chain_id", "points", F.round(costs.volatility_index(F.col("points"), F.col("m"), F.col("s"), F.col("short")), 6).alias("index"))


@add("X29_thresholds", "prices", """
with p as (select event_id, chain_id, base_fee * 2 as fee, priority_fee as surge from prices),
r as (select *, case when chain_id = 7 then (case when fee >= 30 then 3 when fee >= 20 then 2 when fee >= 10 then 1 else 0 end) else (case when fee >= 100 then 3 when fee >= 80 then 2 when fee >= 50 then 1 else 0 end) end as a,
  case when surge >= 100 then 3 when surge >= 70 then 2 when surge >= 30 then 1 else 0 end as b from p)
select event_id, case greatest(a, b) when 3 then 'critical' when 2 then 'warning' when 1 then 'info' end as level from r""")
def thresholds(v: Views) -> DataFrame:
    """The highest severity any measure reaches; a chain with thresholds of its own takes those, others the global ones (key 0)."""
    rows = v.prices.select("event_id", "chain_id", (F.col("base_fee") * 2).alias("absolute_gwei"), F.col("priority_fee").alias("priority_fee_percentage"))
    return threshold_levels(rows, "chain_id", THRESHOLDS | CHAIN_THRESHOLDS).select("event_id", "level")


@add("X33_effective_fee", sql="select transactionHash as hash, cast(gasUsed as decimal(38,0)) * 21 as fee from gas_transactions where transactionHash is not null")
def effective_fee(v: Views) -> DataFrame:
    """Gas times price in whole units, beyond what a double holds."""
    fee = F.col("gasUsed").cast("decimal(20,0)") * F.lit(21).cast("decimal(10,0)")
    return v.raw("gas_transactions").where(F.col("transactionHash").isNotNull()).select(F.col("transactionHash").alias("hash"), fee.cast("decimal(38,0)").alias("fee"))


@add("X34_cost_normalised", "tx_lines", "select id, line, round(round(gas_used * gas_price / 1e6, 6) * 1.5, 6) as usd from tx_lines")
def cost_normalised(v: Views) -> DataFrame:
    """Rounded to six places before the price is applied."""
    return v.tx_lines.select("id", "line", F.round(F.round(F.col("gas_used") * F.col("gas_price") / 1e6, 6) * 1.5, 6).alias("usd"))


@add("X35_resource_cost", "tx_lines", """
with r as (select id, line, gas_used * 100 as instructions, gas_price * 1000 as bytes from tx_lines)
select id, line, ceil(instructions / 10000) as increments, round(power(instructions / 500000000, 2), 12) as pressure, round(bytes / 41943040, 9) as memory, round(100 * exp(5 * bytes / 41943040), 6) as memory_cost from r""")
def resource_cost(v: Views) -> DataFrame:
    instructions, used = F.col("gas_used") * 100, F.col("gas_price") * 1000
    cpu, memory = costs.cpu_cost(instructions, limit_ledger=500_000_000), costs.memory_cost(used)
    return v.tx_lines.select(
        "id", "line", cpu["increments"].cast("double").alias("increments"), F.round(cpu["pressure"], 12).alias("pressure"), F.round(memory["normalized"], 9).alias("memory"),
        F.round(memory["cost"], 6).alias("memory_cost"),
    )


@add("X42_code_features", "sources", """
select file, 1 + len(regexp_extract_all(source, '\\b(if|for|while|match|case)\\b|&&|\\|\\|')) as branches, len(regexp_extract_all(source, '\\b(let|uint256|uint|int)\\s+\\w+')) as variables, len(regexp_extract_all(source, '\\bstorage\\b')) as storage,
  len(regexp_extract_all(source, '\\bmemory\\b')) as memory from sources""")
def code_features(v: Views) -> DataFrame:
    """Counts that stand for a text's complexity."""
    count = lambda p: F.regexp_count("source", F.lit(p)).cast("long")
    return v.sources.select(
        "file", (count(r"\b(if|for|while|match|case)\b|&&|\|\|") + 1).alias("branches"), count(r"\b(let|uint256|uint|int)\s+\w+").alias("variables"),
        count(r"\bstorage\b").alias("storage"), count(r"\bmemory\b").alias("memory"),
    )


@add("X62_line_edits", "sources", """
with n as (select file, source, string_split(source, chr(10)) as ls from sources),
e as (select file, source, list_transform(ls, lambda x, i: case when i = 2 then 'second' when i = len(ls) then '' else x end) as ls from n)
select file, array_to_string(list_filter(ls, lambda x, i: not (i = len(ls) and i <> 2)), chr(10)) as edited from e""")
def line_edits(v: Views) -> DataFrame:
    """Fixes joined to their file: the second line replaced, the last one (where it is another) removed."""
    count = F.size(F.split("source", "\n"))
    last = v.sources.where(count != 2).select("file", count.alias("line"), F.lit(None).cast("string").alias("text"))
    fixes = v.sources.where(count >= 2).select("file", F.lit(2).alias("line"), F.lit("second").alias("text")).unionByName(last)
    return applied_fixes(v.sources.select("file", "source"), fixes).select("file", F.col("source").alias("edited"))


@add("X65_annotated", "sources", """
with l as (select file, unnest(string_split(source, chr(10))) as t, generate_subscripts(string_split(source, chr(10)), 1) as k from sources)
select file, string_agg(case when contains(t, 'require') then t || chr(10) || '// ^ check' else t end, chr(10) order by k) as text from l group by 1""")
def annotated_sources(v: Views) -> DataFrame:
    """Each text with its notes under the lines they belong to."""
    lines = v.sources.select("file", F.posexplode(F.split("source", "\n")).alias("k", "t"))
    notes = lines.where(F.col("t").contains("require")).select("file", (F.col("k") + 1).alias("line"), F.lit("// ^ check").alias("note"))
    return annotated(v.sources.select("file", "source"), notes).select("file", F.col("source").alias("text"))


@add("X66_snippets", "sources", """
with l as (select file, string_split(source, chr(10)) as ls from sources) select file, array_to_string(list_slice(ls, greatest(3 - 1, 1), 4 + 1), chr(10)) as snippet from l""")
def evidence(v: Views) -> DataFrame:
    """Lines 3 to 4 with one line of context on either side."""
    return v.sources.select("file", snippets(F.col("source"), F.lit(3), F.lit(4), 1).alias("snippet"))


@add("X67_array_functions", "sources", """
with w as (select file, list_distinct(list_filter(string_split(lower(source), ' '), lambda x: x <> '')) as w from sources)
select file, len(w) as words, len(list_filter(w, lambda x: length(x) > 12)) > 0 as some_long, len(list_filter(w, lambda x: length(x) > 2)) = len(w) as every_long, list_contains(w, 'the') as has_the from w""")
def array_functions(v: Views) -> DataFrame:
    w = v.sources.select("file", F.array_distinct(F.filter(F.split(F.lower("source"), " "), lambda x: x != "")).alias("w"))
    return w.select(
        "file", F.size("w").cast("long").alias("words"), F.exists("w", lambda x: F.length(x) > 12).alias("some_long"), F.forall("w", lambda x: F.length(x) > 2).alias("every_long"),
        F.array_contains("w", "the").alias("has_the"),
    )


@add("X68_json", sql="select event_id, cast(json_extract_string(props, '$.k') as integer) as k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as document from events")
def json_functions(v: Views) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return v.raw("events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("document"))


@add("X69_versions", sql="""
with p as (select p_partkey, (p_partkey % 7) || '.' || (p_partkey % 13) || '.' || (p_partkey % 5) as version, [p_partkey % 7, p_partkey % 13, p_partkey % 5] as n from part)
select p_partkey as part, version, n >= [3, 2, 1] as at_least, n[1] = 3 and n >= [3, 2, 1] as caret, n[1] = 3 and n[2] = 2 and n[3] >= 1 as tilde from p""")
def versions(v: Views) -> DataFrame:
    """Versions against >=3.2.1, ^3.2.1 and ~3.2.1: numbers compared part by part."""
    text = F.concat_ws(".", *[(F.col("p_partkey") % m).cast("string") for m in (7, 13, 5)])
    rows = v.raw("part").select(F.col("p_partkey").alias("part"), text.alias("version"))
    return rows.select("part", "version", *[costs.satisfies(F.col("version"), r).alias(n) for n, r in (("at_least", ">=3.2.1"), ("caret", "^3.2.1"), ("tilde", "~3.2.1"))])


@add("X08_titles", "findings", "select distinct rule_id, upper(rule_id[1]) || lower(rule_id[2:]) as title from findings")
def titles(v: Views) -> DataFrame:
    return v.findings.select("rule_id", titled(F.col("rule_id")).alias("title")).distinct()
