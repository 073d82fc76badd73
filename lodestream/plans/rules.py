"""The rule language over documents (U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.dsl import parse_rules, run_rules
from lodestream.plans.query import Register
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add

#: Documents as source files: every text is looked at as if it were of the language its code is in.
_FILES = """with f as (select cast(doc_id as varchar) || case when contains(text, 'pub fn ') then '.rs' when contains(text, ' external ') then '.sol' else '.vy' end as file, text as source from documents),
l as (select file, source, unnest(string_split(rtrim(source, chr(10)), chr(10))) as t, generate_subscripts(string_split(rtrim(source, chr(10)), chr(10)), 1) as line from f) """


def files(v: Views) -> DataFrame:
    text = F.col("text")
    ending = F.when(text.contains("pub fn "), ".rs").when(text.contains(" external "), ".sol").otherwise(".vy")
    return v.raw("documents").select(F.concat(F.col("doc_id").cast("string"), ending).alias("file"), text.alias("source"))


def rule(condition: str, language: str = "any", severity: str = "warning", message: str = "{snippet} at {line}") -> str:
    return f'rule r1 {{ name: "n" description: "d" severity: {severity} language: {language} when {{ {condition} }} message: "{message}" }}'


def findings(v: Views, text: str) -> DataFrame:
    return run_rules(files(v), parse_rules(text)).select("rule_id", "file", "line", "message")


@add("U04_contains_pattern", sql=_FILES + "select 'r1' as rule_id, file, cast(line as integer) as line, regexp_extract(t, 'retry budget|slot [a-z]+') || ' at ' || line as message from l where regexp_matches(t, 'retry budget|slot [a-z]+')")
def contains_pattern(v: Views) -> DataFrame:
    return findings(v, rule('contains_pattern("retry budget|slot [a-z]+")'))


@add("U05_line_count", sql=_FILES + "select 'r1' as rule_id, file, 1 as line, n || ' lines (threshold: 12) at 1' as message from (select file, count(*) as n from l group by 1) where n > 12")
def line_count(v: Views) -> DataFrame:
    return findings(v, rule("line_count_exceeds(12)"))


@add("U06_function_count", sql=_FILES + "select 'r1' as rule_id, file, 1 as line, len(regexp_extract_all(source, '\\b(fn|function|def)\\s+\\w+')) || ' functions (threshold: 0) at 1' as message from f where len(regexp_extract_all(source, '\\b(fn|function|def)\\s+\\w+')) > 0")
def function_count(v: Views) -> DataFrame:
    return findings(v, rule("function_count_exceeds(0)"))


@add("U07_has_keyword", sql=_FILES + "select 'r1' as rule_id, file, cast(line as integer) as line, 'require at ' || line as message from l where regexp_matches(t, '\\brequire\\b')")
def has_keyword(v: Views) -> DataFrame:
    return findings(v, rule('has_keyword("require")'))


@add("U08_lacks_keyword", sql=_FILES + "select 'r1' as rule_id, file, 1 as line, 'keyword ''the'' not found at 1' as message from f where not regexp_matches(source, '\\bthe\\b')")
def lacks_keyword(v: Views) -> DataFrame:
    return findings(v, rule('lacks_keyword("the")'))


@add("U09_identifiers", sql=_FILES + "select 'r1' as rule_id, file, cast(line as integer) as line, unnest(regexp_extract_all(t, '\\b[a-z]+[0-9]\\b')) || ' at ' || line as message from l")
def identifiers(v: Views) -> DataFrame:
    return findings(v, rule('identifier_matches("[a-z]+[0-9]")'))


@add("U10_comment_ratio", sql=_FILES + "select 'r1' as rule_id, file, 1 as line, 'few comments' as message from (select file, count(case when regexp_matches(t, '^\\s*(//|#|/\\*|\\*)') then 1 end) * 1.0 / count(*) as r from l group by 1) where r < 0.1")
def comment_ratio(v: Views) -> DataFrame:
    return findings(v, rule("comment_ratio_below(0.1)", message="few comments"))


@add("U11_nesting_depth", sql=_FILES + """, b as (select file, line, generate_subscripts(string_split(t, ''), 1) as k, unnest(string_split(t, '')) as c from l),
d as (select file, line, k, sum(case c when '{' then 1 when '}' then -1 else 0 end) over (partition by file order by line, k) as depth from b),
m as (select file, max(depth) as top from d group by 1)
select 'r1' as rule_id, d.file, cast(min(line) as integer) as line, 'max nesting depth ' || cast(top as bigint) || ' (threshold: 1) at ' || min(line) as message from d join m using (file) where depth = top and top > 1 group by d.file, top""")
def nesting_depth(v: Views) -> DataFrame:
    return findings(v, rule("nesting_depth_exceeds(1)"))


@add("U13_and_or_not", sql=_FILES + """, a as (select file, line, 'require' as s from l where regexp_matches(t, '\\brequire\\b')), b as (select file, line, regexp_extract(t, 'return [a-z0-9]+') as s from l where regexp_matches(t, 'return [a-z0-9]+')),
c as (select file, line, 'emit' as s from l where regexp_matches(t, '\\bemit\\b')),
pair as (select * from a where file in (select file from b) union all select * from b where file in (select file from a)),
one as (select * from pair union all select * from c where file not in (select file from pair)),
n as (select 'r2' as rule_id, file, 1 as line, 'not-condition satisfied at 1' as message from f where file not in (select file from l where contains(t, 'gas')))
select 'r1' as rule_id, file, cast(line as integer) as line, s || ' at ' || line as message from one union all select * from n""")
def and_or_not(v: Views) -> DataFrame:
    text = rule('has_keyword("require") and contains_pattern("return [a-z0-9]+") or has_keyword("emit")')
    return findings(v, text + rule('not contains_pattern("gas")').replace("rule r1", "rule r2"))


@add("U15_rules_by_language", sql=_FILES + "select 'r1' as rule_id, file, cast(line as integer) as line, 'let at ' || line as message from l where regexp_matches(t, '\\blet\\b') and file like '%.rs' union all select 'r2', file, cast(line as integer), 'emit at ' || line from l where regexp_matches(t, '\\bemit\\b') and file like '%.sol'")
def rules_by_language(v: Views) -> DataFrame:
    return findings(v, rule('has_keyword("let")', "rust") + rule('has_keyword("emit")', "solidity").replace("rule r1", "rule r2"))
