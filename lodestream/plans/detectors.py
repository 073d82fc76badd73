"""Source detectors over documents (R)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from lodestream.detectors.engine import Detector, run
from lodestream.detectors.rules import RULES
from lodestream.plans.query import Register
from lodestream.plans.rules import files
from lodestream.plans.views import Views

QUERIES = Register()

_FILES = """with f as (select cast(doc_id as varchar) || case when contains(text, 'pub fn ') then '.rs' when contains(text, ' external ') then '.sol' else '.vy' end as file, text as source from documents),
l as (select file, source, string_split(source, chr(10)) as ls, unnest(string_split(source, chr(10))) as t, generate_subscripts(string_split(source, chr(10)), 1) as line from f) """


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tests(column: str, has, lacks) -> str:
    tests = [f"regexp_matches({column}, {_quoted(p)})" for p in has] + [f"not regexp_matches({column}, {_quoted(p)})" for p in lacks]
    return " and ".join(tests or ["true"])


def _restated(find, message: str) -> list[str] | None:
    """The search as SQL selects of (file, line, message), or None where SQL can't say it (look-around, state over lines)."""
    name, args, named = getattr(find, "made_of", (None, (), {}))
    lacks, said = named.get("lacks", ()), _quoted(message)
    if name == "several":
        parts = [_restated(*part) for part in args]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    if any(re.search(r"\(\?[=!<s]", p) for p in [*args, *lacks, named.get("need"), named.get("unless")] if isinstance(p, str)):
        return None
    if name == "on_lines" and "not_among" not in named:
        if "named" in named:
            said = f"replace({said}, '{{}}', regexp_extract(t, {_quoted(named['named'])}, 1))"
        return [f"select file, line, {said} as message from l where {_tests('t', args, lacks)}"]
    if name == "first_line":
        return [f"select file, 1 as line, {said} as message from f where {_tests('source', args, lacks)}"]
    if name == "near":
        start = f"greatest(line - {named.get('before', 0)}, 1)"
        stop = f"{start} + {named['lines'] - 1}" if named.get("lines", 1) is not None and "lines" in named else "line - 1" if "lines" in named else start
        around = f"coalesce(array_to_string(list_slice(ls, {start}, {stop}), chr(10)), '')"
        where = [_tests("t", args, lacks)]
        if "need" in named:
            where.append(f"len(regexp_extract_all({around}, {_quoted(named['need'])})) > {named.get('more_than', 0)}")
        if "unless" in named:
            where.append(f"not regexp_matches({around}, {_quoted(named['unless'])})")
        return [f"select file, line, {said} as message from l where {' and '.join(where)}"]
    if name == "anywhere" and len(args) == 1:
        return [f"select file, line, replace({said}, '{{}}', unnest(regexp_extract_all(t, {_quoted(args[0])}))) as message from l"]
    return None


def _sql(detectors: list[Detector]) -> str | None:
    selects = []
    for d in detectors:
        parts = _restated(d.find, d.message)
        if parts is None:
            return None
        mine = " or ".join(f"file like '%{e}'" for e in d.endings) or "true"
        selects += [f"select {_quoted(d.rule_id)} as rule_id, file, cast(line as integer) as line, message from ({p}) where {mine}" for p in parts]
    return _FILES + " union all ".join(selects)


def _query(detectors: list[Detector]):
    def found(v: Views) -> DataFrame:
        return run(files(v), detectors).select("rule_id", "file", "line", "message")

    found.__doc__ = f"Findings of {', '.join(d.rule_id for d in detectors)} in documents taken as source files."
    return found


for _key, _detectors in RULES.items():
    QUERIES.add(_key, sql=_sql(_detectors))(_query(_detectors))
