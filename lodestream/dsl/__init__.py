"""A small rule language over source text, compiled to Spark columns."""

from lodestream.dsl.language import Rule, RuleError, parse_rules
from lodestream.dsl.plan import FINDING, compile_condition, run_rules

__all__ = ["FINDING", "Rule", "RuleError", "compile_condition", "parse_rules", "run_rules"]
