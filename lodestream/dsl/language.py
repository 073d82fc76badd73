"""Reading rules: tokens, a precedence-climbing condition parser, and checks of fields, predicates and arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class RuleError(ValueError):
    """A rule text that can't be used; says where and why."""


@dataclass(frozen=True)
class Predicate:
    name: str
    args: tuple


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Neither:
    inner: object


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    severity: str
    condition: object
    message: str
    language: str = "any"
    tags: tuple[str, ...] = ()
    suggestion: str | None = None


#: What fields, severities, languages and predicates there are (a predicate's argument: text, whole, number or none).
REQUIRED = ("name", "description", "severity", "when", "message")
OPTIONAL = ("language", "tags", "suggestion")
SEVERITIES = ("info", "warning", "error", "critical")
LANGUAGES = ("solidity", "rust", "vyper", "any")
PREDICATES = {
    "contains_pattern": "text",
    "matches_regex": "text",
    "line_count_exceeds": "whole",
    "function_count_exceeds": "whole",
    "has_keyword": "text",
    "lacks_keyword": "text",
    "identifier_matches": "text",
    "comment_ratio_below": "number",
    "nesting_depth_exceeds": "whole",
    "always": None,
    "never": None,
}

_TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<text>"(?:\\.|[^"\\])*")
      | (?P<number>-?\d+(?:\.\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_-]*)
      | (?P<mark>[{}()\[\]:,])""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


@dataclass
class _Reader:
    source: str
    tokens: list[tuple[str, object, int]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place = 0
        while place < len(self.source):
            m = _TOKENS.match(self.source, place)
            if not m:
                raise RuleError(f"{self.where(place)}: unexpected {self.source[place]!r}")
            kind, text = m.lastgroup, m.group()
            if kind == "text":
                value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x.group(1), "\\" + x.group(1)), text[1:-1], flags=re.S)
                self.tokens.append(("text", value, place))
            elif kind == "number":
                self.tokens.append(("number", float(text) if "." in text else int(text), place))
            elif kind != "skip":
                self.tokens.append((kind, text, place))
            place = m.end()
        self.tokens.append(("end", "end of text", place))

    def where(self, place: int) -> str:
        line = self.source.count("\n", 0, place) + 1
        return f"line {line}, column {place - self.source.rfind(chr(10), 0, place)}"

    def peek(self, *values: str) -> bool:
        kind, value, _ = self.tokens[self.at]
        return kind in ("word", "mark") and value in values

    def take(self, kind: str | None = None, *values: str):
        found, value, place = self.tokens[self.at]
        if (kind and found != kind) or (values and value not in values):
            raise RuleError(f"{self.where(place)}: expected {' or '.join(values) or kind}, found {value!r}")
        self.at += 1
        return value


def _condition(r: _Reader, level: int = 0):
    """level 0: or, 1: and, 2: not and primaries."""
    if level < 2:
        word, join = (("or", Either), ("and", Both))[level]
        left = _condition(r, level + 1)
        while r.peek(word):
            r.take()
            left = join(left, _condition(r, level + 1))
        return left
    if r.peek("not"):
        r.take()
        return Neither(_condition(r, 2))
    if r.peek("("):
        r.take()
        inner = _condition(r)
        r.take("mark", ")")
        return inner
    if r.peek("true", "false"):
        return Predicate("always" if r.take() == "true" else "never", ())
    place = r.tokens[r.at][2]
    name, args = r.take("word"), []
    r.take("mark", "(")
    while not r.peek(")"):
        kind, value, at = r.tokens[r.at]
        if kind not in ("text", "number", "word"):
            raise RuleError(f"{r.where(at)}: expected an argument, found {value!r}")
        args.append(r.take())
        if not r.peek(")"):
            r.take("mark", ",")
    r.take("mark", ")")
    if name not in PREDICATES:
        raise RuleError(f"{r.where(place)}: there is no predicate {name}")
    wanted = PREDICATES[name]
    if len(args) != (wanted is not None):
        raise RuleError(f"{r.where(place)}: {name} takes {int(wanted is not None)} argument(s), not {len(args)}")
    fits = {"text": (str,), "whole": (int,), "number": (int, float), None: ()}[wanted]
    if args and not isinstance(args[0], fits):
        raise RuleError(f"{r.where(place)}: {name} takes a {wanted} argument, not {args[0]!r}")
    return Predicate(name, tuple(args))


def _value(r: _Reader, name: str):
    if name == "when":
        r.take("mark", "{")
        condition = _condition(r)
        r.take("mark", "}")
        return condition
    r.take("mark", ":")
    if name == "severity":
        return r.take("word", *SEVERITIES)
    if name == "language":
        return r.take("word", *LANGUAGES)
    if name == "tags":
        r.take("mark", "[")
        tags = []
        while not r.peek("]"):
            tags.append(str(r.take()))
            if not r.peek("]"):
                r.take("mark", ",")
        r.take("mark", "]")
        return tuple(tags)
    return r.take("text")


def parse_rules(source: str) -> list[Rule]:
    """The rules of a text, each ``rule id { field: value ... when { condition } }``; raises RuleError."""
    r, rules = _Reader(source), []
    while r.tokens[r.at][0] != "end":
        r.take("word", "rule")
        rule_id, fields = r.take("word"), {}
        r.take("mark", "{")
        while not r.peek("}"):
            place = r.tokens[r.at][2]
            name = r.take("word", *REQUIRED, *OPTIONAL)
            if name in fields:
                raise RuleError(f"{r.where(place)}: {name} is given twice")
            fields[name] = _value(r, name)
        r.take("mark", "}")
        missing = [x for x in REQUIRED if x not in fields]
        if missing:
            raise RuleError(f"rule {rule_id} lacks {', '.join(missing)}")
        rules.append(Rule(id=rule_id, condition=fields.pop("when"), **fields))
    return rules
