"""Texts cut off by field limits or transfers: a stack automaton over structure, and endings held against a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An unterminated ending is a whole one (a title, a sign-off) if it makes up this share of all unterminated endings,
#: its names and numbers aside, or if it stands as a line of its own at the head of so many other texts. Exact copies
#: of a text count once in both.
WHOLE_SHARE = 0.005
#: A source with so many unterminated texts is its own baseline for that share, besides what is usual in the corpus
#: without the source that has the form most often; the others have the corpus's.
SOURCE_LEAST = 1000
WHOLE_LINES = 2
#: An ending of fewer words than this is never taken for a sign-off.
WHOLE_WORDS = 2
#: Rows with one ending, or none, are spread over so many tasks where they meet the usual endings.
SALTS, SPREAD = 16, 4096
#: A length is a source's field limit if this share of its texts has it.
LIMIT_SHARE = 0.02

#: Signs of omission at the end of a text. The first group says that more follows, whatever stands before it.
_MORE = r"\s*(?:\[(?:\.{3}|…|more|cut|snip|truncated|continued)\]|\((?:\.{3}|…|more|cut|snip|truncated|continued|cont\.)\)|<(?:more|cut|truncated)>)\s*$"
_DOTS = r"\s*(?:\.{3,}|…)\s*$"
#: A sentence's end: a terminator and what may close after it.
_END = r"[.!?。！？]\s*[\"”»’'\)\]\*_`]*$"


#: One step of the automaton over a text that isn't JSON: a fence at the head of a line, a comment, an emoticon, a tag, one
#: that the text's end cuts off, a paragraph's end, an opener or closer.
_STEP = (
    r"(?m)^[ \t]*(?P<fence>```)|(?P<skip>//[^\n]*|[:;=]-?[()\[\]{}]|\\.|</?[A-Za-z][^<>]*>)|(?P<tag><[A-Za-z/][^<>]*\Z)"
    r"|(?P<gap>\n[ \t]*\n)|(?P<mark>[()\[\]{}\"“”«»„])"
)
_CLOSES = {")": "(", "]": "[", "}": "{", "»": "«"}
_KIND = {"(": "bracket", "[": "bracket", "{": "brace", '"': "quote", "“": "quote", "«": "quote", "```": "fence"}


def open_structure(text: str) -> str | None:
    """What the text leaves open at its end, by a stack automaton: 'json', 'fence', 'brace', 'bracket', 'tag', 'quote' or None.

    A text that begins as a JSON object or array is read as JSON: strings with their escapes, braces and brackets, each
    closed by its own kind. Any other text is read whole for code fences, braces, brackets, double quotes and markup. A
    closer takes its opener off the stack with all that was opened since; one without an opener counts for nothing.
    Inside straight quotes nothing else counts; quotes end with their paragraph. A fence ends what was opened in it.
    """
    import re

    body = text.strip()
    if re.match(r"[\[{]\s*(?:\"|\{|\[|\}|\])", body):
        stack, string, end = [], False, 0
        for m in re.finditer(r"\\.|\\$|[\"{}\[\]]", body, re.S):
            c = m.group()
            if c[0] == "\\":
                if string and len(c) == 1:
                    return "json"
            elif c == '"':
                string = not string
            elif not string:
                if c in "{[":
                    stack.append(c)
                elif stack and stack[-1] == _CLOSES[c]:
                    stack.pop()
                if not stack:
                    end = m.end()
                    break
        if string or stack:
            return "json"
        body = body[end:]
        if not body.strip():
            return None
    stack: list[str] = []
    held = dict.fromkeys(_KIND, 0)  # how many of each are on the stack: a closer without an opener costs nothing

    def drop(opener: str) -> None:
        while held[opener]:
            top = stack.pop()
            held[top] -= 1
            if top == opener:
                return

    for m in re.finditer(_STEP, body):
        kind, c = m.lastgroup, m.group(m.lastgroup)
        if kind == "fence":
            if held["```"]:
                drop("```")
            else:
                stack.append("```")
                held["```"] += 1
        elif kind == "tag":
            return "tag"
        elif kind == "gap":
            while stack and _KIND[stack[-1]] == "quote":
                held[stack.pop()] -= 1
        elif kind == "mark":
            if c == '"' and held['"']:
                drop('"')
            elif held['"'] or (c == '"' and body[m.start() - 1 : m.start()].isdigit()):
                continue  # the latter is an inch mark
            elif c == "”" or (c == "“" and held["“"]):
                drop("“")
            elif c in _CLOSES:
                drop(_CLOSES[c])
            else:
                stack.append("“" if c == "„" else c)
                held[stack[-1]] += 1
    return _KIND[stack[0]] if stack else None


def ending(text: str) -> tuple[str, str | None]:
    """How a text ends: (verdict, tail). Verdict: 'whole', 'cut', or 'tail' where the baseline must judge the tail.

    'cut' needs no baseline: an open structure, a broken character or escape, or a sign that more follows. 'tail' is an
    ending without terminator, or with dots after what isn't a finished sentence; the tail is what follows the last
    finished sentence or line break, without the dots.
    """
    import re

    body = text.rstrip()
    if not body.strip():
        return "whole", None
    more = re.search(_MORE, body, re.I)
    if more:
        return "cut", None
    dots = re.search(_DOTS, body)
    rest = body[: dots.start()].rstrip() if dots else body
    if re.search(r"(?:�|[\ud800-\udfff]|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&#?\w{1,8})$", rest):
        return "cut", None
    if open_structure(rest) is not None:
        return "cut", None
    if rest.endswith(("}", "```")) or (rest.endswith("]") and rest.lstrip()[:1] == "["):
        return "whole", None
    if re.search(_END, rest):
        return "whole", None
    return "tail", re.split(r"\n+|(?<=[.!?。！？])[\"”»’')\]]*\s+", rest)[-1].strip()


def head(text: str) -> str | None:
    """The first line of a text of several lines, if it ends without terminator: what a title looks like."""
    import re

    first, broken, _ = text.partition("\n")
    return first if broken and first.strip() and not re.search(_END, first.rstrip()) else None


def form(tail: Column) -> Column:
    """A tail or line with its names and numbers aside, so that endings of one kind compare equal."""
    named = F.regexp_replace(tail, "(?<![A-Za-z])[A-Z][a-z]+(?:[A-Z][a-z]*)+(?![A-Za-z])", "N")
    return F.lower(F.trim(F.regexp_replace(named, "[0-9]+", "#")))


def _endings(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        verdicts = [ending(t) for t in pdf["text"].tolist()]
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "source": pdf["source"],
                "copy": pdf["copy"],
                "chars": [len(t) for t in pdf["text"]],
                "verdict": [v for v, _ in verdicts],
                "tail": [t for _, t in verdicts],
                "head": [head(t) for t in pdf["text"].tolist()],
            }
        )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every text with a verdict: doc_id, source, chars, truncated (boolean), reason ('structure', 'ending' or NULL).

    Texts are read whole. A text is cut off if its structure stays open at its end, if it ends in a broken character or
    escape or in a sign that more follows, or if its last sentence or line has no terminator and isn't one of the
    usual whole endings (titles, sign-offs, trailing-off sentences). Those are endings whose form makes up
    ``WHOLE_SHARE`` of the unterminated ones of its source (of all, if the source has fewer than ``SOURCE_LEAST``), or of
    all without the source that has the form most often, or that other texts, of any source, have as a line of their own.
    Exact copies count as one text there, so that a cut text doesn't become usual by being copied.

    NULL texts are left out; empty ones are whole. Repeated keys are judged row by row.

    The texts are read and parsed once: what is kept of each is shuffled by key, and every reader, the baseline's and
    the verdicts', takes it from there.
    """
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).withColumn("copy", F.xxhash64("text"))
    ends = rows.mapInPandas(
        _endings, f"doc_id {kinds[key]}, source {kinds[source]}, copy long, chars long, verdict string, tail string, head string"
    )
    # What is kept of a text travels in one array, of which no reader can prune anything; and where only some groups
    # count, whole groups are left out, as a filter on rows would be pushed below the shuffle. Either would make it
    # another shuffle for each reader, and parse the texts anew.
    kept = ["source", "verdict", "copy", "chars", form(F.col("tail")), form(F.col("head"))]
    ends = ends.select("doc_id", F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in kept]).alias("kept")).repartition("doc_id")
    held = lambda n: F.coalesce(F.col("kept")[n], F.lit(""))
    ends = ends.select(
        "doc_id", F.col("kept")[0].cast(kinds[source]).alias("source"), held(1).alias("verdict"), held(2).cast("long").alias("copy"),
        held(3).cast("long").alias("chars"), held(4).alias("form"), held(5).alias("head"),
    )

    def copies(name: str) -> DataFrame:
        """Different texts by source and ``name``: one row for each; those without are left out."""
        one = ends.groupBy("source", name, "copy").agg(F.max(F.length(name)).alias("length"))
        return one.where(F.col("length") > 0).select("source", name, "copy")

    cells = copies("form")
    own = cells.groupBy("source", "form").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("form", r"\s+"))).alias("words"))
    sources = own.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("all"))
    owned = own.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    most = owned.groupBy("form").agg(F.max(F.struct("n", "all")).alias("most"))
    everywhere = cells.groupBy("form").agg(F.count_distinct("copy").alias("n_everywhere")).join(most, "form")
    # One row, whatever the corpus holds.
    total = everywhere.agg(F.sum("n_everywhere").alias("all_everywhere"))
    kept = owned.join(everywhere, "form").join(F.broadcast(total))
    enough = lambda n, of: n >= F.greatest(of * WHOLE_SHARE, F.lit(2))
    elsewhere = enough(F.col("n_everywhere") - F.col("most.n"), F.col("all_everywhere") - F.col("most.all"))
    by_source = enough(F.col("n"), F.col("all")) | elsewhere
    usual = kept.where(F.when(F.col("all") >= SOURCE_LEAST, by_source).otherwise(enough(F.col("n_everywhere"), F.col("all_everywhere"))))
    usual = usual.where(F.col("words") >= WHOLE_WORDS).select("source", "form")
    heads = copies("head").groupBy("head").agg(F.count_distinct("copy").alias("n"))
    heads = heads.where(F.col("n") >= WHOLE_LINES).select(F.col("head").alias("form"))
    titles = own.select("source", "form").join(heads, "form", "left_semi").select("source", "form")
    whole = usual.unionByName(titles).distinct().select(F.col("source").alias("s"), F.col("form").alias("known"))
    # Endings meet the usual ones under a salt, and rows without one under many: neither fills one task.
    whole = whole.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tail = F.col("verdict") == "tail"
    asked = F.when(tail, F.col("form")).otherwise(F.concat(F.lit("\n"), F.pmod("copy", F.lit(SPREAD)).cast("string")))
    salted = ends.withColumns({"__asked": asked, "__own": F.pmod("copy", F.lit(SALTS)).cast("int")})
    meet = (F.col("__asked") == F.col("known")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("__own") == F.col("__salt"))
    placed = salted.join(whole, meet, "left")
    ended = (F.col("verdict") == "cut") | (tail & F.col("known").isNull())
    reason = F.when(ended, F.when(F.col("verdict") == "cut", F.lit("structure")).otherwise(F.lit("ending")))
    return placed.select("doc_id", "source", "chars", ended.alias("truncated"), reason.alias("reason"))


def truncation_rates(verdicts: DataFrame) -> DataFrame:
    """For each source: texts, truncated, share, and its field limit (the one length many of its cut texts have, else NULL)."""
    by_length = verdicts.where("truncated").groupBy("source", "chars").agg(F.count(F.lit(1)).alias("n"))
    limits = by_length.groupBy("source").agg(F.max_by("chars", F.struct("n", "chars")).alias("limit_chars"), F.max("n").alias("at_limit"))
    totals = verdicts.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated")
    )
    both = totals.join(limits.select(F.col("source").alias("s"), "limit_chars", "at_limit"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    limit = F.when(F.col("at_limit") >= F.greatest(F.col("texts") * LIMIT_SHARE, F.lit(2)), F.col("limit_chars"))
    return both.select("source", "texts", "truncated", (F.col("truncated") / F.col("texts")).alias("share"), limit.alias("limit_chars"))
