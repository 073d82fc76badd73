"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(column: Column) -> Column:
    """The form under which spellings of one name compare equal: trimmed (any white space) and lower-cased."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def squeeze(column: Column) -> Column:
    """White space collapsed to single blanks, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def levenshtein_similarity(left: Column, right: Column) -> Column:
    """1 - distance / longer length over lower-cased text; two empty texts are equal (1.0)."""
    a, b = F.lower(left), F.lower(right)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def tokens(column: Column) -> Column:
    """Distinct lower-cased words, split at everything that isn't a letter, digit or underscore."""
    return F.array_distinct(F.filter(F.split(F.lower(column), r"\W+"), lambda t: t != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; two empty ones give 1.0."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def slug(column: Column) -> Column:
    """Lower-cased, with a hyphen for every run of other characters than letters and digits, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def titled(column: Column) -> Column:
    """The first letter upper-cased, the others lower-cased."""
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 2**31 - 2)))
