"""Network addresses, normalised without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "no address".
PLACEHOLDERS = ["", "-", "--", "unknown", "null", "none", "nil", "n/a", "na", "undefined", "0.0.0.0", "::"]

_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def bare_ip(address: Column) -> Column:
    """The first address of a forwarded list, lower-cased, without quotes, brackets, port, zone id, prefix length or IPv4 mapping."""
    first = F.lower(F.trim(F.split(address, ",", 2).getItem(0)))
    first = F.regexp_replace(first, r"^for=|\"", "")
    bare = F.regexp_replace(first, r"^\[([^\]]*)\](?::\d+)?$", "$1")
    bare = F.regexp_replace(bare, r"(?:%[^/]*)?(?:/\d+)?$", "")
    bare = F.regexp_replace(bare, r"^(\d{1,3}(?:\.\d{1,3}){3}):\d+$", "$1")
    return F.regexp_replace(bare, r"^(?:(?:0{1,4}:){5}|::)ffff:(\d{1,3}(?:\.\d{1,3}){3})$", "$1")


def with_canonical_ip(df: DataFrame, address: str, out: str) -> DataFrame:
    """Add ``out``: one spelling for each client address, NULL where there is none.

    IPv4 comes out in dotted decimals, also where it was mapped into IPv6 (dotted or hexadecimal); IPv6 as eight groups
    of four lower-case hexadecimal digits. NULL, placeholders and texts that aren't addresses give NULL. The steps are
    separate projections, so that no pattern is matched twice; a column named ``out`` is replaced.
    """
    steps = df.withColumn("__bare", bare_ip(F.col(f"`{address}`")))
    halves = F.split("__bare", "::")
    empty = F.array().cast("array<string>")
    left = F.filter(F.split(halves.getItem(0), ":"), lambda x: x != "")
    right = F.when(F.size(halves) == 2, F.filter(F.split(F.get(halves, F.lit(1)), ":"), lambda x: x != "")).otherwise(empty)
    colons = F.col("__bare").rlike(r"^[0-9a-f:]*:[0-9a-f:]*$")
    steps = steps.withColumn("__halves", F.when(colons, F.size(halves)))
    steps = steps.withColumn("__left", F.when(colons, left)).withColumn("__right", F.when(colons, right))
    missing = 8 - F.size("__left") - F.size("__right")
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    groups = F.concat("__left", zeros, "__right")
    wellformed = F.when(F.col("__halves") == 2, missing >= 1).otherwise((F.col("__halves") == 1) & (missing == 0))
    steps = steps.withColumn("__groups", F.when(wellformed, groups))
    steps = steps.withColumn(
        "__v6",
        F.when(
            F.forall("__groups", lambda g: F.length(g) <= 4),
            F.array_join(F.transform("__groups", lambda g: F.lpad(g, 4, "0")), ":"),
        ),
    )
    octets = [F.conv(F.substring("__v6", i, 2), 16, 10) for i in (31, 33, 36, 38)]
    v6 = F.when(F.col("__v6").startswith("0000:0000:0000:0000:0000:ffff:"), F.concat_ws(".", *octets)).otherwise(F.col("__v6"))
    plain = F.transform(F.split("__bare", r"\."), lambda x: x.cast("int").cast("string"))
    v4 = F.when(F.col("__bare").rlike(_V4), F.array_join(plain, "."))
    real = F.col("__bare").isNotNull() & ~F.col("__bare").isin(*PLACEHOLDERS)
    return steps.withColumn(out, F.when(real, F.coalesce(v4, v6))).drop(
        "__bare", "__halves", "__left", "__right", "__groups", "__v6"
    )
