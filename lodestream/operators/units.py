"""Quantities recorded in different units: a conversion graph, its composed table, and the unit a record shows."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values: (unit, other unit, a, b) with other = a * unit + b. Powers of ten of the two ledgers' units.
CONVERSIONS: list[tuple[str, str, int, int]] = [
    ("kwei", "wei", 1000, 0),
    ("mwei", "kwei", 1000, 0),
    ("gwei", "mwei", 1000, 0),
    ("gwei", "wei", 10**9, 0),
    ("szabo", "gwei", 1000, 0),
    ("finney", "szabo", 1000, 0),
    ("ether", "finney", 1000, 0),
    ("ether", "wei", 10**18, 0),
    ("kether", "ether", 1000, 0),
    ("xlm", "stroop", 10**7, 0),
    ("millilumen", "stroop", 10**4, 0),
    ("xlm", "millilumen", 1000, 0),
]

#: Spellings (lower-cased) of the units above.
SPELLINGS: dict[str, list[str]] = {
    "wei": ["wei", "weis"],
    "kwei": ["kwei", "babbage", "femtoether"],
    "mwei": ["mwei", "lovelace", "picoether"],
    "gwei": ["gwei", "gweis", "shannon", "nanoether", "nanoeth", "neth"],
    "szabo": ["szabo", "microether", "microeth", "ueth", "µeth", "μeth"],
    "finney": ["finney", "milliether", "millieth", "meth"],
    "ether": ["ether", "ethers", "eth", "éther"],
    "kether": ["kether", "grand"],
    "stroop": ["stroop", "stroops"],
    "millilumen": ["millilumen", "millilumens", "mxlm"],
    "xlm": ["xlm", "lumen", "lumens"],
}

#: The canonical unit of each family of accounts.
CANONICAL = {"evm": "wei", "stellar": "stroop"}


class ConversionError(ValueError):
    """The conversions contradict each other along a cycle."""


def compose(edges: list[tuple[str, str, Fraction | int, Fraction | int]], target: str) -> dict[str, tuple[Fraction, Fraction]]:
    """For every unit that reaches ``target``: (a, b) with target = a * unit + b, along a path of fewest edges.

    Every edge is usable both ways. Each edge that closes a cycle is checked against the composed functions; a
    contradiction raises :class:`ConversionError` naming it. Units of other components are left out.
    """
    neighbours: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for left, right, a, b in edges:
        a, b = Fraction(a), Fraction(b)
        if a == 0:
            raise ConversionError(f"{left} to {right} can't be undone: factor 0")
        # Stored at the end nearer to the target: from `unit`, one step leads to `other` by other = a * unit + b.
        neighbours.setdefault(right, []).append((left, a, b))
        neighbours.setdefault(left, []).append((right, 1 / a, -b / a))
    found = {target: (Fraction(1), Fraction(0))}
    queue = deque([target])
    while queue:
        unit = queue.popleft()
        a0, b0 = found[unit]
        for other, a, b in neighbours.get(unit, []):
            if other not in found:
                found[other] = (a0 * a, a0 * b + b0)
                queue.append(other)
    for left, right, a, b in edges:
        if right in found:
            a0, b0 = found[right]
            if found[left] != (a0 * Fraction(a), a0 * Fraction(b) + b0):
                raise ConversionError(f"{left} to {right} contradicts the path through the other units")
    return found


def conversion_rows(
    edges: list[tuple[str, str, int, int]] | None = None,
    spellings: dict[str, list[str]] | None = None,
    canonical: dict[str, str] | None = None,
) -> list[tuple[str, str, str, str, str]]:
    """(spelling, unit, family, factor, offset) for every spelling of a unit that reaches a family's canonical one; exact fractions as text."""
    edges, spellings, canonical = edges or CONVERSIONS, spellings or SPELLINGS, canonical or CANONICAL
    rows = []
    for family, target in canonical.items():
        for unit, (a, b) in sorted(compose(edges, target).items()):
            rows += [(name, unit, family, str(a), str(b)) for name in spellings.get(unit, [unit])]
    return rows


def _power(factor: Fraction) -> int | None:
    """n where factor = 10^n, else None."""
    n = 0
    while factor >= 10 and factor.denominator == 1 and factor.numerator % 10 == 0:
        factor, n = factor / 10, n + 1
    while factor < 1 and factor.numerator == 1 and factor.denominator % 10 == 0:
        factor, n = factor * 10, n - 1
    return n if factor == 1 else None


def conversion_table(spark: SparkSession, edges=None, spellings=None, canonical=None) -> DataFrame:
    """The composed conversions as a table: spelling, unit, family, factor, offset (double), exp10 (NULL if no power).

    Its rows are those of the given lists (here under 50), whatever the data's size, so it may be broadcast.
    """
    rows = [
        (name, unit, family, float(Fraction(a)), float(Fraction(b)), _power(Fraction(a)) if b == "0" else None)
        for name, unit, family, a, b in conversion_rows(edges, spellings, canonical)
    ]
    return spark.createDataFrame(rows, "spelling string, unit string, family string, factor double, offset double, exp10 int")


def convert(
    df: DataFrame, value: str, unit: str, family: str, conversions: DataFrame, out: str = "canonical", power: str | None = None
) -> DataFrame:
    """Add ``out``: ``value`` (number) in the canonical unit of the row's ``family``, by equi-join on unit and family.

    Units compare trimmed and lower-cased. An unknown or NULL unit, family or value gives NULL. No row is lost or
    repeated; a clash of ``out`` with a column of ``df`` replaces that column. ``power``, if given, names a column for
    the conversion's power of ten.
    """
    table = F.broadcast(
        conversions.select(
            F.col("spelling").alias("__u"), F.col("family").alias("__f"), F.col("factor").alias("__a"), F.col("offset").alias("__b"),
            F.col("exp10").alias("__p"),
        )
    )
    left = df.withColumn("__lu", F.lower(F.trim(F.col(f"`{unit}`"))))
    joined = left.join(table, (F.col("__lu") == F.col("__u")) & (F.col(f"`{family}`") == F.col("__f")), "left")
    joined = joined.withColumn(out, F.col(f"`{value}`").cast("double") * F.col("__a") + F.col("__b"))
    if power:
        joined = joined.withColumn(power, F.col("__p"))
    return joined.drop("__lu", "__u", "__f", "__a", "__b", "__p")


def unit_of_power(family: Column, power: Column) -> Column:
    """The unit of ``family`` that is 10^``power`` canonical ones by the composed conversions, else NULL."""
    names = {(f, _power(Fraction(a))): unit for _, unit, f, a, b in conversion_rows() if b == "0"}
    pairs = [x for (f, p), unit in sorted(names.items(), key=str) if p is not None for x in (F.lit(f"{f} {p}"), F.lit(unit))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(" ", family, power.cast("string")))


def unit_by_ratio(family: Column, ratio: Column, tolerance: float = 0.01) -> Column:
    """The unit whose factor is ``ratio`` (true over recorded number), within ``tolerance`` of its logarithm; else NULL."""
    log = F.when(ratio > 0, F.log10(ratio))
    return F.when(F.abs(log - F.round(log)) < tolerance, unit_of_power(family, F.round(log).cast("int")))


def family_of(wallet: Column) -> Column:
    """'evm' for wallets 0x..., 'stellar' for G..., else NULL; compared trimmed and lower-cased."""
    key = F.lower(F.trim(wallet))
    return F.when(key.startswith("0x"), F.lit("evm")).when(key.startswith("g"), F.lit("stellar"))


_NAMES = sorted({name for names in SPELLINGS.values() for name in names}, key=lambda n: (-len(n), n))
_UNIT = "(?:" + "|".join(_NAMES) + ")"
_NUMBER = "[0-9](?:[0-9.,_' \u00a0\u202f\u2009]*[0-9])?(?:e[-+]?[0-9]+)?"
#: Words before or after a figure that make it the figure of another thing than the amount.
_OTHER_BEFORE = r"(?:gas price|tip|tip was|base fee|priority fee|held|reserve|reserve of|balance|balance of|deposit of|limit of|cap of|rent of)\s*(?:of|was|is|:)?\s*$"
_OTHER_AFTER = r"^\s*(?:per\b|before\b|at inclusion|untouched|left\b|remaining\b|each\b)"
_MENTION = rf"(?i)(?<![\p{{L}}\p{{N}}])({_NUMBER})\s*({_UNIT})(?![\p{{L}}\p{{N}}])"
_NAMED = rf"(?i)(?<![\p{{L}}\p{{N}}])(?<![0-9]\s)({_UNIT})(?![\p{{L}}\p{{N}}])"


#: Words of languages that write a decimal comma.
_COMMA_WORDS = r"(?i)\b(?:entspricht|betrag|wert|stapel|auftrag|insgesamt|macht|montant|soit|vaut|équivaut|lote|importe|equivale|vale|total de)\b"


def _readings(figure: Column, by_comma: Column) -> list[Column]:
    """The numbers a figure may stand for: with decimal point, with decimal comma, or its last group alone.

    Group marks must stand between groups of three. A figure that fits either way is read as its language writes it.
    """
    point = F.when(
        figure.rlike(r"^(?:[1-9][0-9]{0,2}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?$"),
        F.regexp_replace(figure, ",", "").try_cast("double"),
    )
    comma = F.when(
        figure.rlike(r"^(?:[1-9][0-9]{0,2}(?:\.[0-9]{3})+|[0-9]+)(?:,[0-9]+)?(?:e[-+]?[0-9]+)?$"),
        F.translate(figure, ",.", ".").try_cast("double"),
    )
    return [F.when(by_comma, comma).otherwise(point), F.when(by_comma, point).otherwise(comma)]


def with_shown_unit(df: DataFrame, text: str, amount: str, family: str, out: str) -> DataFrame:
    """Add ``out``: the unit that ``text`` shows the recorded ``amount`` to be in; NULL where it shows none.

    A unit without a figure names the amount's unit. A figure with a unit is the amount itself or its worth: it counts
    if it is the amount times a power of ten, which makes the amount's unit the one so far from the canonical one.
    Figures of other things (gas price, tip, balance, reserve, fee per operation) don't count. NULL and empty texts show
    nothing; texts of any length are read whole. The steps are separate projections, so that no pattern is matched twice.
    """
    parts = df.withColumn("__m", F.regexp_extract(F.col(text), _MENTION, 0))
    parts = parts.withColumn("__lone", F.when(F.col("__m") == "", F.lower(F.regexp_extract(F.col(text), _NAMED, 1))))
    parts = parts.withColumn("__at", F.when(F.col("__m") != "", F.expr(f"locate(__m, {text})")))
    parts = parts.withColumn(
        "__other",
        F.expr(f"substring({text}, 1, __at - 1)").rlike("(?i)" + _OTHER_BEFORE)
        | F.expr(f"substring({text}, __at + length(__m))").rlike("(?i)" + _OTHER_AFTER),
    )
    mark = F.lower(F.regexp_extract(F.col("__m"), rf"(?i)({_UNIT})$", 1))
    figure = F.regexp_replace(F.regexp_extract(F.lower("__m"), f"^{_NUMBER}", 0), "[_' \u00a0\u202f\u2009]", "")
    written = F.when(F.col("__m") == "", F.col("__lone")).when(~F.col("__other"), mark)
    known = {(name, f): (unit, _power(Fraction(a))) for name, unit, f, a, b in conversion_rows() if b == "0"}
    spelt = F.create_map(*[x for (name, f), (unit, p) in known.items() if p is not None and p >= 0 for x in (F.lit(f"{name} {f}"), F.struct(F.lit(unit).alias("unit"), F.lit(p).alias("power")))])
    parts = parts.withColumn("__unit", F.try_element_at(spelt, F.concat_ws(" ", written, F.col(family))))
    parts = parts.withColumn("__figure", F.when(F.col("__m") != "", figure))
    first, second = _readings(F.col("__figure"), F.col(text).rlike(_COMMA_WORDS))
    parts = parts.withColumn("__r", F.array(first, second))
    value = F.col(amount).cast("double")
    # log10(figure * 10^power / amount): the power of the amount's own unit, if the figure is the amount's.
    logs = F.transform("__r", lambda x: F.when((x > 0) & (value > 0), F.log10(x) + F.col("__unit.power") - F.log10(value)))
    parts = parts.withColumn("__logs", logs)
    units = F.transform("__logs", lambda x: F.when(F.abs(x - F.round(x)) < 1e-9, unit_of_power(F.col(family), F.round(x).cast("int"))))
    by_figure = F.get(F.filter(units, lambda u: u.isNotNull()), F.lit(0))
    shown = F.when(F.col("__m") == "", F.col("__unit.unit")).otherwise(by_figure)
    return parts.withColumn(out, shown).drop("__m", "__lone", "__at", "__other", "__unit", "__figure", "__r", "__logs")


#: Shown units are counted by hour before a source's history is cut into segments.
HOUR_US = 3_600_000_000


def _segments(hours, units, counts):
    """Cut one source's history where its mix of units changes: (first hour, last hour, commonest unit) of each part.

    Binary segmentation by multinomial likelihood; a cut must gain more than it costs in parameters (BIC, three times).
    """
    import numpy as np

    levels, column = np.unique(units, return_inverse=True)
    stamps, row = np.unique(hours, return_inverse=True)
    table = np.zeros((len(stamps) + 1, len(levels)))
    np.add.at(table, (row + 1, column), counts)
    total = table.cumsum(axis=0)

    def likelihood(x):
        n = x.sum(axis=-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / n), 0.0).sum(axis=-1)

    parts, open_parts = [], [(0, len(stamps))]
    while open_parts:
        i, j = open_parts.pop()
        whole = total[j] - total[i]
        if j - i > 1 and (whole > 0).sum() > 1:
            cuts = np.arange(i + 1, j)
            gain = likelihood(total[cuts] - total[i]) + likelihood(total[j] - total[cuts]) - likelihood(whole)
            best = int(np.argmax(gain))
            if gain[best] > 3.0 * 0.5 * len(levels) * np.log(max(whole.sum(), 2.0)):
                open_parts += [(i, i + 1 + best), (i + 1 + best, j)]
                continue
        parts.append((int(stamps[i]), int(stamps[j - 1]), str(levels[int(np.argmax(whole))])))
    return sorted(parts)


def usual_units(shown: DataFrame, source: str, family: str, time: str, unit: str) -> DataFrame:
    """Which unit each source usually records in, over time: source, family, from_us, to_us, unit.

    ``shown`` holds the records that show their unit. They are first counted by source, family, hour and unit; one
    task then sees only a source's counts, of which there are as many as hours with records. Between two segments the
    border lies half-way. Rows with a NULL source, family, time or unit are ignored.
    """
    rows = shown.select(
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{family}`").alias("family"),
        F.floor(F.unix_micros(F.col(f"`{time}`").cast("timestamp")) / HOUR_US).alias("hour"),
        F.col(f"`{unit}`").alias("unit"),
    ).dropna()
    return _cut(rows.groupBy("source", "family", "hour", "unit").agg(F.count(F.lit(1)).alias("n")))


def _cut(counts: DataFrame) -> DataFrame:
    """:func:`usual_units` from its counts: source, family, hour, unit, n."""

    def cut(pdf):
        import pandas as pd

        parts = _segments(pdf["hour"].to_numpy(), pdf["unit"].to_numpy(dtype=str), pdf["n"].to_numpy())
        out = []
        for k, (first, last, unit) in enumerate(parts):
            start = None if k == 0 else (parts[k - 1][1] + first + 1) * HOUR_US // 2
            stop = None if k == len(parts) - 1 else (last + parts[k + 1][0] + 1) * HOUR_US // 2
            out.append((pdf["source"].iloc[0], pdf["family"].iloc[0], start, stop, unit))
        frame = pd.DataFrame(out, columns=["source", "family", "from_us", "to_us", "unit"])
        return frame.astype({"from_us": "Int64", "to_us": "Int64"})

    return counts.groupBy("source", "family").applyInPandas(
        cut, "source string, family string, from_us long, to_us long, unit string"
    )


#: A source's records are spread over so many tasks where they meet its usual units.
SALTS = 16


def with_usual(records: DataFrame, usual: DataFrame, shown: str, out: str) -> DataFrame:
    """Add ``out``: the unit a record shows itself, else that usual for its source, family and time, else NULL.

    ``records`` has the columns source, family, at_us and ``shown``. A record that shows its unit, or has no source,
    meets nothing: its key is NULL but for a salt of its own, so that neither those nor a hot source fill one task.
    """
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    u = usual.select(
        F.col("source").alias("__s"), F.col("family").alias("__f"), F.col("from_us").alias("__from"), F.col("to_us").alias("__to"),
        F.col("unit").alias("__p"), F.explode(salts).alias("__k"),
    )
    spread = F.xxhash64("source", "family", "at_us", shown, *[c for c in ("id", "amount") if c in records.columns])
    need = F.when(F.col(shown).isNull(), F.col("source"))
    salt = F.when(need.isNotNull(), F.pmod(spread, F.lit(SALTS))).otherwise(spread)
    keyed = records.withColumns({"__need": need, "__salt": salt})
    found = keyed.join(
        u,
        (F.col("__need") == F.col("__s"))
        & (F.col("family") == F.col("__f"))
        & (F.col("__salt") == F.col("__k"))
        & (F.col("__from").isNull() | (F.col("at_us") >= F.col("__from")))
        & (F.col("__to").isNull() | (F.col("at_us") < F.col("__to"))),
        "left",
    ).withColumn(out, F.coalesce(F.col(shown), F.col("__p")))
    return found.drop("__need", "__salt", "__s", "__f", "__from", "__to", "__p", "__k")


def canonical_chain(chain: Column) -> Column:
    """One spelling of a chain id: '1' for 1, ' 0x1', 'eip155:1'; 'stellar:pubnet' for stellar-pubnet; NULL if empty."""
    key = F.regexp_replace(F.lower(F.trim(chain)), r"^eip155[:-]", "")
    key = F.when(key.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(key, 3, 20), 16, 10)).otherwise(key)
    key = F.regexp_replace(key, r"^stellar[-_ ]", "stellar:")
    return F.when(key != "", key)


def cap_units(caps: DataFrame) -> DataFrame:
    """Caps as records: record_table, id, source, family, at_us, amount, shown.

    A cap with usage shows its unit: usage (always canonical) over its percentage is the cap itself.
    """
    amount, used = F.col("maxSubsidyAmount").cast("double"), F.col("currentUsage").cast("double")
    family = family_of(F.col("walletAddress"))
    true = F.when((amount > 0) & (used > 0) & (F.col("usagePercentage") > 0), used * 100 / F.col("usagePercentage").cast("double"))
    return caps.select(
        F.lit("gas_subsidy_caps").alias("record_table"), F.col("id"), F.lower(F.trim("relayerId")).alias("source"),
        family.alias("family"), F.unix_micros(F.col("createdAt").cast("timestamp")).alias("at_us"),
        amount.alias("amount"), unit_by_ratio(family, true / amount).alias("shown"),
    )


def usage_units(logs: DataFrame) -> DataFrame:
    """Usage logs as records, as in :func:`cap_units`; a log shows its unit in its text."""
    chain = canonical_chain(F.col("chainId"))
    family = F.coalesce(
        family_of(F.col("walletAddress")),
        F.when(chain.startswith("stellar"), F.lit("stellar")).when(chain.isNotNull(), F.lit("evm")),
    )
    base = logs.select(
        F.col("id"), chain.alias("source"), family.alias("family"),
        F.unix_micros(F.coalesce("timestamp", "createdAt").cast("timestamp")).alias("at_us"),
        F.col("amount").cast("double").alias("amount"), F.col("description").alias("text"),
    )
    shown = with_shown_unit(base, "text", "amount", "family", "shown")
    return shown.select(
        F.lit("gas_subsidy_usage_logs").alias("record_table"), "id", "source", "family", "at_us", "amount", "shown"
    )


def estimate_units(estimates: DataFrame) -> DataFrame:
    """Estimates as records, as in :func:`cap_units`; units and price show a total's unit, else its lumens do."""
    total, xlm = F.col("totalEstimatedCostStroops"), F.col("totalEstimatedCostXLM")
    price = F.coalesce("dynamicGasPrice", F.col("baseGasPrice") * F.col("surgeMultiplier"))
    lumen = float(compose(CONVERSIONS, "stroop")["xlm"][0])
    family, some = F.lit("stellar"), F.when(total > 0, total)
    shown = [unit_by_ratio(family, true / some) for true in (F.col("estimatedGasUnits") * price, xlm * lumen, xlm)]
    return estimates.select(
        F.lit("dynamic_gas_estimates").alias("record_table"), F.col("estimateId").alias("id"),
        F.lower(F.trim("chainId")).alias("source"), family.alias("family"),
        F.unix_micros(F.col("expiresAt").cast("timestamp")).alias("at_us"), total.alias("amount"), F.coalesce(*shown).alias("shown"),
    )


def canonical_amounts(records: DataFrame, conversions: DataFrame) -> DataFrame:
    """Each record's amount in wei or stroops: record_table, id, family, unit, exp10, amount, canonical_amount.

    ``records`` as from the three functions above. The unit is the record's own, or its source's usual one at that time,
    or the family's canonical one; :func:`convert` joins it with ``conversions``. A key counts once; a NULL amount stays
    NULL; a record whose family isn't known keeps its amount as it is, with exp10 0.

    The tables are read and the texts matched once: both readers of the records, the counts of usual units and the
    result, take them from one shuffle by key, for which both ask for all columns.
    """
    source = F.when(F.col("source").isNotNull(), F.concat_ws("|", "record_table", "source"))
    keyed = records.withColumn("source", source)
    latest = Window.partitionBy("record_table", "id").orderBy("at_us", "amount", "shown", "source", "family")
    once = keyed.withColumn("__k", F.row_number().over(latest)).where("__k = 1").drop("__k")
    hour = F.floor(F.col("at_us") / HOUR_US).alias("hour")
    counts = once.where(F.col("shown").isNotNull() & F.col("source").isNotNull() & F.col("family").isNotNull() & hour.isNotNull())
    counts = counts.groupBy("source", "family", hour, F.col("shown").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    known = with_usual(once, _cut(counts), "shown", "unit")
    canonical = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    known = known.withColumn("unit", F.coalesce("unit", F.try_element_at(canonical, F.col("family"))))
    converted = convert(known, "amount", "unit", "family", conversions, "canonical_amount", "exp10")
    return converted.select(
        "record_table", "id", "family", "unit", F.coalesce("exp10", F.lit(0)).alias("exp10"), "amount",
        F.coalesce("canonical_amount", "amount").alias("canonical_amount"),
    )
