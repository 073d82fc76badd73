"""Implausible readings: impossible values, spikes (rolling median and MAD) and stuck runs, per source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import chunk_counts, with_places, without_repeats

#: Rows on either side of a reading in its rolling window.
HALF = 25
#: Readings of one source and measure that one group holds, beside the 2 * HALF of its neighbours.
BLOCK = 50_000
#: A reading is a spike if it is more than this many scales from its rolling median (see `flag_implausible`).
MADS = 3.0
#: The scale's bounds, as shares of the width of the source's ordinary range.
LEAST, MOST = 1 / 6, 1 / 3
#: A source is sorted day by day, each day in its own task.
CHUNK_US = 86_400_000_000
#: Width, in decades, of the bins in which the ordinary range of a source of more than one block is sought.
BIN = 0.0005


def _middle(windows):
    """The median of each row, NaN aside; NaN for a row of nothing else."""
    import numpy as np

    held = np.sort(windows, axis=1)  # NaN comes last
    n = windows.shape[1] - np.isnan(windows).sum(axis=1)
    row = np.arange(len(held))
    return np.where(n > 0, (held[row, np.maximum(n - 1, 0) // 2] + held[row, np.minimum(n // 2, windows.shape[1] - 1)]) / 2, np.nan)


def _rolling(values, half: int):
    """Median and MAD of each position's window of 2 * half + 1 (fewer at the ends), both as float arrays."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    n = len(values)
    windows = sliding_window_view(np.concatenate([np.full(half, np.nan), values, np.full(half, np.nan)]), 2 * half + 1)
    median, mad = np.empty(n), np.empty(n)
    step = max(1, 2_000_000 // (2 * half + 1))  # rows of the window matrix held at once
    for i in range(0, n, step):
        part = windows[i : i + step]
        median[i : i + step] = _middle(part)
        mad[i : i + step] = _middle(np.abs(part - median[i : i + step, None]))
    return median, mad


def _run_lengths(values):
    """For each position, the length of the run of equal values it lies in."""
    import numpy as np

    if not len(values):
        return np.zeros(0, dtype="int64")
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(values)]]))
    return np.repeat(lengths, lengths)


def _ordinary(logs):
    """The span of the readings within one inter-decile width of the deciles, of a whole source: (low, high)."""
    import numpy as np

    if not len(logs):
        return np.nan, np.nan
    held = np.sort(logs)
    first, ninth = held[-(-len(held) // 10) - 1], held[-(-len(held) * 9 // 10) - 1]
    width = ninth - first
    inside = held[(held >= first - width) & (held <= ninth + width)]
    return inside[0], inside[-1]


def _windows(names: list[str], half: int, block: int, least_rows: int, least_run: int, mads: float) -> Callable[[Iterator], Iterator]:
    """Over a partition sorted by source, block and place: the findings among a block's own rows.

    A source of one block is held against its exact range and variety, a larger one against those it comes with.
    """

    def judge(pdf, i, name, out):
        import numpy as np

        block_no, column = int(pdf["__block"].iloc[0]), lambda c: pdf[f"{c}{i}"].to_numpy()
        at = column("at_")
        rows = np.flatnonzero(~np.isnan(column("v").astype("float64")) & (at >= block_no * block - half) & (at < (block_no + 1) * block + half))
        if not len(rows):
            return
        value, possible, own = column("v")[rows].astype("float64"), column("ok")[rows].astype(bool), at[rows] // block == block_no
        run, fit = _run_lengths(value), np.flatnonzero(possible & (value > 0))
        log, gap, scale = (np.full(len(rows), np.nan) for _ in range(3))
        log[fit] = np.log10(value[fit])
        if column("all_")[rows[0]] > block:
            low, high, varied = (pdf[f"{c}{i}"].iloc[0] for c in ("low", "high", "varied"))
        else:
            (low, high), varied = _ordinary(log[fit]), len(np.unique(value)) * 2 >= len(value)
        if len(fit):
            median, mad = _rolling(log[fit], half)
            gap[fit], scale[fit] = np.abs(log[fit] - median), np.clip(mad, LEAST * (high - low), MOST * (high - low))
        with np.errstate(invalid="ignore", divide="ignore"):
            far, score = gap > mads * scale, gap / scale
            excess = np.maximum(log - high, low - log) - (high - low)
        many = pdf["all_row"].iloc[0] >= least_rows
        for reason, hit in (("impossible", ~possible), ("spike", far & many), ("stuck", (run >= least_run) & bool(varied) & many)):
            hit = np.flatnonzero(hit & own)
            if len(hit):
                spike = (score[hit], excess[hit]) if reason == "spike" else (None, None)
                out.append(pdf[["__row", "__src"]].iloc[rows[hit]].assign(measure=name, reason=reason, score=spike[0], excess=spike[1]))

    def finish(pdf):
        import numpy as np
        import pandas as pd

        keys, out = pdf[["__src", "__block"]], []
        bounds = np.append(np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()), len(pdf))
        for first, last in zip(bounds[:-1], bounds[1:]):
            for i, name in enumerate(names):
                judge(pdf.iloc[first:last], i, name, out)
        if out:
            return pd.concat([f.astype({"score": "float64", "excess": "float64"}) for f in out], ignore_index=True)

    def run(batches):
        import pandas as pd

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["__src"] == pdf["__src"].iloc[-1]) & (pdf["__block"] == pdf["__block"].iloc[-1])
            held = pdf[last]
            if (~last).any() and (done := finish(pdf[~last].reset_index(drop=True))) is not None:
                yield done
        if held is not None and len(held) and (done := finish(held.reset_index(drop=True))) is not None:
            yield done

    return run


def _large_ranges(readings: DataFrame) -> DataFrame:
    """Ordinary range and variety of sources too large for one task: __src, __measure, __varied, __low, __high.

    ``readings`` has __src, __measure, __value and __fit. Values are counted before they are shuffled, and a source's
    different values (for ``__varied``) once more by bin; only bins are ordered. A decile lies in its bin's extremes.
    """
    by = ["__src", "__measure"]
    values = readings.groupBy(*by, "__value", "__fit").agg(F.count(F.lit(1)).alias("__c"))
    log = F.when(F.col("__fit"), F.log10("__value"))
    bins = values.select(*by, "__c", log.alias("__l")).groupBy(*by, F.floor(F.col("__l") / BIN).alias("__bin")).agg(
        F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__d"), F.min("__l").alias("__lo"), F.max("__l").alias("__hi")
    )
    over = Window.partitionBy(*by)
    fits = F.when(F.col("__bin").isNotNull(), F.col("__n")).otherwise(0)
    bins = bins.select(
        *by, "__lo", "__hi", F.sum(fits).over(over.orderBy(F.col("__bin").asc_nulls_first())).alias("__upto"), F.sum(fits).over(over).alias("__fits"),
        (F.sum("__d").over(over) * 2 >= F.sum("__n").over(over)).alias("__varied"),
    )
    decile = lambda share, edge: F.min(F.when(F.col("__upto") >= F.ceil(F.col("__fits") * share / 10), F.col(edge))).over(over)
    bins = bins.select("*", decile(1, "__lo").alias("__q1"), decile(9, "__hi").alias("__q9"))
    width = F.col("__q9") - F.col("__q1")
    low, high = F.col("__q1") - width, F.col("__q9") + width
    # A bin at the edge may hold both ordinary readings and others: its extremes count only inside the reach.
    return bins.groupBy(*by).agg(
        F.bool_or("__varied").alias("__varied"),
        F.min(F.when(F.col("__lo") >= low, F.col("__lo")).when(F.col("__hi") >= low, F.col("__hi"))).alias("__low"),
        F.max(F.when(F.col("__hi") <= high, F.col("__hi")).when(F.col("__lo") <= high, F.col("__lo"))).alias("__high"),
    )


def flag_implausible(
    df: DataFrame,
    key: str,
    source: str,
    time: str,
    bounds: dict[str, Callable[[Column], Column]],
    least_rows: int = 30,
    least_run: int = 6,
    half: int = HALF,
    block: int = BLOCK,
    mads: float = MADS,
) -> DataFrame:
    """The implausible readings of each source: key, source, measure, reason, score, excess.

    ``bounds`` gives each measure's condition of physical possibility. ``reason`` is

    - 'impossible': the condition is false (in sources of any size);
    - 'spike': by a Hampel filter on a log scale. The reading is more than ``mads`` scales from the rolling median of
      2 * ``half`` + 1 readings. The scale is the window's median absolute deviation, but from ``LEAST`` to ``MOST``
      times the width of the source's ordinary range: a calm stretch doesn't make ordinary readings spikes, nor does a
      window that spans two ordinary levels hide one. ``score`` is the distance in scales. ``excess`` tells by how much
      the reading lies further outside the ordinary range than that range is wide (negative: by how much less). The
      ordinary range is the span of the readings within one inter-decile width of the deciles;
    - 'stuck': one of ``least_run`` or more successive equal readings, where a source's values rarely repeat (at least
      half are distinct, counted exactly).

    Spikes and stuck runs are sought in sources with ``least_rows`` rows or more. A repeated row (same key, source and
    time) counts once; rows with a NULL key or source are ignored, a NULL measure is no reading, and NULL times come
    first. Ties in time are ordered by key. An empty input gives an empty result.

    A source's readings are numbered day by day and cut into blocks of ``block`` with ``half`` neighbours on each side,
    so a hot source is spread over tasks and no task holds more than a block. A source of one block is judged exactly;
    the range of a larger one comes from its counted values, its deciles from bins of ``BIN`` decades (0.12 %), and
    reaches its rows with the counts of their days. Rows are shuffled twice, to their day and to their block.
    """
    names = list(bounds)
    n = len(names)
    names = list(bounds)
    n = len(names)
    rows = df.select(
        F.col(f"`{key}`").alias("__row"),
        F.col(f"`{source}`").alias("__src"),
        F.coalesce(F.unix_micros(F.col(f"`{time}`").cast("timestamp")), F.lit(-(2**62))).alias("__t"),
        *[F.col(f"`{m}`").alias(f"__m{i}") for i, m in enumerate(names)],
    ).where(F.col("__row").isNotNull() & F.col("__src").isNotNull())
    kinds = dict(rows.dtypes)
    tests = [F.coalesce(possible(F.col(f"__m{i}")), F.lit(False)) for i, possible in enumerate(bounds.values())]
    # One array for all measures, and a day that can't be NULL: no reader of the shuffle can prune or filter what goes
    # into it, which would make it another shuffle.
    held = F.array(*[F.col(f"__m{i}").cast("double") for i in range(n)], *[ok.cast("double") for ok in tests])
    day = F.coalesce(F.floor(F.col("__t") / F.lit(CHUNK_US)), F.lit(0))
    once = without_repeats(rows.select("__row", "__src", "__t", day.alias("__day"), held.alias("__held")), ["__src"], ["__t", "__row"], "__day")
    once = once.select(
        "__row", "__src", "__t", "__day", F.lit(1).alias("__one"), *[F.col("__held")[i].alias(f"v{i}") for i in range(n)],
        *[(F.col("__held")[n + i] > 0).alias(f"ok{i}") for i in range(n)],
    )
    block = max(block, half)  # a block is no shorter than the reach
    counted = {"row": "__one", **{str(i): f"v{i}" for i in range(n)}}
    days = chunk_counts(once, ["__src"], "__day", counted)

    # Ranges of sources larger than a block, over only their rows; each joins its days.
    large = days.where(F.greatest(F.lit(0), *[F.col(f"all_{i}") for i in range(n)]) > block).select("__src", "__day")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), (F.col(f"ok{i}") & (F.col(f"v{i}") > 0)).alias("f")) for i in range(n)])
    readings = once.join(large, ["__src", "__day"]).select("__src", F.explode(pieces).alias("p")).where(F.col("p.v").isNotNull())
    ranges = _large_ranges(readings.select("__src", F.col("p.i").alias("__measure"), F.col("p.v").alias("__value"), F.col("p.f").alias("__fit")))
    wide = ranges.groupBy("__src").agg(
        *[F.max(F.when(F.col("__measure") == i, F.col(f"__{c}"))).alias(f"{c}{i}") for i in range(n) for c in ("low", "high", "varied")]
    )
    placed = with_places(once, ["__src"], ["__t", "__row"], "__day", counted, days.join(wide, "__src", "left"))

    # Each reading goes to its own block and, near a border, to the neighbour's too.
    near = lambda at: F.transform(F.array(F.lit(0), F.lit(-half), F.lit(half)), lambda d: F.floor((at + d) / block))
    nowhere = F.array().cast("array<bigint>")
    blocks = F.array_distinct(F.flatten(F.array(*[F.when(F.col(f"v{i}").isNotNull(), near(F.col(f"at_{i}"))).otherwise(nowhere) for i in range(n)])))
    spread = placed.select(
        "__row", "__src", F.explode(blocks).alias("__block"), "at_row", "all_row",
        *[f"{c}{i}" for i in range(n) for c in ("v", "ok", "at_", "all_", "low", "high", "varied")],
    ).where(F.col("__block") >= 0)
    order = ["__src", "__block"]
    found = spread.repartition(*order).sortWithinPartitions(*order, "at_row").mapInPandas(
        _windows(names, half, block, least_rows, least_run, mads),
        f"__row {kinds['__row']}, __src {kinds['__src']}, measure string, reason string, score double, excess double",
    )
    return found.select(F.col("__row").alias(key), F.col("__src").alias(source), "measure", "reason", "score", "excess")
