"""Distinct counts by registers of the maximum rank and indicator bits of nearby lower ranks, estimated by maximum likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^PRECISION registers. The standard error is ERROR_FACTOR / sqrt(2^PRECISION): 1.2 % with 12.
PRECISION = 12
ERROR_FACTOR = 0.761
#: Besides its maximum rank a register keeps whether each of so many next lower ranks occurred (8 bits in all).
LOWER = 2
#: Registers that a task holds at once (8 bytes each); beyond them it hands on what it has, to be merged later.
HELD = 8_000_000


def standard_error(precision: int = PRECISION) -> float:
    """The relative standard error of an estimate over 2^precision registers."""
    return ERROR_FACTOR / 2 ** (precision / 2)


def _bit_length(x):
    """Number of bits of each element of a uint64 array."""
    import numpy as np

    x, n = x.copy(), np.zeros(x.shape, dtype=np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        step = np.uint64(step)
        high = (x >> step) > 0
        n[high] += step
        x[high] >>= step
    return n + (x > 0)


def pack(bits):
    """Registers (uint64 arrays, bit k-1 stands for rank k) as bytes: maximum rank in the upper six bits, indicators below.

    Of a register nothing is dropped that a later maximum could need.
    """
    import numpy as np

    top, one = _bit_length(bits), np.uint64(1)
    out = top << np.uint64(LOWER)
    for j in range(1, LOWER + 1):
        j = np.uint64(j)
        held = top > j
        out[held] |= ((bits[held] >> (top[held] - one - j)) & one) << (np.uint64(LOWER) - j)
    return out.astype(np.uint8)


def unpack(cells):
    """The registers (see :func:`pack`) of bytes."""
    import numpy as np

    top, one = (cells >> LOWER).astype(np.uint64), np.uint64(1)
    bits = np.zeros(cells.shape, dtype=np.uint64)
    for j in range(LOWER + 1):
        has = (top > np.uint64(j)) & ((cells >> (LOWER - j)) & 1 == 1) if j else top > 0
        bits[has] |= one << (top[has] - one - np.uint64(j))
    return bits


class _Held:
    """Registers by group, handed on as a batch of sketches."""

    def __init__(self, schema, precision: int) -> None:
        self.schema, self.size, self.slots = schema, 2**precision, {}
        self.bits = None

    def slot(self, key: tuple) -> int:
        import numpy as np

        at = self.slots.setdefault(key, len(self.slots))
        if self.bits is None or at >= len(self.bits):
            bits = np.zeros((max(16, 2 * at), self.size), dtype=np.uint64)
            if self.bits is not None:
                bits[: len(self.bits)] = self.bits
            self.bits = bits
        return at

    def full(self) -> bool:
        return len(self.slots) * self.size >= HELD

    def batch(self):
        import pyarrow as pa

        columns = [pa.array([k[i] for k in self.slots], type=f.type) for i, f in enumerate(list(self.schema)[:-1])]
        cells = pack(self.bits[: len(self.slots)]) if self.slots else []
        out = pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in cells], type=pa.binary())], schema=self.schema)
        self.slots, self.bits = {}, None
        return out


def _schema(batch, names: list[str]):
    import pyarrow as pa

    return pa.schema([*[batch.schema.field(n) for n in names], pa.field("sketch", pa.binary())])


def _fold(groups: list[str], precision: int) -> Callable[[Iterator], Iterator]:
    """Rows (groups, hash) to one sketch for each group of a task."""

    def run(batches):
        import numpy as np

        held = None
        for batch in batches:
            if held is None:
                held = _Held(_schema(batch, groups), precision)
            column = batch.column(len(groups))
            batch = batch.filter(column.is_valid())
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for g in range(len(groups)):
                coded = batch.column(g).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            keys = zip(*[batch.column(g).take(first).to_pylist() for g in range(len(groups))]) if groups else [()]
            slots = np.array([held.slot(k) for k in keys])[group]
            hashes = batch.column(len(groups)).to_numpy().view(np.uint64)
            register = (hashes >> np.uint64(64 - precision)).astype(np.int64)
            # Rank: one plus the leading zeros of the hash's other bits, at most 65 - precision.
            zeros = np.minimum(64 - _bit_length(hashes << np.uint64(precision)), np.uint64(64 - precision))
            np.bitwise_or.at(held.bits, (slots, register), np.uint64(1) << zeros)
            if held.full():
                yield held.batch()
        if held is not None and held.slots:
            yield held.batch()

    return run


def _united(names: list[str], precision: int, combinations: int = 0) -> Callable[[Iterator], Iterator]:
    """Sketches of a partition sorted by ``names`` to one for each group.

    With ``combinations`` (the number of group columns) the last name is the grouping, 0 so far; each finished sketch
    also goes into those of all combinations of fewer columns, which are handed on at the end.
    """

    def run(batches):
        import numpy as np

        held = rolled = last = None
        for batch in batches:
            if held is None:
                held, rolled = _Held(_schema(batch, names), precision), _Held(_schema(batch, names), precision)
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(names))])) if names else [()] * batch.num_rows
            cells = batch.column(len(names)).to_pylist()
            for key, cell in zip(keys, cells):
                if key != last and held.full():
                    yield from finish(held, rolled)
                last, at = key, held.slot(key)
                held.bits[at] |= unpack(np.frombuffer(cell, dtype=np.uint8))
        if held is not None:
            yield from finish(held, rolled)
            if rolled.slots:
                yield rolled.batch()

    def finish(held, rolled):
        for key, at in list(held.slots.items()) if combinations else []:
            for mask in range(1, 2**combinations):
                kept = tuple(None if mask >> (combinations - 1 - i) & 1 else key[i] for i in range(combinations))
                to = rolled.slot((*kept, mask))
                rolled.bits[to] |= held.bits[at]
            if rolled.full():
                yield rolled.batch()
        if held.slots:
            yield held.batch()

    return run


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{n}` {kinds[n]}" for n in names], "sketch binary"])


def sketches(df: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """One mergeable sketch of 2^precision bytes for each group's set of ``value``: groups, sketch.

    NULL values aren't counted; a group of none has no row. Values are hashed to 64 bits inside the JVM. A task folds
    its rows into one sketch for each group it sees, so that a hot group reaches the shuffle as 2^precision bytes for
    each task, however many rows it has.
    """
    return merge(_partial(df, groups, value, precision), groups, precision)


def _partial(df: DataFrame, groups: list[str], value: str, precision: int) -> DataFrame:
    known = F.col(f"`{value}`").isNotNull()
    hashed = df.select(*groups, F.when(known, F.xxhash64(F.col(f"`{value}`").cast("string"))).alias("__h"))
    return hashed.mapInArrow(_fold(groups, precision), _kinds(df, groups))


def merge(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """Unite sketches by ``groups``; the result is that of one pass over all the values (lossless).

    Sketches pass through one by one in the order of their groups; none are gathered.
    """
    return _ordered(parts, groups).mapInArrow(_united(groups, precision), _kinds(parts, groups))


def _ordered(parts: DataFrame, names: list[str]) -> DataFrame:
    own = parts.select(*names, "sketch")
    return own.repartition(*names).sortWithinPartitions(*names) if names else own.repartition(1)


def roll_up(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """Sketches for every combination of ``groups``: a group column is NULL where the sketch is over all its values.

    ``grouping`` has a bit for each group column, the first the highest, set where it is rolled up. A group may have
    several sketches, of different tasks or runs.
    """
    names = [*groups, "grouping"]
    leaves = parts.withColumn("grouping", F.lit(0))
    rolled = _ordered(leaves, names).mapInArrow(_united(names, precision, len(groups)), _kinds(leaves, names))
    return merge(rolled, names, precision)


def likelihood_estimates(sketches, precision: int = PRECISION):
    """The maximum-likelihood counts of packed sketches (an iterable of bytes), as a float array.

    With the number of values a Poisson variable of mean n, a register sees rank k with probability
    1 - exp(-n / 2^precision / 2^k), independently. The log-likelihood's derivative falls in n, so its root is bisected.
    """
    import numpy as np

    size, last = 2**precision, 65 - precision
    weight = 2.0 ** -np.arange(last + 1)  # of rank k; the last rank takes all that is left
    weight[last] = weight[last - 1]
    beyond = np.append(np.cumsum(weight[:0:-1])[::-1], 0.0)  # beyond[u]: weight of all ranks above u
    out = []
    for raw in sketches:
        cell = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        if len(cell) != size:
            raise ValueError(f"a sketch of {len(cell)} registers where {size} were expected")
        top = cell >> 2
        seen = np.bincount(top[top > 0], minlength=last + 1).astype(float)
        unseen = beyond[top].sum()
        for j in range(1, LOWER + 1):
            rank = top - j
            flag = (cell >> (LOWER - j)) & 1
            has, lacks = rank[(rank > 0) & (flag == 1)], rank[(rank > 0) & (flag == 0)]
            seen += np.bincount(has, minlength=last + 1)
            unseen += weight[lacks].sum()
        if not seen.any():
            out.append(0.0)
            continue
        if unseen <= 0:
            out.append(float("inf"))
            continue
        ranks = np.flatnonzero(seen)
        low, high = 0.0, 1.0

        def slope(x, r=ranks, s=seen, u=unseen):
            return (s[r] * weight[r] / np.expm1(np.minimum(x * weight[r], 700.0))).sum() - u

        while slope(high) > 0:
            low, high = high, high * 2
        for _ in range(60):
            middle = (low + high) / 2
            if slope(middle) > 0:
                low = middle
            else:
                high = middle
        out.append(size * (low + high) / 2)
    return np.array(out)


def estimates(sketches: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """groups, distinct (rounded estimate), standard_error (relative, known beforehand), of packed sketches."""

    @F.pandas_udf("double")
    def likeliest(sketch):
        import pandas as pd

        return pd.Series(likelihood_estimates(sketch, precision))

    return sketches.select(
        *groups, F.round(likeliest("sketch")).cast("long").alias("distinct"), F.lit(standard_error(precision)).alias("standard_error")
    )


def distinct_counts(df: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """Distinct ``value`` for each combination of ``groups``, rolled up too: groups, grouping, distinct, standard_error.

    A NULL group value is counted as a group of its own; ``grouping`` tells it from a roll-up. Repeated rows change
    nothing. An empty input gives an empty result.
    """
    return estimates(roll_up(_partial(df, groups, value, precision), groups, precision), [*groups, "grouping"], precision)
