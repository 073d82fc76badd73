"""Filling fixed-capacity containers: optimal length buckets, and token-budget batches begun inside each bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length buckets chosen by the dynamic program.
BUCKETS = 64
#: The histogram has at most so many bars for a capacity; longer ones are rounded up to them.
BARS = 1024
#: A packing task gets about this many pieces; each task leaves at most a few containers part-filled.
TASK_PIECES = 50_000


def byte_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer: one for each UTF-8 byte and one end token."""
    return F.octet_length(text) + 1


def bucket_bounds(sizes, counts, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most ``buckets`` length buckets that minimise the padding of all items to their bound.

    Dynamic program over the histogram (``sizes`` rising, ``counts`` of each): padding of items i..j in one bucket is
    bound times count minus total length, so each step is a minimum over where the last bucket begins.
    """
    import numpy as np

    sizes, counts = np.asarray(sizes, dtype=float), np.asarray(counts, dtype=float)
    n = len(sizes)
    if n <= buckets:
        return [int(s) for s in sizes]
    number = np.concatenate([[0], counts.cumsum()])
    length = np.concatenate([[0], (counts * sizes).cumsum()])
    best = sizes * number[1:] - length[1:]  # one bucket for the items 0..j
    begin = np.zeros((buckets, n), dtype=int)
    for b in range(1, buckets):
        new = np.full(n, np.inf)
        for j in range(b, n):
            i = np.arange(b, j + 1)  # the last bucket holds i..j, the b before it 0..i-1
            cost = best[i - 1] + sizes[j] * (number[j + 1] - number[i]) - (length[j + 1] - length[i])
            k = int(np.argmin(cost))
            new[j], begin[b, j] = cost[k], i[k]
        best = new
    bounds, j = [], n - 1
    for b in range(buckets - 1, -1, -1):
        bounds.append(int(sizes[j]))
        j = int(begin[b, j]) - 1
    return sorted(bounds)


def _packer(bounds: dict[int, list[int]]) -> Callable[[Iterator], Iterator]:
    """Over a partition whose rows are sorted by capacity and task: fills the containers of one task after another."""

    def pack(capacity, task, rows):
        import bisect

        import pandas as pd

        limits = bounds[capacity]
        shelves: list[list] = [[] for _ in limits]
        for row in rows:
            shelves[bisect.bisect_left(limits, row[2])].append(row)
        top, number, out = len(limits) - 1, 0, []
        while True:
            while top >= 0 and not shelves[top]:
                top -= 1
            if top < 0:
                break
            room, shelf = capacity, top
            while shelf >= 0:
                # A batch takes from its bucket while a whole bucket length fits, then from the next shorter ones;
                # from a longer bucket only if the item itself fits.
                if shelves[shelf] and shelves[shelf][-1][2] <= room:
                    doc, piece, size = shelves[shelf].pop()
                    room -= size
                    out.append((capacity, f"{task}-{number}", doc, piece, size))
                else:
                    shelf = min(shelf - 1, bisect.bisect_left(limits, room))
            number += 1
        return pd.DataFrame(out, columns=["capacity", "container", "doc_id", "piece", "tokens"])

    def run(batches):
        held, rows = None, []
        for pdf in batches:
            for capacity, task, doc, piece, size in zip(
                pdf["capacity"].tolist(), pdf["task"].tolist(), pdf["doc_id"].tolist(), pdf["piece"].tolist(), pdf["tokens"].tolist()
            ):
                if held != (capacity, task):
                    if rows:
                        yield pack(*held, rows)
                    held, rows = (capacity, task), []
                rows.append((doc, piece, size))
        if rows:
            yield pack(*held, rows)

    return run


def fill_containers(docs: DataFrame, key: str, size: Column, capacities: DataFrame, capacity: str = "capacity", buckets: int = BUCKETS) -> DataFrame:
    """Assign every item to containers of each capacity: capacity, container, doc_id, piece, pieces, start, tokens.

    An item larger than the capacity is cut into full containers and a rest (piece 0, 1, ...; ``start`` is the piece's
    first token); every other item stays whole (pieces = 1). ``size`` counts an item's tokens; items of NULL key or size
    are left out, repeated keys count as items of their own. Capacities below one are ignored, repeated ones count once.

    The lengths are counted by capacity and length before anything reaches the driver, which then sees at most ``BARS``
    bars for each capacity; the dynamic program turns them into buckets. Pieces are spread over tasks of about
    ``TASK_PIECES`` at random, each of which fills its own containers.
    """
    caps = sorted({int(r[0]) for r in capacities.select(F.col(f"`{capacity}`").cast("long")).distinct().collect() if r[0] and r[0] > 0})
    names = dict(docs.dtypes)
    items = docs.select(F.col(f"`{key}`").alias("doc_id"), size.cast("long").alias("size")).dropna()
    items = items.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in caps]).cast("array<bigint>")))
    cap = F.col("capacity")
    pieces = F.greatest(F.ceil(F.col("size") / cap), F.lit(1))
    items = items.withColumn("pieces", pieces.cast("long"))
    rest = F.col("size") - (F.col("pieces") - 1) * cap
    width = F.greatest(F.ceil(cap / BARS), F.lit(1))
    bar = F.least(F.ceil(rest / width) * width, cap).alias("bar")
    bars: dict[int, dict[int, int]] = {c: {} for c in caps}
    for row in items.groupBy("capacity", bar).agg(F.count(F.lit(1)).alias("n")).collect():
        bars[row["capacity"]][max(int(row["bar"]), 1)] = row["n"]
    bounds, total = {}, 0
    for c, histogram in bars.items():
        sizes = sorted(histogram)
        bounds[c] = bucket_bounds(sizes, [histogram[s] for s in sizes], buckets) if sizes else [c]
        if bounds[c][-1] < c:
            bounds[c].append(c)
        total = max(total, sum(histogram.values()))
    # Full pieces fill a container alone; only rests are packed.
    tasks = max(1, -(-total // TASK_PIECES))
    task = F.pmod(F.xxhash64("doc_id", F.col("capacity")), F.lit(tasks)).cast("long")
    open_pieces = items.select("capacity", task.alias("task"), "doc_id", (F.col("pieces") - 1).alias("piece"), rest.alias("tokens"))
    sorted_pieces = open_pieces.repartition("capacity", "task").sortWithinPartitions("capacity", "task", "tokens")
    packed = sorted_pieces.mapInPandas(
        _packer(bounds), f"capacity long, container string, doc_id {names[key]}, piece long, tokens long"
    )
    packed = packed.withColumn("full", F.lit(False))
    whole = items.where(F.col("pieces") > 1).select("capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 2)).alias("piece"))
    whole = whole.select("capacity", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), "doc_id", "piece", cap.alias("tokens"), F.lit(True).alias("full"))
    both = packed.unionByName(whole)
    # A rest that isn't piece 0 belongs to a cut item; a full piece always does.
    split = F.col("full") | (F.col("piece") > 0)
    return both.select(
        "capacity", "container", "doc_id", "piece", split.alias("split"), (F.col("piece") * cap).alias("start"), "tokens"
    )


def fill_report(placed: DataFrame) -> DataFrame:
    """By capacity: containers, pieces, tokens, the share of space filled and the least number of containers possible."""
    by = placed.groupBy("capacity").agg(
        F.count_distinct("container").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens")
    )
    return by.select(
        "*", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"),
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
    )
