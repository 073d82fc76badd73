from __future__ import annotations

import itertools
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import packing as p


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_bounds_minimise_padding(histogram, buckets):
    sizes = sorted(histogram)
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in histogram.items())
    best = min(cost((*some, sizes[-1])) for n in range(min(buckets, len(sizes))) for some in itertools.combinations(sizes[:-1], n))
    bounds = p.bucket_bounds(sizes, [histogram[s] for s in sizes], buckets)
    assert len(bounds) <= buckets and bounds[-1] == sizes[-1] and cost(bounds) == best


def fill(spark, texts, capacities):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, capacity int, container string")
    caps = spark.createDataFrame([(c,) for c in capacities], "capacity long")
    return p.fill_containers(docs, "doc_id", p.byte_tokens(F.col("text")), caps).collect()


def test_every_token_is_placed_once_and_nothing_overflows(spark):
    pick = random.Random(4)
    texts = [(i, "é" * int(pick.lognormvariate(4, 1))) for i in range(600)] + [(900, ""), (901, None), (902, "x" * 5000)]
    rows = fill(spark, texts, [300, 1000, 300])
    for capacity in (300, 1000):
        own = [r for r in rows if r.capacity == capacity]
        space, placed = defaultdict(int), defaultdict(list)
        for r in own:
            space[r.container] += r.tokens
            placed[r.doc_id].append((r.start, r.tokens, r.split))
        assert max(space.values()) <= capacity
        for i, t in texts:
            if t is None:
                assert i not in placed
                continue
            size = len(t.encode()) + 1
            parts = sorted(placed[i])
            assert sum(n for _, n, _ in parts) == size and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert (len(parts) > 1) == (size > capacity) == any(s for *_, s in parts)
        assert sum(space.values()) / (len(space) * capacity) > 0.97


def test_exact_multiples_and_one_over(spark):
    rows = fill(spark, [(1, "x" * 9), (2, "x" * 10), (3, "x" * 19)], [10])
    assert sorted((r.doc_id, r.start, r.tokens, r.split) for r in rows) == [(1, 0, 10, False), (2, 0, 10, True), (2, 10, 1, True), (3, 0, 10, True), (3, 10, 10, True)]


def test_empty_and_useless(spark):
    assert fill(spark, [], [10]) == [] and fill(spark, [(1, "abc")], []) == [] and fill(spark, [(1, "abc")], [0]) == []


def test_repeated_keys_are_items_of_their_own(spark):
    assert sum(r.tokens for r in fill(spark, [(1, "abc"), (1, "abc")], [10])) == 8
