"""Graph operators against brute force on small graphs."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestream.operators import graph
from lodestream.plans.registry import QUERIES


def cost_of(node, links, costs, seen=()):
    """As the reference's call tree has it: a node that the path has been at adds its own cost and ends the path."""
    if node in seen:
        return costs[node]
    return costs[node] + sum(f * cost_of(b, links, costs, (*seen, node)) for a, b, f in links if a == node)


def path_costs(spark, links, costs):
    edges = spark.createDataFrame(links, "a long, b long, f double")
    own = spark.createDataFrame(sorted(costs.items()), "node long, cost long")
    return {r.node: r.total for r in graph.path_costs(edges, "a", "b", "f", own, "node", "cost").collect()}


def test_path_costs_of_long_paths(spark):
    costs = {n: n + 1 for n in range(41)}
    links = [(n, n + 1, 2.0 if n == 20 else 1.0) for n in range(40)]
    assert path_costs(spark, links, costs) == {n: cost_of(n, links, costs) for n in costs}


@pytest.mark.parametrize("seed", range(3))
def test_path_costs_on_cycles(spark, seed):
    pick = random.Random(seed)
    costs = {n: pick.randint(1, 50) for n in range(12)}
    links = [(0, 1, 1.0), (1, 2, 10.0), (2, 0, 1.0), (3, 0, 2.0), (2, 4, 1.0), (4, 4, 3.0)]
    links += [(pick.randrange(12), pick.randrange(12), pick.choice([1.0, 10.0])) for _ in range(8)]
    assert path_costs(spark, links, costs) == pytest.approx({n: cost_of(n, links, costs) for n in costs})


def components(links):
    """By the closure: each node that reaches itself, with the least node that it reaches and that reaches it."""
    reach = {(a, b) for a, b in links}
    while longer := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= longer
    return {a: min(c for b, c in reach if b == a and (c, a) in reach) for a, b in reach if a == b}


def cycles(spark, links):
    rows = graph.on_cycles(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    got = {r.node: r.cycle for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("nodes, edges", [(6, 8), (30, 33), (30, 45), (12, 60), (5, 2)])
def test_cycles(spark, nodes, edges):
    pick = random.Random(nodes * edges)
    links = [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(edges)]
    assert cycles(spark, links) == components(links)


@pytest.mark.parametrize("forward", [True, False])
def test_cycles_joined_by_chains(spark, forward):
    links = [(3, 20), (20, 21), (21, 1), (1, 3), (1, 22), (22, 23), (23, 3), (23, 0), (0, 40), (40, 41), (41, 40), (5, 3), (50, 50), (50, 51), (51, 52), (52, 50)]
    links = links if forward else [(b, a) for a, b in links]
    assert cycles(spark, links) == components(links)


def test_cycles_cover_every_part(spark, tmp_path):
    spark.range(1001).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.node: r.cycle for r in QUERIES["G02_cycles"](spark, str(tmp_path)).collect()}
    least = {}
    for start in range(1000):  # every node has one way on: what a thousand steps lead to is on a cycle
        node = start
        for _ in range(1000):
            node = (node * 7 + 3) % 1000
        if node not in least:
            ring = [node]
            while (node := (node * 7 + 3) % 1000) != ring[0]:
                ring.append(node)
            least |= dict.fromkeys(ring, min(ring))
    assert got == least and len(got) > 200


@pytest.mark.parametrize("nodes, edges, pairs", [(30, 33, 40_000_000), (6, 8, 10), (5, 0, 10)])
def test_reach_counts(spark, monkeypatch, nodes, edges, pairs):
    monkeypatch.setattr(graph, "PASS_PAIRS", pairs)
    pick = random.Random(nodes + edges)
    links = [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(edges)]
    reach = {(a, b) for a, b in links}
    while longer := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= longer
    frame = spark.createDataFrame([*links, (None, 1), (1, None)], "a long, b long")
    for place, end in enumerate("ab"):
        rows = graph.reach_counts(frame, "a", "b", end).collect()
        assert sorted((r.node, r.n) for r in rows) == sorted(Counter(pair[place] for pair in reach).items())


@pytest.mark.parametrize("name", ["G08_transitive_dependencies", "G09_dependents"])
def test_dependencies_are_counted_without_joining_pairs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(graph, "reachable", None)  # its rounds join the closure with itself
    spark.range(1, 301).where("id % 11 > 0").select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    below = {}
    for part in range(1, 301):
        ends = {part // k for k in (2, 3) if part >= k and part % 11}
        below[part] = ends | {x for end in ends for x in below[end]}
    got = {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    if name[:3] == "G08":
        assert got == {part: len(ends) for part, ends in below.items() if ends}
    else:
        assert got == Counter(x for ends in below.values() for x in ends)
