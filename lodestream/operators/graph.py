"""Graphs as edge tables: reachability, subtree sums, levels, cycles; each round is cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut, release


def _edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.select(F.col(f"`{source}`").alias("a"), F.col(f"`{target}`").alias("b")).dropna().distinct()


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All pairs (a, b) such that a path of one edge or more leads from a to b; a node on a cycle reaches itself.

    Paths double each round, so a graph of depth d takes log d rounds; the result is as large as the closure.
    Edges with a NULL end are ignored.
    """
    pairs, size = cut(_edges(edges, source, target)), -1
    while (n := pairs.count()) != size:
        size = n
        longer = pairs.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        pairs = cut(pairs.unionByName(longer).distinct())
    return pairs


#: Pairs of a closure that one pass of ``reach_counts`` may hold.
PASS_PAIRS = 40_000_000


def _peeled(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(rows by round, what is left): each round takes off the rows (a, b, x) of the nodes a that no other node leads to any more.

    What is left leads to cycles, lies on them or comes from them.
    """
    rounds = []
    while True:
        entered = rows.where("a <> b").select(F.col("b").alias("a")).distinct().withColumn("entered", F.lit(True))
        marked = cut(rows.join(entered, "a", "left"))
        ready, rows = marked.where("entered is null").drop("entered"), marked.where("entered").drop("entered")
        if ready.isEmpty():
            return rounds, rows
        rounds.append(ready)


def _pass_counts(rounds: list[DataFrame], sizes: DataFrame | None, end: str, first: int, last: int, slices: int) -> DataFrame:
    """node, n: the counts of ``reach_counts`` over the targets in the hash slices ``first`` to ``last`` - 1 of ``slices``.

    Nodes get the union of what those they lead to reach, and of these, from the last round of ``_peeled`` to the first.
    """
    sets = None
    inside = F.pmod(F.xxhash64("x"), F.lit(slices)).between(first, last - 1)
    for number, rows in reversed(list(enumerate(rounds))):
        own = F.filter(F.array("x"), lambda _: inside)
        if sets is not None:
            rows = rows.join(sets.withColumnRenamed("a", "b"), "b", "left")
            own = F.concat(own, F.coalesce("reached", F.filter(F.array("x"), lambda _: F.lit(False))))
        found = rows.select("a", own.alias("s")).where(F.size("s") > 0).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("reached"))
        found = cut(found) if number else found  # nothing reads the sets of the first round but the counts
        sets = found if sets is None else sets.unionByName(found)
    if end == "a":
        return cut(sets.select(F.col("a").alias("node"), F.size("reached").cast("long").alias("n")))
    weight = F.lit(1).cast("long")
    if sizes is not None:
        sets, weight = sets.join(sizes, "a", "left"), F.coalesce("w", weight)
    return cut(sets.select(F.explode("reached").alias("node"), weight.alias("w")).groupBy("node").agg(F.sum("w").alias("n")))


def reach_counts(edges: DataFrame, source: str, target: str, end: str = "a") -> DataFrame:
    """node, n: of the pairs (a, b) of ``reachable``, how many have the node at ``end``; nodes without any are left out.

    Pairs aren't joined with one another. A node's set is the union of those of the nodes it leads to, which are done
    before it; cycles are first drawn together to one node, with what their edges lead to. Targets are dealt with in
    passes, so that only the sets of one pass are on disk; the first tells how many more are needed.
    """
    rows = cut(_edges(edges, source, target).withColumn("x", F.col("b")))
    rounds, rest = _peeled(rows)
    cycles = sizes = None
    if not rest.isEmpty():
        cycles = cut(on_cycles(rest, "a", "b"))
        for old in ("a", "b"):
            rows = rows.join(cycles.select(F.col("node").alias(old), "cycle"), old, "left").withColumn(old, F.coalesce("cycle", old)).drop("cycle")
        rounds, rest = _peeled(cut(rows.select("a", "b", "x").distinct()))
        sizes = cycles.groupBy(F.col("cycle").alias("a")).agg(F.count(F.lit(1)).alias("w"))
    if not rounds:
        return rows.select(F.col(end).alias("node"), F.lit(0).cast("long").alias("n")).limit(0)
    slices = 1024
    total = _pass_counts(rounds, sizes, end, 0, slices // 8, slices)
    held = 7 * (total.agg(F.sum("n")).first()[0] or 0)
    more = min(max(-(-held // PASS_PAIRS), 1), slices * 7 // 8)
    borders = [slices // 8 + slices * 7 // 8 * i // more for i in range(more + 1)]
    for first, last in zip(borders, borders[1:]):
        release(edges.sparkSession)
        total = total.unionByName(_pass_counts(rounds, sizes, end, first, last, slices))
    total = total.groupBy("node").agg(F.sum("n").alias("n"))
    if cycles is None or end == "b":
        return total
    members = cycles.select("node", F.col("cycle").alias("a"))
    return total.join(members.withColumnRenamed("node", "member"), F.col("node") == F.col("a"), "left").select(F.coalesce("member", "node").alias("node"), "n")


def subtree_sums(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """node, size, total and depth of every node of a forest: over itself and all nodes below it.

    A parent that isn't a node is no parent. Sums meet their ancestors through the closure of the parent edges, added
    up by node before each shuffle.
    """
    base = nodes.select(F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent"), F.col(f"`{value}`").alias("value")).where(F.col("node").isNotNull())
    real = base.select("node", "parent").join(base.select(F.col("node").alias("parent")), "parent", "left_semi")
    above = reachable(real, "node", "parent")
    pairs = above.select(F.col("a").alias("node"), F.col("b").alias("top")).unionByName(base.select("node", F.col("node").alias("top")))
    sums = pairs.join(base.select("node", "value"), "node").groupBy(F.col("top").alias("node")).agg(F.count(F.lit(1)).alias("size"), F.sum("value").alias("total"))
    depth = above.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("depth"))
    return sums.join(depth, "node", "left").select("node", "size", "total", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def levels(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, level: 0 for nodes that depend on nothing, else one more than the highest level among those depended on.

    ``source`` depends on ``target``. Nodes on cycles, and those that depend on one, have no level and are left out.
    """
    links = _edges(edges, source, target)
    open_links = cut(links)
    everything = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    waiting, done, level = cut(everything), None, 0
    while True:
        ready = cut(waiting.join(open_links.select(F.col("a").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            break
        ranked = ready.withColumn("level", F.lit(level))
        done, level = ranked if done is None else done.unionByName(ranked), level + 1
        if level % 32 == 0:  # the plan stays small, however many levels there are
            done = cut(done)
        waiting = cut(waiting.join(ready, "node", "left_anti"))
        open_links = cut(open_links.join(ready.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    return done if done is not None else everything.withColumn("level", F.lit(0)).limit(0)


def _trimmed(links: DataFrame) -> DataFrame:
    """The edges (a, b) left when those from nodes without in-edges and to nodes without out-edges are taken off again and again."""
    links, size = cut(links), -1
    while (n := links.count()) not in (0, size):
        size = n
        sources, targets = links.select(F.col("a").alias("b")).distinct(), links.select(F.col("b").alias("a")).distinct()
        links = cut(links.join(sources, "b", "left_semi").join(targets, "a", "left_semi").select("a", "b"))
    return links


def _components(links: DataFrame) -> DataFrame:
    """node, cycle: strongly connected components of two nodes or more, by forward and backward propagation.

    Each node takes the least node that leads to it; where that is a node itself, those of its colour that lead back to
    it are its component. Then the components and the edges between colours go, and what is left is coloured again.
    """
    found = None
    while not (links := _trimmed(links)).isEmpty():
        colours = cut(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().withColumn("cycle", F.col("node")))
        moved = colours
        while not moved.isEmpty():
            lower = links.join(moved.select(F.col("node").alias("a"), "cycle"), "a").groupBy(F.col("b").alias("node")).agg(F.min("cycle").alias("lower"))
            both = cut(colours.join(lower, "node", "left").select("node", F.least("cycle", "lower").alias("cycle"), (F.col("lower") < F.col("cycle")).alias("moved")))
            colours, moved = both.select("node", "cycle"), both.where("moved").select("node", "cycle")
        links = links.join(colours.select(F.col("node").alias("a"), "cycle"), "a").join(colours.select(F.col("node").alias("b"), F.col("cycle").alias("other")), "b")
        links = cut(links.where("cycle = other").select("a", "b"))
        back = step = cut(colours.where("node = cycle"))
        while not step.isEmpty():
            step = links.join(step.select(F.col("node").alias("b"), "cycle"), "b").select(F.col("a").alias("node"), "cycle").distinct()
            step = cut(step.join(back.select("node"), "node", "left_anti"))
            back = cut(back.unionByName(step))
        many = back.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cycle")
        ended = back.join(many, "cycle", "left_semi").select("node", "cycle")
        found = cut(ended if found is None else found.unionByName(ended))
        links = links.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("cycle"))


def on_cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, cycle: the nodes on cycles, each with the least node of its strongly connected component.

    Nodes with one way on only are first taken together with the node where their chain ends, by pointers that double
    each round, so that a long cycle of n nodes takes log n rounds; nothing grows with the closure.
    """
    links = _edges(edges, source, target)
    alone = cut(links.where("a = b").select(F.col("a").alias("node")))
    found = _looped(links.where("a <> b"))
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("cycle")))


def _looped(links: DataFrame) -> DataFrame:
    """``on_cycles`` of edges (a, b) without those from a node to itself."""
    links = _trimmed(links)
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("cycle"))
    single = lambda end: links.groupBy(end).count().where("count = 1").count()
    onward, inward, size = single("a"), single("b"), links.select("a").distinct().count()
    if max(onward, inward) < size / 10:
        return _components(links)
    if inward > onward:  # the components of the reversed graph are the same
        links = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # Where a node's chain leads: a node with several ways on stays where it is.
    ways = links.groupBy("a").agg(F.min("b").alias("b"), (F.count(F.lit(1)) > 1).alias("fork"))
    jumps = [cut(ways.select("a", F.when(F.col("fork"), F.col("a")).otherwise(F.col("b")).alias("b"), F.col("a").alias("low")))]
    forks = cut(ways.where("fork").select("a"))
    for _ in range((size - 1).bit_length()):
        far = jumps[-1].select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("low").alias("lower"))
        jumps.append(cut(jumps[-1].join(far, "b").select("a", F.col("c").alias("b"), F.least("low", "lower").alias("low"))))
    heads = jumps[-1]
    # Chains that come to no fork go round; the nodes they end at are those on the cycles.
    rings = heads.join(heads.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(forks, "a", "left_anti")
    rings = cut(rings.select(F.col("a").alias("node"), F.col("low").alias("cycle")))
    ends = heads.join(forks.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("a").alias("b"), F.col("b").alias("head"))
    core = cut(links.join(forks, "a", "left_semi").join(ends, "b").select("a", "b", "head"))
    if core.isEmpty():
        return rings
    inner = cut(on_cycles(core, "a", "head"))
    # A chain's nodes belong to a component if the chain leads from one of its forks to another, or the same.
    label = lambda name, tag: inner.select(F.col("node").alias(name), F.col("cycle").alias(tag))
    passed = cut(core.join(label("a", "cycle"), "a").join(label("head", "other"), "head").where("cycle = other").select(F.col("b").alias("node"), "cycle").distinct())
    for jump in jumps:
        passed = cut(passed.unionByName(passed.join(jump.select(F.col("a").alias("node"), "b"), "node").select(F.col("b").alias("node"), "cycle")).distinct())
    members = cut(inner.unionByName(passed).distinct())
    least = members.groupBy("cycle").agg(F.min("node").alias("least"))
    return rings.unionByName(members.join(least, "cycle").select("node", F.col("least").alias("cycle")))


def entry_points(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node: those that nothing leads to."""
    links = _edges(edges, source, target)
    return links.select(F.col("a").alias("node")).distinct().join(links.select(F.col("b").alias("node")), "node", "left_anti")


def _opened(links: DataFrame, own: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, own) without cycles: every node on one gets what its paths within its component collect, and their ways out.

    A path ends where it comes to a node it has been at, and adds that node's own cost. Such paths are enumerated.
    """
    cycles = cut(cycles)
    placed = links.join(cycles.select(F.col("node").alias("a"), F.col("cycle").alias("left")), "a", "left")
    placed = cut(placed.join(cycles.select(F.col("node").alias("b"), F.col("cycle").alias("entered")), "b", "left"))
    within = placed.where("left = entered").select(F.col("a").alias("node"), "b", F.col("f").alias("g"))
    outward = placed.where("left is not null and not left <=> entered").select(F.col("a").alias("node"), "b", F.col("f").alias("g"))
    paths = cut(cycles.select(F.col("node").alias("top"), "node", F.lit(1.0).alias("f"), F.array("node").alias("seen"), F.lit(False).alias("back")))
    weights = None
    while not paths.isEmpty():
        ends = paths.select("top", "node", "f", "back")
        weights = cut((ends if weights is None else weights.unionByName(ends)).groupBy("top", "node", "back").agg(F.sum("f").alias("f")))
        longer = paths.where(~F.col("back")).join(within, "node").select("top", F.col("b").alias("node"), (F.col("f") * F.col("g")).alias("f"), "seen")
        paths = cut(longer.select("top", "node", "f", F.array_append("seen", F.col("node")).alias("seen"), F.array_contains("seen", F.col("node")).alias("back")))
    costs = weights.join(own, "node").groupBy(F.col("top").alias("node")).agg(F.sum(F.col("f") * F.col("total")).alias("total"))
    ways = weights.where(~F.col("back")).join(outward, "node").groupBy(F.col("top").alias("a"), "b").agg(F.sum(F.col("f") * F.col("g")).alias("f"))
    others = placed.where("left is null").select("a", "b", "f")
    return cut(others.unionByName(ways)), cut(own.join(cycles, "node", "left_anti").unionByName(costs))


def path_costs(edges: DataFrame, source: str, target: str, factor: str, costs: DataFrame, node: str, cost: str) -> DataFrame:
    """node, total: a node's own cost and that of everything it calls, times the factors along each path, however long.

    Sums are carried upwards level by level, added up by node, so paths aren't enumerated. Only within a cycle's
    component they are: there a path ends where it comes to a node it has been at, whose own cost it adds.
    """
    links = edges.select(F.col(f"`{source}`").alias("a"), F.col(f"`{target}`").alias("b"), F.col(f"`{factor}`").cast("double").alias("f")).dropna()
    links = cut(links)  # every round joins it again
    own = costs.select(F.col(f"`{node}`").alias("node"), F.col(f"`{cost}`").cast("double").alias("total"))
    loops = _trimmed(links.select("a", "b").distinct())
    if not loops.isEmpty():
        links, own = _opened(links, own, on_cycles(loops, "a", "b"))
    step, total, rounds = own, own, 0
    while not (step := cut(step.join(links, F.col("node") == F.col("b")).groupBy(F.col("a").alias("node")).agg(F.sum(F.col("total") * F.col("f")).alias("total")))).isEmpty():
        total, rounds = total.unionByName(step), rounds + 1
        if rounds % 32 == 0:  # the plan stays small, however long the paths are
            total = cut(total.groupBy("node").agg(F.sum("total").alias("total")))
    return total.groupBy("node").agg(F.sum("total").alias("total"))
