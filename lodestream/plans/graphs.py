"""Graph operators (G) and orders of dependencies (T18, T19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import graph
from lodestream.plans.aggregates import n_rows
from lodestream.plans.query import Register
from lodestream.plans.views import Views

QUERIES = Register()
add = QUERIES.add

_TREE = "tree as (select c_custkey as node, c_custkey // 2 as parent, cast(round(c_acctbal) as bigint) as cost from customer)"
_DAG = "dag as (select p_partkey as a, p_partkey // 2 as b from part where p_partkey > 1 union select p_partkey, p_partkey // 3 from part where p_partkey > 2)"
_RING = "ring as (select p_partkey as a, (p_partkey * 7 + 3) % (select max(p_partkey) from part) as b from part)"
_UP = "up as (select node, parent from tree where parent > 0 union select u.node, t.parent from up u join tree t on t.node = u.parent where t.parent > 0)"
_REACH = "reach as (select a, b from {0} union select r.a, e.b from reach r join {0} e on e.a = r.b)"


def tree(v: Views) -> DataFrame:
    """A call tree: every customer under the one of half its number."""
    return v.raw("customer").select(F.col("c_custkey").alias("node"), F.nullif(F.floor(F.col("c_custkey") / 2), F.lit(0).cast("long")).alias("parent"), F.round("c_acctbal").cast("long").alias("cost"))


def dag(v: Views) -> DataFrame:
    """Dependencies without cycles: every part on those of half and a third of its number."""
    keys = v.raw("part").select(F.col("p_partkey").alias("a"))
    half, third = keys.where("a > 1").withColumn("b", F.floor(F.col("a") / 2)), keys.where("a > 2").withColumn("b", F.floor(F.col("a") / 3))
    return half.unionByName(third).distinct()


def ring(v: Views) -> DataFrame:
    """Dependencies with cycles, over every part."""
    keys = v.raw("part").select(F.col("p_partkey").alias("a"))
    return keys.join(F.broadcast(keys.agg(F.max("a").alias("most")))).select("a", ((F.col("a") * 7 + 3) % F.col("most")).alias("b"))


@add("G02_cycles", sql="with recursive " + ", ".join([_RING, _REACH.format("ring")]) + " select r.a as node, min(r.b) as cycle from reach r join reach s on r.a = s.b and r.b = s.a group by 1")
def cycles(v: Views) -> DataFrame:
    return graph.on_cycles(ring(v), "a", "b")


@add("G04_cumulative_cost", sql="with recursive " + _DAG + """, p as (select p_partkey as top, p_partkey as node, cast(1.0 as double) as f from part union all
  select p.top, e.b, p.f * case when e.b % 5 = 0 then 10 else 1 end from p join dag e on e.a = p.node)
select top as node, round(sum(f * p_size), 4) as total from p join part on p_partkey = node group by 1""")
def cumulative_cost(v: Views) -> DataFrame:
    calls = dag(v).withColumn("f", F.when(F.col("b") % 5 == 0, 10.0).otherwise(1.0))
    costs = v.raw("part").select("p_partkey", "p_size")
    return graph.path_costs(calls, "a", "b", "f", costs, "p_partkey", "p_size").select("node", F.round("total", 4).alias("total"))


@add("G06_entry_points", sql="with " + _DAG + " select distinct a as node from dag where a not in (select b from dag)")
def entries(v: Views) -> DataFrame:
    return graph.entry_points(dag(v), "a", "b")


@add("G07_subtree_sums", sql="with recursive " + ", ".join([_TREE, _UP]) + """, pairs as (select node, parent as top from up union select node, node from tree)
select top as node, count(*) as size, cast(sum(cost) as bigint) as total, (select count(*) from up where up.node = pairs.top) as depth from pairs join tree using (node) group by top""")
def subtree_sums(v: Views) -> DataFrame:
    return graph.subtree_sums(tree(v), "node", "parent", "cost")


@add("G08_transitive_dependencies", sql="with recursive " + ", ".join([_DAG, _REACH.format("dag")]) + " select a as node, count(*) as dependencies from reach group by 1")
def transitive_dependencies(v: Views) -> DataFrame:
    return graph.reach_counts(dag(v), "a", "b", "a").withColumnRenamed("n", "dependencies")


@add("G09_dependents", sql="with recursive " + ", ".join([_DAG, _REACH.format("dag")]) + " select b as node, count(*) as dependents from reach group by 1")
def dependents(v: Views) -> DataFrame:
    return graph.reach_counts(dag(v), "a", "b", "b").withColumnRenamed("n", "dependents")


@add("G10_unused_exports", sql="with " + _DAG + " select p_partkey as node from part where p_partkey not in (select b from dag)")
def unused_exports(v: Views) -> DataFrame:
    return v.raw("part").select(F.col("p_partkey").alias("node")).join(dag(v).select(F.col("b").alias("node")), "node", "left_anti")


@add("G12_inheritance_depth", sql="with recursive " + ", ".join([_TREE, _UP]) + " select t.node, count(u.parent) as depth from tree t left join up u on u.node = t.node group by 1")
def inheritance_depth(v: Views) -> DataFrame:
    return graph.subtree_sums(tree(v), "node", "parent", "cost").select("node", "depth")


@add("G14_flattened", "sources", "select file, generate_subscripts(string_split(source, chr(10)), 1) - 1 as node, length(unnest(string_split(source, chr(10)))) as chars from sources")
def flattened(v: Views) -> DataFrame:
    """A text's lines as child nodes of its file."""
    return v.sources.select("file", F.posexplode(F.split("source", "\n")).alias("node", "line")).select("file", F.col("node").cast("long").alias("node"), F.length("line").alias("chars"))


@add("T18_dependency_levels", sql="with recursive " + _DAG + """, l as (select 1 as node, 0 as level union select e.a, l.level + 1 from l join dag e on e.b = l.node)
select node, max(level) as level from l group by 1""")
def dependency_levels(v: Views) -> DataFrame:
    return graph.levels(dag(v), "a", "b")


@add("T19_dependency_order", sql="with recursive " + _DAG + """, l as (select 1 as node, 0 as level union select e.a, l.level + 1 from l join dag e on e.b = l.node),
m as (select node, max(level) as level from l group by 1) select level, count(*) as nodes, min(node) as first_node from m group by 1""")
def dependency_order(v: Views) -> DataFrame:
    return graph.levels(dag(v), "a", "b").groupBy("level").agg(n_rows().alias("nodes"), F.min("node").alias("first_node"))
