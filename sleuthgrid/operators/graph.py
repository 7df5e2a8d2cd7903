"""Graph operators: each round is a join with the frontier and is staged, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stage


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each undirected edge source, target, both ways, without loops and repeats."""
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return ends.union(ends.select("b", "a")).where("a <> b").distinct()


def nearest_seed(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops, seed, shared) for each node within max_hops of a seed.

    seeds: node, rank. `seed` is the nearest one, of equally near ones that of least rank; `shared` says
    that several seeds touch the node directly. The frontier carries the least rank alone, as a
    node's nearest seeds are those of its neighbours one hop nearer.
    """
    links = stage(both_ways(edges), "links")
    reached = seeds.select("node", F.lit(0).alias("hops"), F.col("rank"), F.lit(1).cast("long").alias("touching"))
    frontier = reached
    for hop in range(1, max_hops + 1):
        step = links.join(frontier.select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node"))
        step = step.agg(F.min("rank").alias("rank"), F.count_distinct("rank").alias("touching")).join(reached.select("node"), "node", "left_anti")
        frontier = stage(step.select("node", F.lit(hop).alias("hops"), "rank", "touching"), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    names = seeds.select(F.col("node").alias("seed"), "rank")
    return reached.join(names, "rank").select("node", "hops", "seed", ((F.col("hops") == 1) & (F.col("touching") > 1)).alias("shared"))


def hops_from(edges: DataFrame, node: str, max_hops: int) -> DataFrame:
    """(node, hops) of the nodes within max_hops of one."""
    one = edges.sparkSession.createDataFrame([(node, 0)], "node string, rank int")
    return nearest_seed(edges, one, max_hops).select("node", "hops")


def degrees(edges: DataFrame, strong: list[str]) -> DataFrame:
    """(node, degree, strong) with `strong` counting edges of these relations."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "rel")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.count_if(F.col("rel").isin(strong)).alias("strong"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """(node, depth): breadth-first growth that stops at the depth, or before the level which would pass max_nodes."""
    links = stage(both_ways(edges), "links")
    seen = frontier = seeds.select("node", F.lit(0).alias("depth"))
    total = seen.count()
    for level in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = stage(step.select("node", F.lit(level).alias("depth")), "expansion")
        total += (n := frontier.count())
        if not n or total > max_nodes:
            break
        seen = seen.union(frontier)
    return seen
