"""Edges: incidence, bounded search, components, forgetting."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from strataq.sessions import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, edge id) from either end; two scans in place of a join with OR."""
    a = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "id")
    return a.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "id"))


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (column node), each once."""
    hit = both_ways(edges).join(ids.select("node").distinct(), "node", "left_semi").select("id").distinct()
    return edges.join(hit, "id", "left_semi")


def intact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, in one partition; nodes have (node, scope)."""
    n = nodes.select("node", "scope")
    out = edges.join(n.withColumnRenamed("scope", "_s"), edges.source_id == F.col("node")).drop("node")
    out = out.join(n.withColumnRenamed("scope", "_t"), out.target_id == F.col("node")).drop("node")
    return out.filter(F.col("_s").eqNullSafe(F.col("_t"))).drop("_s", "_t")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` undirected steps of the seeds."""
    hops = both_ways(edges)
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    front = seen
    for d in range(1, depth + 1):
        front = hops.join(front.select("node"), "node").select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen = seen.unionByName(front)
    return seen


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node reachable; isolated nodes are their own.

    Every round takes the least label among neighbours and then follows the label's
    own label, so most chains shrink fast; at worst a chain takes a round a node.  Labels are written to the checkpoint
    folder between rounds.  Rounds go on until no label changes; more than
    ``most_rounds``, if given, are an error.
    """
    hops = both_ways(edges).select("node", "other").distinct()
    labels = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    for done in itertools.count():  # labels only fall, so this ends
        if done == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        near = hops.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("_near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        now = cut(step.join(jump, step.component == jump._n, "left").select("node", "_old", F.least("component", F.coalesce("_c", "component")).alias("component")))
        labels = now.select("node", "component")
        if now.filter("component <> _old").isEmpty():
            break
    return labels
