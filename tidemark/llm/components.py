"""Connected components by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a LONG, b LONG); component is its smallest reachable node.

    Every round each node points at its smallest neighbour, pointers are shortened, and edges are carried over to
    the ends of the pointers; nodes that keep edges at least halve. All state is in written tables, so an executor
    may go at any time. The hot keys are minima, which are combined before the shuffle. An empty input gives an empty result.
    """
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    maps, k = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = scratch.save(point, f"{name}-p{k}")
        # The pointers go down, so following them ends at nodes that point at themselves.
        j = 0
        while True:
            up = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            nxt = scratch.save(point.join(up, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), f"{name}-p{k}-{j}")
            still = not nxt.where("moved").isEmpty()
            point = nxt.select("node", "to")
            if not still:
                break
            j += 1
        if maps is None:
            maps = point
        else:
            step = point.select(F.col("node").alias("component"), F.col("to").alias("far"))
            maps = scratch.save(maps.withColumnRenamed("to", "component").join(step, "component", "left").select("node", F.coalesce("far", "component").alias("to")), f"{name}-m{k}")
        pa, pb = point.select(F.col("node").alias("a"), F.col("to").alias("ra")), point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        nxt = edges.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        k += 1
        edges = scratch.save(nxt, f"{name}-e{k}")
    if maps is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return maps.select("node", F.col("to").alias("component"))
