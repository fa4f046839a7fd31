"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)`` edges to ``(node, component)``, where component is the least node reached.

    In each round every node joins the node of least hash within two steps, under a fresh seed,
    and the edges are rewritten between the joined nodes: a star is one node after a round, and
    any graph shrinks by a constant factor.  A hub costs one partial minimum per task, never a
    collected list; what joins on it is written before, so that its rows can be split.
    Self-loops and repeated edges are harmless; an edge with a null end is dropped.
    """
    live = scratch.save(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    )
    maps: list[DataFrame] = []
    while not live.isEmpty():
        seed = len(maps)
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("rank"), c.alias("id"))
        both = live.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
            live.select(F.col("v").alias("node"), F.col("u").alias("near"))
        )
        best = both.groupBy("node").agg(F.min(rank(F.col("near"))).alias("best"))
        best = scratch.save(best.select("node", F.least(rank(F.col("node")), F.col("best")).alias("best")))
        around = both.join(best.select(F.col("node").alias("near"), F.col("best").alias("far")), "near").groupBy("node").agg(F.min("far").alias("far"))
        step = scratch.save(best.join(around, "node").select("node", F.least("best", "far")["id"].alias("root")))
        scratch.drop(best)
        maps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        before, live = live, scratch.save(
            live.join(left, "u").join(right, "v").where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
        scratch.drop(before)
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = maps[0]
    for step in maps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        label = label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    label = scratch.save(label)
    scratch.drop(*maps)
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(least, "root").select("node", "component")
