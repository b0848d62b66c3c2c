"""Iterations to a fixed point; each round is cut by a table in the session's shared folder; none stops before it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import radius_join
from .lineage import cut, drop


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component. Alternating large and small stars: every node's
    greater neighbours are hung on its least one, then its lesser neighbours; rounds grow with the logarithm of the
    size, and they go on until nothing changes."""
    state, last = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        before, state = state, cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return nodes.select("node").join(state.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        last = now


def radius_clusters(points: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """(pid, cluster): components of points nearer than `radius`, named by their smallest id."""
    pairs = radius_join(points, points, radius, axes).where((F.col("pid") < F.col("other")) & (F.col("d") < radius))
    found = labels(points.select(F.col("pid").alias("node")), pairs.select(F.col("pid").alias("u"), F.col("other").alias("v")))
    return found.select(F.col("node").alias("pid"), F.col("label").alias("cluster"))


def hop_distances(edges: DataFrame, sources: DataFrame, most: float | None = None) -> DataFrame:
    """(node, distance): shortest path lengths from the sources (node) over edges (u, v, length), where reachable; with
    `most`, of the nodes that are no farther than that. No length is negative. A round an edge of the longest of these
    paths."""
    both = cut(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "length").unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "length")))
    state = cut(sources.select("node", F.lit(0.0).alias("distance")))
    front = state
    while True:
        reached = both.join(front.select(F.col("node").alias("a"), "distance"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("new"))
        if most is not None:
            reached = reached.where(F.col("new") <= most)
        better = cut(reached.join(state, "node", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("node", F.col("new").alias("distance")))
        if better.isEmpty():
            break
        before, state = state, cut(state.join(better.select("node"), "node", "left_anti").unionByName(better))
        drop(before, front)
        front = better
    drop(both)
    return state


def eikonal(grid: DataFrame, frozen: DataFrame, cell: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """(ix, iy, value): first-order upwind distances from frozen nodes (ix, iy, value) over a 2D grid, by relaxation
    until no value falls by more than `eps`; nodes that no frozen one reaches keep 1e9."""
    state = cut(grid.select("ix", "iy").join(frozen.select("ix", "iy", "value"), ["ix", "iy"], "left").select("ix", "iy", F.coalesce("value", F.lit(1e9)).alias("value"), F.col("value").isNotNull().alias("fixed")))
    while True:
        near = state
        for i, (axis, d) in enumerate((("ix", 1), ("ix", -1), ("iy", 1), ("iy", -1))):
            near = near.join(state.select(*((F.col(a) - (d if a == axis else 0)).alias(a) for a in ("ix", "iy")), F.col("value").alias(f"n{i}")), ["ix", "iy"], "left")
        a, b = F.coalesce(F.least("n0", "n1"), F.lit(1e9)), F.coalesce(F.least("n2", "n3"), F.lit(1e9))
        low, high = F.least(a, b), F.greatest(a, b)
        two = (a + b + F.sqrt(F.greatest(F.lit(0.0), 2 * cell * cell - (a - b) * (a - b)))) / 2
        new = F.least("value", F.when(high - low >= cell, low + cell).otherwise(two))
        after = cut(near.select("ix", "iy", F.when(F.col("fixed"), F.col("value")).otherwise(new).alias("value"), "fixed", F.col("value").alias("old")))
        done = after.where(F.col("old") - F.col("value") > eps).isEmpty()
        state = after.drop("old")
        if done:
            break
    return state.select("ix", "iy", "value")
