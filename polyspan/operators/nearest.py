"""The nearest of triangles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import packed, triangle_pairs
from .lineage import cut

#: Points and triangles of a block.
SIZE = 512


def nearest_triangle(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """(pid, fid, d): the nearest triangle (fid, ax .. cz) of each point, ties by the smaller id. Blocks of points first meet the
    block of triangles that is nearest to theirs, which bounds each point's distance, and then all blocks whose boxes are
    within the largest bound of theirs; nothing is sent but blocks, whatever the `cell`."""
    corners = [p + k for p in "abc" for k in "xyz"]
    lo, hi, at = *G.bounds(V.vec("a"), V.vec("b"), V.vec("c")), V.vec("")
    right = cut(packed.packed(triangles.select("fid", *corners), lo, hi, "fid", SIZE))
    left = cut(packed.packed(points.select("pid", "x", "y", "z"), at, at, "pid", SIZE))
    own, other = cut(packed.boxes(left, at, at, "a")), cut(packed.boxes(right, lo, hi, "b"))
    gap = lambda k: F.greatest(F.col("blo" + k) - F.col("ahi" + k), F.col("alo" + k) - F.col("bhi" + k), F.lit(0.0))
    middle = V.distance(*(tuple(F.col(n + "lo" + k) + F.col(n + "hi" + k) for k in "xyz") for n in "ab"))
    apart = own.crossJoin(other).select("a", "b", V.norm(tuple(gap(k) for k in "xyz")).alias("gap"), middle.alias("middle"))
    first = cut(apart.groupBy("a").agg(F.min(F.struct("gap", "middle", "b")).alias("m")).select("a", F.col("m.b").alias("b")))

    def work(one: pa.Table, two: pa.Table, same: bool) -> pa.Table:
        p, t = packed.numbers(one, ["x", "y", "z"]), packed.numbers(two, corners).reshape(-1, 3, 3)
        off = np.maximum(np.maximum(t.min(axis=(0, 1)) - p, p - t.max(axis=(0, 1))), 0.0)
        known = one.column("known").to_numpy()
        asks = np.sqrt((off * off).sum(axis=1)) <= known * (1 + 1e-9)
        one, p, known = one.filter(pa.array(asks)), p[asks], known[asks]
        d, which = triangle_pairs.nearest(p, t, known, two.column("fid").to_numpy())
        met = np.isfinite(d)
        return pa.table({"pid": one.column("pid").filter(pa.array(met)), "d": d[met], "fid": which[met]})

    schema = f"pid {points.schema['pid'].dataType.simpleString()}, d double, fid long"
    far = left.withColumn("known", F.lit(float("inf")))
    near = cut(packed.met(far, right, first, work, schema))
    bound = cut(left.join(near.select("pid", F.col("d").alias("known")).hint("merge"), "pid"))
    most = cut(bound.groupBy(F.col("block").alias("a")).agg(F.max("known").alias("most")))
    # a little farther, so that rounding loses no block; a block is asked where a point is that near, not only its block
    close = cut(apart.join(most, "a").where(F.col("gap") <= F.col("most") * (1 + 1e-9)).select("a", "b").join(first, ["a", "b"], "left_anti").join(other, "b"))
    off = V.norm(tuple(F.greatest(F.col("blo" + k) - F.col(k), F.col(k) - F.col("bhi" + k), F.lit(0.0)) for k in "xyz"))
    rest = cut(bound.withColumnRenamed("block", "a").join(close.hint("merge"), "a").where(off <= F.col("known") * (1 + 1e-9)).select("a", "b").distinct())
    found = near.unionByName(packed.met(bound, right, rest, work, schema))
    return found.groupBy("pid").agg(F.min(F.struct("d", "fid")).alias("m")).select("pid", F.col("m.fid").alias("fid"), F.col("m.d").alias("d"))
