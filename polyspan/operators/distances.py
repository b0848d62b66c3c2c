"""Distances of points to triangles in steps: what depends on the triangle alone before the points come, and every term as a
column of its own, so that none is computed twice. Sums and products are in the order of `functions.geometry`'s plain forms
as SQL writes them, so that both round alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V


def _named(name: str, v: V.Vector) -> list[Column]:
    return [x.alias(name + k) for k, x in zip("xyz", v, strict=True)]


def triangle_terms(triangles: DataFrame, more: list) -> DataFrame:
    """The columns `more` of triangles (ax .. cz), their corners, and terms of the sides and the plane."""
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    u, v, w = (V.vec(k) for k in "uvw")
    t = triangles.select(*more, *_named("a", a), *_named("b", b), *_named("c", c), *_named("u", V.minus(b, a)), *_named("v", V.minus(c, a)), *_named("w", V.minus(c, b)))
    t = t.select("*", V.sqrnorm(u).alias("uu"), V.dot(u, v).alias("uv"), V.sqrnorm(v).alias("vv"), V.sqrnorm(w).alias("ww"), *_named("m", V.cross(u, v)))
    return t.select("*", V.norm(V.vec("m")).alias("size"), (F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")).alias("area"))


def distance_by_terms(rows: DataFrame, point: V.Vector) -> DataFrame:
    """Rows of `triangle_terms` with a point each, and `d`, the distance: to the plane where the projection lies inside, else
    to the nearest side."""
    a, b, c, u, v, w, m, p, r, s = (V.vec(k) for k in "abcuvwmprs")
    t = rows.select("*", *_named("o", point))
    o = V.vec("o")
    t = t.select("*", *_named("p", V.minus(o, a)), *_named("r", V.minus(o, b)), *_named("s", V.minus(o, c)))
    t = t.select("*", V.dot(p, u).alias("pu"), V.dot(p, v).alias("pv"), V.dot(r, w).alias("rw"), (-V.dot(s, v)).alias("sv"))
    along = lambda x, y: F.coalesce(G.clamp(F.try_divide(F.col(x), F.col(y)), 0.0, 1.0), F.lit(0.0))
    inner = lambda i, j, k, n: F.try_divide(F.col(i) * F.col(j) - F.col("uv") * F.col(k), F.col("area")).alias(n)
    t = t.select("*", inner("vv", "pu", "pv", "g"), inner("uu", "pv", "pu", "h"), along("pu", "uu").alias("t0"), along("rw", "ww").alias("t1"), along("sv", "vv").alias("t2"))
    off = lambda e, k, d: V.sqrnorm(V.minus(o, V.plus(e, V.scaled(d, F.col(k)))))
    back = tuple(-x for x in v)
    sides = F.sqrt(F.least(off(a, "t0", u), off(b, "t1", w), off(c, "t2", back)))
    inside = (1 - F.col("g") - F.col("h") >= 0) & (F.col("g") >= 0) & (F.col("h") >= 0)
    return t.withColumn("d", F.when(inside, F.abs(V.dot(p, m)) / F.col("size")).otherwise(sides))
