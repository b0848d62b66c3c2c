"""Polylines as ordered rows (curve_id, seq, x, y): windows over each curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V

def _order():
    return Window.partitionBy("curve_id").orderBy("seq")


def neighbours(curve: DataFrame, closed: bool = False) -> DataFrame:
    """With px, py (previous) and nx, ny (next); at the ends of open curves null, of closed ones the other end."""
    whole = Window.partitionBy("curve_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = curve
    for k in ("x", "y"):
        before, after = F.lag(k).over(_order()), F.lead(k).over(_order())
        if closed:
            before, after = F.coalesce(before, F.last(k).over(whole)), F.coalesce(after, F.first(k).over(whole))
        out = out.withColumn("p" + k, before).withColumn("n" + k, after)
    return out


def arc_lengths(curve: DataFrame) -> DataFrame:
    """With `step` from the previous point (0 at the first) and the running `arc`."""
    step = F.coalesce(V.distance((F.col("x"), F.col("y")), (F.lag("x").over(_order()), F.lag("y").over(_order()))), F.lit(0.0))
    return curve.withColumn("step", step).withColumn("arc", F.sum("step").over(_order()))


def signed_areas(curve: DataFrame) -> DataFrame:
    """(curve_id, area): the shoelace formula over closed curves."""
    c = neighbours(curve, closed=True)
    return c.groupBy("curve_id").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def curvatures(curve: DataFrame) -> DataFrame:
    """With `curvature`: one over the circumradius, signed by the turn; null at ends, 0 on straight pieces."""
    c = neighbours(curve)
    p, q, r = V.vec("p", "xy"), (F.col("x"), F.col("y")), V.vec("n", "xy")
    radius = G.circumradius_2d(p, q, r)
    turn = F.signum(G.left_of(p, q, r))
    k = F.when(F.col("px").isNull() | F.col("nx").isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(turn * F.try_divide(F.lit(1.0), radius), F.lit(0.0)))
    return c.select(*curve.columns, k.alias("curvature"))


def laplacians(curve: DataFrame) -> DataFrame:
    """With lx, ly: (2 / (l0 + l1)) ((next - p) / l1 - (p - previous) / l0), 0 at ends and for zero lengths."""
    c = neighbours(curve)
    p, q, r = V.vec("p", "xy"), (F.col("x"), F.col("y")), V.vec("n", "xy")
    l0, l1 = V.distance(q, p), V.distance(r, q)
    parts = [F.coalesce((2 / (l0 + l1)) * (F.try_divide(c2 - c1, l1) - F.try_divide(c1 - c0, l0)), F.lit(0.0)) for c0, c1, c2 in zip(p, q, r, strict=True)]
    ok = (l0 > 0) & (l1 > 0)
    return c.select(*curve.columns, *(F.when(ok, v).otherwise(F.lit(0.0)).alias("l" + k) for k, v in zip("xy", parts, strict=True)))


def smoothed(curve: DataFrame, step: float = 0.5) -> DataFrame:
    """Inner points moved towards the middle of their neighbours."""
    c = neighbours(curve)
    move = lambda k: F.when(F.col("p" + k).isNull() | F.col("n" + k).isNull(), F.col(k)).otherwise(F.col(k) + step * ((F.col("p" + k) + F.col("n" + k)) / 2 - F.col(k)))
    return c.select("curve_id", "seq", move("x").alias("x"), move("y").alias("y"))


def self_crossings(curve: DataFrame, cell: float) -> DataFrame:
    """(curve_id, a, b): pairs of segments of a curve, by their first seq, that cross properly. Segments meet in cells."""
    c = neighbours(curve).where(F.col("nx").isNotNull())
    seg = c.select("curve_id", "seq", "x", "y", "nx", "ny")
    for k in "xy":
        seg = seg.withColumn("c" + k, F.explode(F.sequence(F.floor(F.least(k, "n" + k) / cell), F.floor(F.greatest(k, "n" + k) / cell))))
    other = seg.select("curve_id", "cx", "cy", F.col("seq").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("nx").alias("onx"), F.col("ny").alias("ony"))
    cross = G.segments_cross((F.col("x"), F.col("y")), (F.col("nx"), F.col("ny")), (F.col("ox"), F.col("oy")), (F.col("onx"), F.col("ony")))
    return seg.join(other, ["curve_id", "cx", "cy"]).where((F.col("b") > F.col("seq") + 1) & cross).select("curve_id", F.col("seq").alias("a"), "b").distinct()


def points_inside(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """Points (pid, x, y) with `inside` the closed polygon (seq, x, y): even-odd crossings. A polygon's corners are
    joined as segments; points are grouped by themselves, so the polygon side is streamed."""
    c = neighbours(polygon.withColumn("curve_id", F.lit(0)), closed=True)
    seg = c.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    # bands of y: a segment stands in each band that it spans
    band = 1.0
    seg = seg.withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band))))
    hits = points.withColumn("band", F.floor(F.col("y") / band)).join(seg, "band").where(spans & right).groupBy("pid").agg(F.count("*").alias("n"))
    return points.join(hits, "pid", "left").select(*points.columns, (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def resampled(curve: DataFrame, step: float) -> DataFrame:
    """(curve_id, k, x, y): points at every multiple k of `step` along the curve, by linear interpolation."""
    a = arc_lengths(curve)
    nxt = lambda c: F.lead(c).over(_order())
    seg = a.withColumn("arc1", nxt("arc")).withColumn("x1", nxt("x")).withColumn("y1", nxt("y")).where("arc1 > arc")
    first, last = F.ceil(F.col("arc") / step), F.ceil(F.col("arc1") / step) - 1
    seg = seg.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * step - F.col("arc")) / (F.col("arc1") - F.col("arc"))
    return seg.select("curve_id", "k", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def filled(curve: DataFrame, column: str, forward: bool = True) -> Column:
    """The last (or next) value of a column that is not null, for use with select."""
    w = Window.partitionBy("curve_id").orderBy("seq")
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def reversed_order(curve: DataFrame) -> DataFrame:
    """The same points from the last to the first, seq from 1."""
    back = Window.partitionBy("curve_id").orderBy(F.col("seq").desc())
    return curve.withColumn("seq", F.row_number().over(back).cast("long"))


def vertex_normals(curve: DataFrame) -> DataFrame:
    """(curve_id, seq, nx, ny): the sum of the unit normals (to the right) of both edges, or of one at an end, normalised;
    0 where they cancel."""
    c = neighbours(curve)
    at = (F.col("x"), F.col("y"))
    back, on = (V.scaled(V.perp(V.normalize(V.minus(*e))), -1.0) for e in ((at, V.vec("p", "xy")), (V.vec("n", "xy"), at)))
    total = V.plus(*(tuple(F.coalesce(k, F.lit(0.0)) for k in n) for n in (back, on)))
    return c.select("curve_id", "seq", *(k.alias("n" + a) for a, k in zip("xy", V.normalize(total), strict=True)))


def covolumes(curve: DataFrame) -> DataFrame:
    """(curve_id, seq, length): half of both edges, 0 at ends."""
    c = neighbours(curve)
    at = (F.col("x"), F.col("y"))
    return c.select("curve_id", "seq", F.coalesce((V.distance(at, V.vec("p", "xy")) + V.distance(at, V.vec("n", "xy"))) / 2, F.lit(0.0)).alias("length"))


def edge_midpoints(curve: DataFrame) -> DataFrame:
    """(curve_id, seq, x, y): the middle of the edge that starts at seq."""
    c = neighbours(curve).where("nx is not null and ny is not null")
    m = G.midpoint((F.col("x"), F.col("y")), V.vec("n", "xy"))
    return c.select("curve_id", "seq", m[0].alias("x"), m[1].alias("y"))


def summaries(curve: DataFrame) -> DataFrame:
    """(curve_id, n, min_dimension, max_dimension, closed): sides of the box; closed if the last point is the first."""
    ends = lambda f, k: f(F.struct("seq", k))[k]
    sides = [F.max(k) - F.min(k) for k in "xy"]
    same = (ends(F.min, "x") == ends(F.max, "x")) & (ends(F.min, "y") == ends(F.max, "y")) & (F.count("*") > 1)
    return curve.groupBy("curve_id").agg(F.count("*").alias("n"), F.least(*sides).alias("min_dimension"), F.greatest(*sides).alias("max_dimension"), same.alias("closed"))
