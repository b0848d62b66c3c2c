"""Densities of points by the ring of their neighbours, samples weighted by them, and discs within polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .joins import knn_join
from .lineage import cut
from .sampling import poisson_disc, unit_hash

#: What counts as no length, and the area that stands for none.
FLAT, NO_AREA = 1.1920928955078125e-7, 1e10


def _part(v: Column) -> tuple[Column, ...]:
    return tuple(v[k] for k in "xyz")


def _row(v: tuple[Column, ...]) -> Column:
    return F.struct(*(p.alias(k) for k, p in zip("xyz", v, strict=True)))


def ring_areas(rings: DataFrame, by: list[str]) -> DataFrame:
    """(`by`, area) of rows with `ring`, an array of the ways (x, y, z) from a centre to its neighbours, the nearest first:
    the fan of triangles through the neighbours in the order of their angles in a tangent plane. The plane is that of the
    first way and of the first other that is not along it; without one, and with fewer than three, the area is 0.

    A ring is as long as the search was asked for neighbours, so it is folded within the row."""
    first = F.col("ring")[0]
    normals = F.filter(F.transform("ring", lambda v: _row(V.cross(_part(first), _part(v)))), lambda n: V.norm(_part(n)) > FLAT)
    out = rings.select(*by, "ring", F.try_element_at(normals, F.lit(1)).alias("n"))
    n = V.normalize(tuple(F.col("n." + k) for k in "xyz"))
    out = out.select(*by, "ring", _row(n).alias("n"), F.col("n").isNotNull().alias("_plane"))
    n = tuple(F.col("n." + k) for k in "xyz")
    t = V.normalize(V.minus(_part(first), V.scaled(n, V.dot(_part(first), n))))
    out = out.select(*by, "ring", "n", _row(t).alias("t"), (F.col("_plane") & (V.norm(_part(first)) > FLAT)).alias("_plane"))
    t = tuple(F.col("t." + k) for k in "xyz")
    out = out.select(*by, "_plane", "ring", "t", _row(V.cross(n, t)).alias("b"))
    b = tuple(F.col("b." + k) for k in "xyz")
    turned = F.array_sort(F.transform("ring", lambda v: F.struct(F.atan2(V.dot(_part(v), b), V.dot(_part(v), t)).alias("a"), *(v[k].alias(k) for k in "xyz"))))
    out = out.select(*by, (F.col("_plane") & (F.size("ring") > 2)).alias("_plane"), turned.alias("ring"))
    step = lambda v, w: V.norm(V.cross(_part(v), _part(w))) / 2
    fan = F.zip_with("ring", F.concat(F.slice("ring", 2, 1_000_000), F.slice("ring", 1, 1)), step)
    return out.select(*by, F.when(F.col("_plane"), F.aggregate(fan, F.lit(0.0), lambda s, a: s + a)).otherwise(0.0).alias("area"))


def ring_densities(points: DataFrame, k: int, cell: float, by: list[str] = ()) -> DataFrame:
    """(`by`, pid, n_found, area, density): the number of the up to k nearest others over the area of their ring; with an
    area of none over a very large one, without others 0."""
    pairs = knn_join(points, points, k, cell, by=list(by))
    own = points.select(*by, "pid", *(F.col(c).alias("p" + c) for c in "xyz"))
    to = points.select(*by, F.col("pid").alias("other"), *(F.col(c).alias("q" + c) for c in "xyz"))
    way = F.struct("rank", *((F.col("q" + c) - F.col("p" + c)).alias(c) for c in "xyz"))
    rings = pairs.join(own, [*by, "pid"]).join(to, [*by, "other"]).groupBy(*by, "pid").agg(F.array_sort(F.collect_list(way)).alias("ring"))
    areas = ring_areas(rings, [*by, "pid"]).join(rings.select(*by, "pid", F.size("ring").alias("n_found")), [*by, "pid"])
    found = points.select(*by, "pid").join(areas, [*by, "pid"], "left").select(*by, "pid", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("area", F.lit(0.0)).alias("area"))
    return found.withColumn("density", F.col("n_found") / F.when(F.col("area") < FLAT, NO_AREA).otherwise(F.col("area")))


def softmax_sample(densities: DataFrame, n: int, beta: float = 1.0, gamma: float = 1.0, target: float | None = None, seed: int = 0) -> DataFrame:
    """The n rows (pid, density, ..) with the largest log(u) / (gamma w), that is without replacement with probability by
    the weight w = exp(beta (density - target)), cut to 1e-300 .. 1e300; `target` is the mean density if not given.
    Every partition keeps n rows before anything is shuffled."""
    if target is None:
        target = densities.agg(F.avg("density")).first()[0] or 0.0
    weight = F.greatest(F.lit(1e-300), F.least(F.lit(1e300), F.exp(beta * (F.col("density") - target))))
    key = F.log(F.greatest(unit_hash(F.col("pid"), seed=seed), F.lit(1e-300))) / (gamma * weight)
    return densities.withColumn("weight", weight).withColumn("priority", key).orderBy(F.desc("priority"), "pid").limit(n)


def in_polygons(points: DataFrame, sides: DataFrame, row: float, by: str) -> DataFrame:
    """Points (by, pid, x, y) within the polygons (by, ax, ay, bx, by_) given by their sides: an odd number of sides passes
    to the right. Sides go to the rows of height `row` that they cross, points look into their own."""
    spread = sides.withColumn("_row", F.explode(F.sequence(F.floor(F.least("ay", "by_") / row), F.floor(F.greatest("ay", "by_") / row))))
    met = points.withColumn("_row", F.floor(F.col("y") / row)).join(spread, [by, "_row"])
    astride = (F.col("ay") > F.col("y")) != (F.col("by_") > F.col("y"))
    right = F.col("x") < F.col("ax") + F.try_divide((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")), F.col("by_") - F.col("ay"))
    odd = met.where(astride & right).groupBy(by, "pid").agg(F.count("*").alias("_n")).where("_n % 2 = 1").select(by, "pid")
    return points.join(odd.hint("merge"), [by, "pid"], "left_semi")


def polygon_sides(corners: DataFrame, by: str) -> DataFrame:
    """(by, ax, ay, bx, by_) of closed polygons given by corners (by, seq, x, y), seq without gaps from 0."""
    n = corners.groupBy(by).agg(F.count("*").alias("_n"))
    after = corners.select(by, F.col("seq").alias("_to"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    return corners.join(n, by).withColumn("_to", F.pmod(F.col("seq") + 1, F.col("_n"))).join(after, [by, "_to"]).select(by, F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by_")


def discs_in_polygons(corners: DataFrame, radius: float, attempts: int = 8, by: str = "polygon_id", seed: int = 0) -> DataFrame:
    """(by, pid, x, y): points within closed polygons (by, seq, x, y), no two of a polygon nearer than or at `radius`, and
    none of the candidates could be added. Each square of side `radius` within a polygon's box has `attempts` candidates
    at places that follow from its number, so the result depends on nothing else. The id of a candidate holds its square
    (24 bits a side, from the polygon's box) and its attempt."""
    if not 0 < attempts <= 256:
        raise ValueError("attempts must be 1 to 256")
    box = corners.groupBy(by).agg(*(f("`%s`" % k).alias(n + k) for n, f in (("lo", F.min), ("hi", F.max)) for k in "xy"))
    wide = [F.floor((F.col("hi" + k) - F.col("lo" + k)) / radius) for k in "xy"]
    squares = box.select(by, "lox", "loy", wide[1].alias("_ny"), F.explode(F.sequence(F.lit(0).cast("long"), wide[0])).alias("_ix"))
    squares = squares.repartition(by, "_ix").select(by, "lox", "loy", "_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny"))).alias("_iy"))
    tried = squares.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    pid = (F.col("_ix") * (1 << 24) + F.col("_iy")) * 256 + F.col("_k")
    place = lambda k, s: (F.col("lo" + k) + (F.col("_i" + k) + unit_hash(F.col(by), F.col("_ix"), F.col("_iy"), F.col("_k"), seed=seed + s)) * radius).alias(k)
    # written, as the size of what is exploded here is not known to the planner, which would send it whole to the driver
    tried = cut(tried.select(by, pid.alias("pid"), place("x", 0), place("y", 1)))
    inside = cut(in_polygons(tried, polygon_sides(corners, by), radius, by))
    return poisson_disc(inside, radius, "xy", seed + 2, by=[by])
