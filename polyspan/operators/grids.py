"""Regular grids as tables of nodes (ix, iy [, iz], value): stencils are joins of shifted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voxels(points: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """(i + axis, n, distance): occupied cells, their point counts and the least distance of a point to the cell's
    lower corner."""
    far = F.sqrt(sum((F.pow(F.col(k) - F.floor(F.col(k) / cell) * cell, F.lit(2.0)) for k in axes), F.lit(0.0)))
    return points.groupBy(*(F.floor(F.col(k) / cell).cast("long").alias("i" + k) for k in axes)).agg(F.count("*").alias("n"), F.min(far).alias("distance"))


def shifted(grid: DataFrame, name: str, **by: int) -> DataFrame:
    """The value of the node that lies `by` away, under another name."""
    axes = [c for c in grid.columns if c in ("ix", "iy", "iz")]
    return grid.select(*((F.col(a) - by.get(a, 0)).alias(a) for a in axes), F.col("value").alias(name))


def gradient(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """(ix, iy, gx, gy): central differences, one-sided at the rim, 0 for a lone node."""
    out = grid
    for axis, g in (("ix", "gx"), ("iy", "gy")):
        out = out.join(shifted(grid, "_up", **{axis: 1}), ["ix", "iy"], "left").join(shifted(grid, "_down", **{axis: -1}), ["ix", "iy"], "left")
        steps = F.when(F.col("_up").isNotNull(), 1).otherwise(0) + F.when(F.col("_down").isNotNull(), 1).otherwise(0)
        slope = F.try_divide(F.coalesce("_up", "value") - F.coalesce("_down", "value"), steps * cell)
        out = out.withColumn(g, F.coalesce(slope, F.lit(0.0))).drop("_up", "_down")
    return out.select("ix", "iy", "gx", "gy")


def laplacian(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """(ix, iy, laplacian): five-point stencil at nodes with all four neighbours."""
    out = grid
    for i, (axis, d) in enumerate((("ix", 1), ("ix", -1), ("iy", 1), ("iy", -1))):
        out = out.join(shifted(grid, f"_n{i}", **{axis: d}), ["ix", "iy"])
    return out.select("ix", "iy", ((F.col("_n0") + F.col("_n1") + F.col("_n2") + F.col("_n3") - 4 * F.col("value")) / cell**2).alias("laplacian"))


def blur(grid: DataFrame, weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> DataFrame:
    """(ix, iy, value): a separable blur over the nodes that exist, weights normalised to those."""
    half = len(weights) // 2
    out = grid
    for axis in ("ix", "iy"):
        steps = F.array(*[F.struct(F.lit(d - half).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights)])
        spread = out.select("ix", "iy", "value", F.explode(steps).alias("s")).withColumn(axis, F.col(axis) + F.col("s.d"))
        out = spread.groupBy("ix", "iy").agg((F.sum(F.col("s.w") * F.col("value")) / F.sum("s.w")).alias("value"))
        out = out.join(grid.select("ix", "iy"), ["ix", "iy"], "left_semi")
    return out


def local_maxima(grid: DataFrame) -> DataFrame:
    """(ix, iy, value): nodes above all of their eight neighbours that exist."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = grid.select((F.col("ix")).alias("ix"), "iy", "value", F.explode(steps).alias("s")).select((F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iy") + F.col("s.b")).alias("iy"), F.col("value").alias("near"))
    top = near.groupBy("ix", "iy").agg(F.max("near").alias("near"))
    return grid.join(top, ["ix", "iy"], "left").where(F.col("near").isNull() | (F.col("value") > F.col("near"))).select("ix", "iy", "value")


def bilinear(grid: DataFrame, points: DataFrame, x: str = "x", y: str = "y", cell: float = 1.0) -> DataFrame:
    """Points with `sample`: the blend of the four nodes around each; null where a node is missing."""
    at = points.withColumn("ix", F.floor(F.col(x) / cell)).withColumn("iy", F.floor(F.col(y) / cell))
    for i, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        at = at.join(shifted(grid, f"_g{i}", ix=a, iy=b), ["ix", "iy"], "left")
    u, v = F.col(x) / cell - F.col("ix"), F.col(y) / cell - F.col("iy")
    blend = F.col("_g0") * (1 - u) * (1 - v) + F.col("_g1") * u * (1 - v) + F.col("_g2") * (1 - u) * v + F.col("_g3") * u * v
    return at.select(*points.columns, blend.alias("sample"))


def dual(grid: DataFrame) -> DataFrame:
    """(ix, iy, value): the mean of the four corners of each whole cell."""
    out = grid
    for i, (a, b) in enumerate(((1, 0), (0, 1), (1, 1))):
        out = out.join(shifted(grid, f"_g{i}", ix=a, iy=b), ["ix", "iy"])
    return out.select("ix", "iy", ((F.col("value") + F.col("_g0") + F.col("_g1") + F.col("_g2")) / 4).alias("value"))


def combined(left: DataFrame, right: DataFrame, op) -> DataFrame:
    """(ix, iy [, iz], value): op(left value, right value) at the nodes of both."""
    axes = [c for c in left.columns if c in ("ix", "iy", "iz")]
    return left.join(right.withColumnRenamed("value", "_other"), axes).select(*axes, op(F.col("value"), F.col("_other")).alias("value"))


def negated(grid: DataFrame, lo: tuple[int, ...] | None = None, hi: tuple[int, ...] | None = None) -> DataFrame:
    """Values times -1, everywhere or at the nodes from lo to hi."""
    axes = [c for c in grid.columns if c in ("ix", "iy", "iz")]
    inside = F.lit(True)
    for a, p, q in zip(axes, lo or (), hi or ()):
        inside = inside & F.col(a).between(p, q)
    return grid.withColumn("value", F.when(inside, -F.col("value")).otherwise(F.col("value")))


def normalised(grid: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values moved linearly from their range to low .. high; to `low` where all are equal. The range is one row."""
    span = grid.agg(F.min("value").alias("_least"), F.max("value").alias("_most"))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0))
    return grid.join(F.broadcast(span)).withColumn("value", F.when(F.col("value").isNotNull(), low + share * (high - low))).drop("_least", "_most")


def sub_grid(grid: DataFrame, lo: tuple[int, ...], hi: tuple[int, ...]) -> DataFrame:
    """Nodes from lo to hi, both included, counted from lo."""
    axes = [c for c in grid.columns if c in ("ix", "iy", "iz")]
    out = grid
    for a, p, q in zip(axes, lo, hi, strict=True):
        out = out.where(F.col(a).between(p, q)).withColumn(a, F.col(a) - p)
    return out


def near(grid: DataFrame, marks: DataFrame, radius: int = 1) -> DataFrame:
    """(ix, iy, near): whether a marked node (ix, iy) lies within `radius` steps on both axes."""
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    reached = marks.select("ix", "iy", F.explode(steps).alias("d")).select((F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"), F.lit(True).alias("near")).distinct()
    return grid.select("ix", "iy").join(reached, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("near", F.lit(False)).alias("near"))


def extremes(grid: DataFrame) -> DataFrame:
    """(ix, iy): local maxima and minima."""
    low = local_maxima(grid.withColumn("value", -F.col("value")))
    return local_maxima(grid).select("ix", "iy").union(low.select("ix", "iy"))


def divergence(vectors: DataFrame, cell: float = 1.0) -> DataFrame:
    """(ix, iy, divergence) of a vector grid (ix, iy, gx, gy), by central differences at nodes with all four neighbours."""
    out = vectors.select("ix", "iy")
    for name, c, by in (("_r", "gx", {"ix": 1}), ("_l", "gx", {"ix": -1}), ("_u", "gy", {"iy": 1}), ("_d", "gy", {"iy": -1})):
        out = out.join(shifted(vectors.select("ix", "iy", F.col(c).alias("value")), name, **by), ["ix", "iy"])
    return out.select("ix", "iy", ((F.col("_r") - F.col("_l") + F.col("_u") - F.col("_d")) / (2 * cell)).alias("divergence"))


def level_box(grid: DataFrame, level: float, tolerance: float) -> DataFrame:
    """One row with lo and hi of the nodes whose value is within a tolerance of a level; nulls without any."""
    axes = [c for c in grid.columns if c in ("ix", "iy", "iz")]
    held = grid.where(F.abs(F.col("value") - level) <= tolerance)
    return held.agg(*(f(a).alias(p + a[1]) for p, f in (("lo", F.min), ("hi", F.max)) for a in axes))


def repaired(grid: DataFrame, invalid) -> DataFrame:
    """Invalid values replaced by the mean of the valid ones among the four neighbours; null without any."""
    bad = F.coalesce(invalid(F.col("value")), F.lit(True))
    held = grid.withColumn("value", F.when(~bad, F.col("value")))
    out = held
    for name, by in (("_r", {"ix": 1}), ("_l", {"ix": -1}), ("_u", {"iy": 1}), ("_d", {"iy": -1})):
        out = out.join(shifted(held, name, **by), ["ix", "iy"], "left")
    four = F.filter(F.array("_r", "_l", "_u", "_d"), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(four, F.lit(0.0), lambda s, v: s + v), F.size(four))
    return out.select("ix", "iy", F.coalesce("value", mean).alias("value"))


def resampled(grid: DataFrame, cell: float, old: float = 1.0) -> DataFrame:
    """(ix, iy, value) at another cell side: the nodes of the new grid in every old cell, by bilinear blends; without those
    that lack a corner. Nodes are made in each cell by itself, so the work follows the new grid's size."""
    first = lambda i: F.ceil(F.col(i) * old / cell - 1e-9)
    last = lambda i: F.ceil((F.col(i) + 1) * old / cell - 1e-9) - 1
    nodes = grid.select("ix", "iy").where((first("ix") <= last("ix")) & (first("iy") <= last("iy")))
    nodes = nodes.select(F.explode(F.sequence(first("ix"), last("ix"))).alias("jx"), first("iy").alias("_a"), last("iy").alias("_b"))
    nodes = nodes.select("jx", F.explode(F.sequence("_a", "_b")).alias("jy"))
    at = nodes.select("jx", "jy", (F.col("jx") * cell).alias("x"), (F.col("jy") * cell).alias("y"))
    return bilinear(grid, at, cell=old).where("sample is not null").select(F.col("jx").alias("ix"), F.col("jy").alias("iy"), F.col("sample").alias("value"))
