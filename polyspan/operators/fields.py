"""Distance fields, Hausdorff distances and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .joins import around, celled, knn_join


def cloud_field(points: DataFrame, cell: float, reach: int = 2, axes: str = "xyz", by: list[str] = ()) -> DataFrame:
    """(`by`, i + axis, value): the distance to the nearest point, at all grid nodes within `reach` cells of a point, exact
    up to that many cells."""
    near = around(points, cell, reach, axes).select(*by, "pid", *axes, *(F.col("c" + k).alias("i" + k) for k in axes))
    node = tuple(F.col("i" + k) * cell for k in axes)
    return near.groupBy(*by, *("i" + k for k in axes)).agg(F.min(V.distance(node, tuple(F.col(k) for k in axes))).alias("value"))


def directed_hausdorff(left: DataFrame, right: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """One row (distance): the largest distance from a point of `left` to its nearest of `right`. Ids must differ
    between both clouds."""
    return knn_join(left, right, 1, cell, axes).agg(F.max("d").alias("distance"))


def hausdorff_pairs(points: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """(a, b, distance): the Hausdorff distance of all pairs of clouds (cloud_id), a < b. Every point seeks its nearest
    neighbour in each other cloud, so work grows with points times clouds."""
    names = [r[0] for r in points.select("cloud_id").distinct().orderBy("cloud_id").collect()]  # a value a cloud
    goals = F.explode(F.array(*[F.lit(n) for n in names]))
    left = points.withColumn("target", goals).where("target <> cloud_id").select("target", "pid", *axes)
    near = knn_join(left, points.withColumnRenamed("cloud_id", "target"), 1, cell, axes, ["target"])
    each = near.join(points.select("pid", "cloud_id"), "pid")
    return each.groupBy(F.least("cloud_id", "target").alias("a"), F.greatest("cloud_id", "target").alias("b")).agg(F.max("d").alias("distance"))


def histogram(values: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): equal bins from low to high, the last one closed; what lies outside counts in the first or last."""
    at = F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int")
    return values.where(F.col(column).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).agg(F.count("*").alias("n"))


def outline(points: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """Occupied cells with an empty face neighbour."""
    own = celled(points, cell, axes).select(*("c" + k for k in axes)).distinct()
    steps = F.array(*[F.struct(*(F.lit(d if j == i else 0).alias("d" + k) for j, k in enumerate(axes))) for i in range(len(axes)) for d in (-1, 1)])
    near = own.withColumn("_s", F.explode(steps)).select(*(F.col("c" + k).alias("h" + k) for k in axes), *((F.col("c" + k) + F.col("_s.d" + k)).alias("c" + k) for k in axes))
    found = near.join(own, ["c" + k for k in axes]).groupBy(*("h" + k for k in axes)).agg(F.count("*").alias("_n"))
    full = found.where(F.col("_n") == 2 * len(axes)).select(*(F.col("h" + k).alias("c" + k) for k in axes))
    return own.join(full, ["c" + k for k in axes], "left_anti")
