"""Samples by a hash of the id: the same for the same ids, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .joins import radius_join
from .lineage import cut, drop


def unit_hash(*ids: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from ids: 13 hex digits of an MD5, which other engines compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[i.cast("string") for i in ids], F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n points with the smallest hash: a top-n, which every partition cuts before anything is shuffled."""
    return points.withColumn("u", unit_hash(F.col("pid"), seed=seed)).orderBy("u", "pid").limit(n)


def fraction(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    return points.where(unit_hash(F.col("pid"), seed=seed) < share)


def weighted(points: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n points with probability by weight, without replacement: the largest log(u) / weight (Efraimidis and Spirakis)."""
    key = F.log(F.greatest(unit_hash(F.col("pid"), seed=seed), F.lit(1e-300))) / F.col(weight)
    return points.where(F.col(weight) > 0).withColumn("priority", key).orderBy(F.desc("priority"), "pid").limit(n)


def every_nth(points: DataFrame, n: int) -> DataFrame:
    """Ids 0, n, 2n .. of consecutive ids."""
    return points.where(F.pmod("pid", F.lit(n)) == 0)


def stratified(points: DataFrame, by: str, n: int, seed: int = 0) -> DataFrame:
    order = Window.partitionBy(by).orderBy(unit_hash(F.col("pid"), seed=seed), "pid")
    return points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: Points that are decided in the first step of `poisson_disc`; each further step takes twice as many.
FIRST = 4096


def poisson_disc(points: DataFrame, radius: float, axes: str = "xyz", seed: int = 0, by: list[str] = ()) -> DataFrame:
    """A maximal subset (of each group `by`) with no two points within `radius`: points in the order of their hash are taken
    unless one within the radius has been. That is decided in steps of points that are next in order, each of as many as all
    before: within one, points of the smallest hash among their open neighbours are taken and their neighbours dropped until
    none is open; then all open points near a taken one go. So pairs are formed among few points of the whole place at first,
    and later among those alone that no taken one is near."""
    key = [*by, "pid"]
    rest = cut(points.select(*key, *axes, unit_hash(*(F.col(k) for k in key), seed=seed).alias("u")).where(F.col("u").isNotNull()))
    taken, reached, size, n = None, 0.0, FIRST, rest.count()
    while n:
        reached = 1.0 if size >= n else reached + (1.0 - reached) * size / n
        open_ = batch = cut(rest.where(F.col("u") <= reached))
        pairs = cut(radius_join(batch, batch, radius, axes, by).where("pid <> other").select(*key, "other"))
        won = None
        while not open_.isEmpty():
            live = pairs.join(open_.select(*by, F.col("pid").alias("other"), F.col("u").alias("ou")), [*by, "other"]).join(open_, key)
            beaten = live.where((F.col("ou") < F.col("u")) | ((F.col("ou") == F.col("u")) & (F.col("other") < F.col("pid")))).select(*key).distinct()
            first = cut(open_.join(beaten, key, "left_anti").select(*key, *axes))
            won = first if won is None else won.unionByName(first)
            dead = pairs.join(first.select(*key), key).select(*by, F.col("other").alias("pid")).distinct()
            before, open_ = open_, cut(open_.join(first, key, "left_anti").join(dead, key, "left_anti"))
            if before is not batch:
                drop(before)
        taken = (won if taken is None else taken.unionByName(won)) if won is not None else taken
        later, old = rest.where(F.col("u") > reached), rest
        if won is not None:
            near = radius_join(won, later, radius, axes, by).select(*by, F.col("other").alias("pid")).distinct()
            later = later.join(near, key, "left_anti")
        rest = cut(later)
        drop(old, pairs, batch)
        n, size = rest.count(), 2 * size
    if taken is None:
        return points.limit(0)
    return points.join(taken.select(*key).hint("merge"), key, "left_semi")


def nearest_spacing(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pid, d): the distance to the nearest other point, from joined pairs."""
    return pairs.where("pid <> other").groupBy("pid").agg(F.min("d").alias("d"))


def slice_plane(points: DataFrame, origin: tuple[float, ...], normal: tuple[float, ...], tolerance: float) -> DataFrame:
    """Points within a tolerance of a plane with a unit normal."""
    off = V.dot(V.minus(V.vec(""), tuple(F.lit(float(o)) for o in origin)), tuple(F.lit(float(n)) for n in normal))
    return points.withColumn("offset", off).where(F.abs("offset") <= tolerance)
