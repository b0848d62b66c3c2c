"""Spatial joins on a grid of cells.

Points are keyed by cell, a neighbourhood is a set of cells, and every join is an equality join on cells followed by
the exact test, so Spark deals the work out by cell. A cell that is crowded is split by salting one side and
replicating the other (`salted`), in proportion to its count.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .lineage import cut


def celled(points: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    return points.select("*", *(F.floor(F.col(k) / cell).alias("c" + k) for k in axes))


def around(points: DataFrame, cell: float, reach: int = 1, axes: str = "xyz") -> DataFrame:
    """Each point once for every cell within `reach` of its own."""
    steps = F.array(*[F.struct(*(F.lit(d).alias("d" + k) for k, d in zip(axes, ds, strict=True))) for ds in itertools.product(range(-reach, reach + 1), repeat=len(axes))])
    out = celled(points, cell, axes).withColumn("_step", F.explode(steps))
    return out.select(*points.columns, *((F.col("c" + k) + F.col("_step.d" + k)).alias("c" + k) for k in axes))


def salted(queries: DataFrame, points: DataFrame, keys: list[str], most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _salt: points of a cell with over `most` of them are dealt to several salts, queries go
    to all salts of their cell."""
    crowded = points.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_n"))
    deal = points.join(crowded, keys, "left").withColumn("_salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.hash("pid"), F.col("_n")))).drop("_n")
    copy = queries.join(crowded, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n")
    return copy, deal


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", by: list[str] = (), apart: str | None = None) -> DataFrame:
    """(`by`, pid, other, d): all pairs nearer than or at `radius`; pid of `left`, other of `right`. With `apart`, only
    pairs that differ in that column."""
    keys = [*by, *("c" + k for k in axes)]
    more = [apart] if apart else []
    q = around(left.select(*by, "pid", *axes, *more), radius, 1, axes)
    p = celled(right.select(*by, "pid", *axes, *more), radius, axes)
    q, p = salted(q, p, keys)
    p = p.select(*keys, "_salt", F.col("pid").alias("other"), *(F.col(k).alias("o" + k) for k in axes), *(F.col(c).alias("_apart") for c in more))
    d = V.distance(V.vec("", axes), V.vec("o", axes))
    # merged at any size: what is exploded here is larger than the planner takes it for, and would be sent whole to the driver
    pairs = q.join(p.hint("merge"), [*keys, "_salt"])
    return (pairs.where(F.col(apart) != F.col("_apart")) if apart else pairs).select(*by, "pid", "other", d.alias("d")).where(F.col("d") <= radius)


def extent(*clouds: DataFrame, axes: str = "xyz") -> float:
    """The longest side of the box around all points (one row a cloud to the driver); 0 without points."""
    ends = [c.agg(*(F.max(k).alias("hi" + k) for k in axes), *(F.min(k).alias("lo" + k) for k in axes)).first() for c in clouds]
    ends = [e for e in ends if e["lo" + axes[0]] is not None]
    return max((max(e["hi" + k] for e in ends) - min(e["lo" + k] for e in ends) for k in axes), default=0.0) if ends else 0.0


def knn_join(left: DataFrame, right: DataFrame, k: int, cell: float, axes: str = "xyz", by: list[str] = (), apart: str | None = None) -> DataFrame:
    """(`by`, pid, other, d, rank): the k nearest of `right` for each of `left`, ties by the smaller id, a point
    being no neighbour of itself; with `apart`, of those alone that differ in that column. Each round doubles the cells
    for those queries whose k-th neighbour is not yet within the covered radius, until the cells cover all points."""
    more = [apart] if apart else []
    open_, done = left.select(*by, "pid", *axes, *more), None
    order = Window.partitionBy(*by, "pid").orderBy("d", "other")
    size, whole = cell, extent(left, right, axes=axes) * len(axes) ** 0.5
    while True:
        near = radius_join(open_, right, size, axes, by, apart).where("pid <> other")
        ranked = cut(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if size > whole:  # whoever has fewer than k now has no more
            return ranked if done is None else done.unionByName(ranked)
        full = ranked.groupBy(*by, "pid").count().where(F.col("count") >= k).select(*by, "pid")
        found = ranked.join(full, [*by, "pid"], "left_semi")
        rest = cut(open_.join(full, [*by, "pid"], "left_anti"))
        done = found if done is None else done.unionByName(found)
        if rest.isEmpty():
            return done
        open_, size = rest, 2 * size


def box_join(boxes: DataFrame, points: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """(bid, pid): points in closed boxes (bid, lo + axis, hi + axis); a box is replicated to the cells that it touches."""
    spans = boxes
    for k in axes:
        spans = spans.withColumn("c" + k, F.explode(F.sequence(F.floor(F.col("lo" + k) / cell), F.floor(F.col("hi" + k) / cell))))
    keys = ["c" + k for k in axes]
    inside = F.lit(True)
    for k in axes:
        inside = inside & F.col(k).between(F.col("lo" + k), F.col("hi" + k))
    spans, dealt = salted(spans, celled(points.select("pid", *axes), cell, axes), keys)
    return spans.join(dealt, [*keys, "_salt"]).where(inside).select("bid", "pid")


def box_pairs(boxes: DataFrame, cell: float, axes: str = "xyz") -> DataFrame:
    """(a, b): pairs of closed boxes (bid, lo, hi) that meet, a < b. A pair is kept only in the cell of the lower corner
    of its overlap, so no pair comes twice."""
    spans = boxes
    for k in axes:
        spans = spans.withColumn("c" + k, F.explode(F.sequence(F.floor(F.col("lo" + k) / cell), F.floor(F.col("hi" + k) / cell))))
    keys = ["c" + k for k in axes]
    other = spans.select(*keys, F.col("bid").alias("b"), *(F.col(e + k).alias("o" + e + k) for e in ("lo", "hi") for k in axes))
    meet, own = F.col("bid") < F.col("b"), F.lit(True)
    for k in axes:
        meet = meet & (F.col("lo" + k) <= F.col("ohi" + k)) & (F.col("olo" + k) <= F.col("hi" + k))
        own = own & (F.col("c" + k) == F.floor(F.greatest("lo" + k, "olo" + k) / cell))
    other, dealt = salted(other, spans.withColumn("pid", F.col("bid")), keys)
    return dealt.join(other, [*keys, "_salt"]).where(meet & own).select(F.col("bid").alias("a"), "b")


def suggested_cell(points: DataFrame, per_cell: int = 8, axes: str = "xyz") -> float:
    """A cell side for about `per_cell` points a cell, from the box and the count (one row to the driver)."""
    row = points.agg(F.count("*").alias("n"), *(F.max(k).alias("hi" + k) for k in axes), *(F.min(k).alias("lo" + k) for k in axes)).first()
    if not row["n"]:
        return 1.0
    sides = [max(row["hi" + k] - row["lo" + k], 1e-9) for k in axes]
    return max((math.prod(sides) * per_cell / row["n"]) ** (1 / len(axes)), 1e-9)
