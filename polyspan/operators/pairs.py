"""The two points of a cloud that are farthest apart, by pruning pairs of cells.

Extreme points over directions give a distance that is reached; whatever cannot reach it goes. The points left are put in
cells, and pairs of cells are halved and pruned until few pairs of points are left. No bound is an estimate, so the result
is exact.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .lineage import cut

_DEEPEST = 40


def _ways(n: int) -> list[tuple[int, ...]]:
    return [w for w in itertools.product((-1, 0, 1), repeat=n) if w > (0,) * n]


def _placed(points: DataFrame, key: str, axes: str) -> DataFrame:
    """One row a place, with its smallest and largest id and the number of its rows."""
    whole = F.lit(True)
    for k in axes:
        whole = whole & F.col(k).isNotNull() & ~F.isnan(k)
    return points.where(whole).groupBy(F.col(key), *(F.col(k).cast("double").alias(k) for k in axes)).agg(F.min("pid").alias("pid"), F.max("pid").alias("_last"), F.count("*").alias("_n"))


def _known(places: DataFrame, key: str, axes: str) -> DataFrame:
    """A row a cloud: its box, a distance that two of its points have (`low`), and the radius around the box's middle."""
    at = F.struct(*axes)
    along = [sum((F.col(k) * d for k, d in zip(axes, w, strict=True)), F.lit(0.0)) for w in _ways(len(axes))]
    ends = [f(at, a).alias(f"{n}{i}") for i, a in enumerate(along) for n, f in (("_p", F.max_by), ("_q", F.min_by))]
    box = [f(k).alias(n + k) for k in axes for n, f in (("lo", F.min), ("hi", F.max))]
    out = places.groupBy(key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_places"), F.min("pid").alias("_first"), F.max("_last").alias("_last"), *box, *ends)
    reached = [V.distance(tuple(F.col(f"_p{i}.{k}") for k in axes), tuple(F.col(f"_q{i}.{k}") for k in axes)) for i in range(len(along))]
    out = cut(out.select(key, "_n", "_places", "_first", "_last", *(n + k for k in axes for n in ("lo", "hi")), F.greatest(*reached).alias("low"), F.greatest(*(F.col("hi" + k) - F.col("lo" + k) for k in axes)).alias("side")))
    return out.join(places.join(out, key).groupBy(key).agg(F.max(_from_middle(axes)).alias("radius")), key)


def _from_middle(axes: str) -> Column:
    return V.distance(V.vec("", axes), tuple((F.col("lo" + k) + F.col("hi" + k)) / 2 for k in axes))


def _in_cells(points: DataFrame, level: int, axes: str) -> DataFrame:
    top = 2**level
    return points.select("*", *(F.least(F.floor(F.col("u" + k) * float(top)), F.lit(top - 1)).cast("long").alias("c" + k) for k in axes))


def narrowed(points: DataFrame, key: str, axes: str = "xyz", enough: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, candidates, pairs): a row a cloud, the points that may be an end with their cell, and the pairs of cells that may
    hold both ends. Cells are halved until the pairs of points between them are at most `enough` or eight times the
    candidates, or no cell holds two points."""
    places = cut(_placed(points, key, axes))
    known = cut(_known(places, key, axes))
    far = V.norm(tuple(F.greatest(F.col(k) - F.col("lo" + k), F.col("hi" + k) - F.col(k)) for k in axes))
    bound = F.least(far, _from_middle(axes) + F.col("radius")) * (1 + 1e-12)
    kept = places.join(known.drop("_n", "_last"), key).where((F.col("_places") > 1) & (bound >= F.col("low")))
    kept = cut(kept.select(key, "pid", *axes, *(((F.col(k) - F.col("lo" + k)) / F.col("side")).alias("u" + k) for k in axes)))
    count, level = kept.count(), 0
    low = known.select(key, "low")
    same = F.lit(True)
    for k in axes:
        same = same & (F.col("a" + k) == F.col("b" + k))
    pairs = known.where("_places > 1").select(key, *(F.lit(0).cast("long").alias(p + k) for p in "ab" for k in axes))
    while True:
        level += 1
        cells = _in_cells(kept, level, axes).groupBy(key, *("c" + k for k in axes)).agg(F.count("*").alias("n"), F.max(F.struct(*axes)).alias("at"), *(f(k).alias(n + k) for k in axes for n, f in (("lo", F.min), ("hi", F.max))))
        side = lambda p: cells.select(key, *(F.shiftright("c" + k, 1).alias(p + k) for k in axes), F.struct(*(F.col("c" + k) for k in axes)).alias(p + "c"), *(F.col(c).alias(p + c) for c in ("n", "at", *("lo" + k for k in axes), *("hi" + k for k in axes))))
        met = pairs.join(side("a"), [key, *("a" + k for k in axes)]).join(side("b"), [key, *("b" + k for k in axes)]).where(~same | (F.col("ac") <= F.col("bc"))).join(low, key)
        most = V.norm(tuple(F.greatest(F.col("ahi" + k) - F.col("blo" + k), F.col("bhi" + k) - F.col("alo" + k)) for k in axes))
        reached = V.distance(tuple(F.col("aat." + k) for k in axes), tuple(F.col("bat." + k) for k in axes))
        met = cut(met.select(key, "ac", "bc", "an", "bn", most.alias("most"), reached.alias("reached"), "low").where("most >= low"))
        low = cut(met.groupBy(key).agg(F.greatest(F.max("low"), F.max("reached")).alias("low")))
        pairs = met.drop("low").join(low, key).where("most >= low")
        pairs = cut(pairs.select(key, *(F.col(f"{p}c.c{k}").alias(p + k) for p in "ab" for k in axes), (F.col("an").cast("double") * F.col("bn")).alias("n")))
        work, rows = pairs.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.count("*")).first()
        pairs = pairs.drop("n")
        if work <= max(enough, 8 * count) or work <= rows or level == _DEEPEST:
            return known, _in_cells(kept, level, axes), pairs


def farthest_pairs(points: DataFrame, by: str | None = None, axes: str = "xyz") -> DataFrame:
    """(`by`, pid, other, d): the two points (pid, axes) of each cloud that are farthest apart, pid < other; ties by the
    smaller ids. Points at one place count as that with the smallest id, but in a cloud of one place the smallest and the
    largest id are told with d = 0. A cloud of a single row has none; rows with a coordinate that is null or NaN are left
    out, and without points there are no rows."""
    key = by or "_all"
    known, kept, pairs = narrowed(points if by else points.withColumn("_all", F.lit(0)), key, axes)
    end = lambda p: kept.select(key, *(F.col("c" + k).alias(p + k) for k in axes), F.col("pid").alias(p + "pid"), *(F.col(k).alias(p + "_" + k) for k in axes))
    met = pairs.join(end("a"), [key, *("a" + k for k in axes)]).join(end("b"), [key, *("b" + k for k in axes)])
    d = V.distance(tuple(F.col("a_" + k) for k in axes), tuple(F.col("b_" + k) for k in axes))
    best = met.where(d > 0).groupBy(key).agg(F.min(F.struct((-d).alias("d"), F.least("apid", "bpid").alias("pid"), F.greatest("apid", "bpid").alias("other"))).alias("m"))
    found = known.where("_n > 1").join(best, key, "left")
    out = found.select(key, F.coalesce("m.pid", "_first").alias("pid"), F.coalesce("m.other", "_last").alias("other"), F.coalesce(-F.col("m.d"), F.lit(0.0)).alias("d"))
    return out if by else out.drop(key)
