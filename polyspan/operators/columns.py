"""Fields of upright capsules: the columns that hold a sheet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, drop
from .order import numbered

#: Where there is no column.
NONE = 1e9


#: Columns of the first class, which every line is held against.
FIRST = 16


def _within(lines: DataFrame, columns: DataFrame, cell: float) -> DataFrame:
    """Lines (x, y, known) with the columns (px, py, h) whose squared distance may be under `known`: in cells of the power of two
    next to each line's distance, one grid for each of these powers."""
    level = F.ceil(F.log2(F.greatest(F.sqrt("known") * (1 + 1e-9), F.lit(float(cell))))).cast("int")
    asked = lines.withColumn("level", level)
    levels = [r.level for r in asked.select("level").distinct().collect()]  # a power of two up to the box's side each
    side = F.pow(F.lit(2.0), F.col("level"))
    place = lambda k: F.floor(F.col(k) / side).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = asked.withColumn("_s", F.explode(steps)).select("ix", "iy", "x", "y", "known", "level", (place("x") + F.col("_s.i")).alias("cx"), (place("y") + F.col("_s.j")).alias("cy"))
    dealt = columns.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select("px", "py", "h", "level", place("px").alias("cx"), place("py").alias("cy"))
    return asked.join(dealt.hint("merge"), ["level", "cx", "cy"])


def _front(near: DataFrame, by: list[str]) -> DataFrame:
    """Of the columns near a line of nodes those that are not both farther from it and no higher than another."""
    order = Window.partitionBy(*by).orderBy("d2", F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("_top", F.max("h").over(order)).where(F.col("_top").isNull() | (F.col("h") > F.col("_top"))).drop("_top")


def support_field(spark: SparkSession, columns: DataFrame, low: tuple, high: tuple, cell: float, level: float, reach: int = 4) -> DataFrame:
    """(ix, iy, iz, value): the signed distance to the nearest of upright capsules, at all nodes low + i * cell of the box.

    A column (x, y, weight) within the box stands at a tenth of the box's height under `level` (0 to 1, a part of that
    height), and is as high as its weight (0 to 1) times what is left above; its radius is a fortieth of the wider side of
    the box. Columns outside the box, with a weight outside 0 to 1 or with nulls are left out; without any, all values are
    1e9. All upright nodes over one place are a line: of the columns those count for it that are nearer than all higher ones,
    which are sought from the highest down. `reach` is no longer needed for that and changes nothing."""
    sides = [b - a for a, b in zip(low, high, strict=True)]
    if min(sides) <= cell:
        raise ValueError("the box must be wider than a cell")
    if not 0 <= level <= 1:
        raise ValueError("level must be 0 to 1")
    nx, ny, nz = (math.floor(s / cell + 1e-9) + 1 for s in sides)
    radius, base = 0.025 * max(sides[:2]), low[2] + (level - 0.1) * sides[2]
    kept = columns.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("weight").between(0, 1))
    kept = kept.groupBy("x", "y").agg((F.max("weight") * (high[2] - base)).alias("h"))
    kept = cut(kept.select(F.xxhash64("x", "y").alias("pid"), "x", "y", "h"))
    lines = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    tallest = kept.agg(F.max("h")).first()[0]
    heights = F.sequence(F.lit(0).cast("long"), F.lit(nz - 1).cast("long"))
    if tallest is None:
        return lines.select("ix", "iy", F.explode(heights).alias("iz"), F.lit(NONE).alias("value"))
    off = lambda i, h: F.greatest(base - (low[2] + i * cell), low[2] + i * cell - base - h, F.lit(0.0))
    # Columns in classes by height, the tallest few first and each class four times the one before. In a class only those
    # count that are nearer to a line than all taller classes': few, wherever the line is.
    ranked = kept.select("x", "y", "h", (-F.col("h")).alias("_low"))
    ranked = cut(numbered(ranked, ["_low", "x", "y"], "rank").drop("_low"))
    n, start, size = ranked.count(), 0, FIRST
    lines = cut(lines.select("ix", "iy", (low[0] + F.col("ix") * cell).alias("x"), (low[1] + F.col("iy") * cell).alias("y")))
    near, parts = lines.withColumn("known", F.lit(float("inf"))), []
    while start < n:
        some = ranked.where((F.col("rank") >= start) & (F.col("rank") < start + size)).select(F.col("x").alias("px"), F.col("y").alias("py"), "h")
        met = lines.withColumn("known", F.lit(float("inf"))).crossJoin(some) if start == 0 else _within(near, some, cell)
        dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        met = met.select("ix", "iy", "known", (dx * dx + dy * dy).alias("d2"), "h").where(F.col("d2") < F.col("known"))
        parts.append(cut(_front(met.drop("known"), ["ix", "iy"])))
        nearest = parts[-1].groupBy("ix", "iy").agg(F.min("d2").alias("_d2"))
        before, near = near, cut(near.join(nearest.hint("merge"), ["ix", "iy"], "left").withColumn("known", F.least("known", "_d2")).drop("_d2"))
        drop(before)
        start, size = start + size, 4 * size
    front = parts[0]
    for p in parts[1:]:
        front = front.unionByName(p)
    fronts = _front(front, ["ix", "iy"]).groupBy("ix", "iy").agg(F.collect_list(F.struct("d2", "h")).alias("front"))
    raw = lambda i: F.array_min(F.transform("front", lambda c: F.sqrt(c.d2 + off(i, c.h) * off(i, c.h))))
    values = fronts.select("ix", "iy", F.explode(heights).alias("iz"), "front")
    return values.select("ix", "iy", "iz", (raw(F.col("iz")) - radius).alias("value"))
