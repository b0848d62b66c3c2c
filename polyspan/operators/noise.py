"""Gradient noise, its octaves and terrain.

The gradient of a lattice corner is one of the twelve edges of a cube, chosen by a permutation polynomial modulo 289, so
that no table is needed and other engines compute the same. Noise repeats after 289 cells. Each step is a projection of
its own, as one nested expression would repeat its parts thousands of times.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The polynomial (34 x + 1) x mod 289 permutes 0 .. 288.
FACTOR, PERIOD = 34, 289


def _slope(h: Column, way: list[Column]) -> Column:
    """The product of a corner's gradient with the way from the corner: two of the axes, each with its sign."""
    p = F.when(h >= 8, way[1]).otherwise(way[0])
    q = F.when(h < 4, way[1]).otherwise(way[2])
    return F.when(F.pmod(h, F.lit(2)) == 1, -p).otherwise(p) + F.when(F.pmod(h, F.lit(4)) >= 2, -q).otherwise(q)


def gradient_noise(df: DataFrame, name: str, x: Column, y: Column, z: Column, seed: int = 0) -> DataFrame:
    """The rows with the column `name`: smooth noise of about -1 to 1 at (x, y, z) that is zero on the integer lattice; null
    where a coordinate is null."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    out = df.select(*kept, *(v.cast("double").alias("_p" + k) for k, v in zip("xyz", (x, y, z), strict=True)))
    out = out.select(*kept, *(F.floor("_p" + k).alias("_c" + k) for k in "xyz"), *((F.col("_p" + k) - F.floor("_p" + k)).alias("_f" + k) for k in "xyz"))
    hashes = {"": F.lit(seed % PERIOD).cast("long")}
    places, parts = [F.col("_c" + k) for k in "xyz"], [F.col("_f" + k) for k in "xyz"]
    for axis in range(3):
        raw = {c + d: F.pmod(h + places[axis] + int(d), F.lit(PERIOD)) for c, h in hashes.items() for d in "01"}
        out = out.select(*kept, *places, *parts, *(h.alias("_r" + c) for c, h in raw.items()))
        hashes = {c: F.col("_h" + c) for c in raw}
        out = out.select(*kept, *places, *parts, *(F.pmod((F.col("_r" + c) * FACTOR + 1) * F.col("_r" + c), F.lit(PERIOD)).alias("_h" + c) for c in raw))
    eased = [(t * t * t * (t * (t * 6 - 15) + 10)).alias("_e" + k) for t, k in zip(parts, "xyz", strict=True)]
    out = out.select(*kept, *parts, *eased, *(F.pmod(h, F.lit(12)).alias("_h" + c) for c, h in hashes.items()))
    ease = [F.col("_e" + k) for k in "xyz"]
    out = out.select(*kept, *ease, *(_slope(h, [f - int(d) for f, d in zip(parts, c, strict=True)]).alias("_s" + c) for c, h in hashes.items()))
    for axis in (2, 1, 0):
        blend = [((1 - ease[axis]) * F.col(f"_s{c}0") + ease[axis] * F.col(f"_s{c}1")).alias("_s" + c if c else name) for c in map("".join, itertools.product("01", repeat=axis))]
        out = out.select(*kept, *ease[:axis], *blend)
    return out


def octaves(df: DataFrame, name: str, x: Column, y: Column, z: Column, n: int, gain: float = 0.5, lacunarity: float = 2.0, kind: str = "plain", offset: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows with the column `name`: noise of n frequencies, each `lacunarity` times the one before and weighted by `gain`
    as much. `turbulence` adds up sizes; `ridge` the squares of `offset` less the size, each times the one before, the
    first weighted by a half. With `plain` all octaves share the seed, otherwise each has its own."""
    if kind not in ("plain", "fbm", "turbulence", "ridge"):
        raise ValueError(f"no such kind of noise: {kind}")
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    out = df.select(*kept, *(v.cast("double").alias("_o" + k) for k, v in zip("xyz", (x, y, z), strict=True)), F.lit(0.0).alias("_sum"), F.lit(1.0).alias("_last"))
    weight, frequency = 0.5 if kind == "ridge" else 1.0, 1.0
    for i in range(n):
        out = gradient_noise(out, "_noise", *(F.col("_o" + k) * frequency for k in "xyz"), seed if kind == "plain" else seed + i)
        value = F.col("_noise") * weight
        if kind == "turbulence":
            value = F.abs(value)
        elif kind == "ridge":
            out = out.withColumn("_noise", F.pow(offset - F.abs("_noise"), F.lit(2.0)))
            value = F.col("_noise") * weight * F.col("_last")
        out = out.withColumn("_sum", F.col("_sum") + value).withColumn("_last", F.col("_noise") if kind == "ridge" else F.col("_last")).drop("_noise")
        weight, frequency = weight * gain, frequency * lacunarity
    return out.select(*kept, F.col("_sum").alias(name))


def elevated(points: DataFrame, scale: float, n: int, persistence: float, lacunarity: float, low: float, high: float, seed: int = 0) -> DataFrame:
    """Points (x, y, ..) with z: plain octaves over the plane, -1 to 1 mapped to `low` to `high`."""
    out = octaves(points, "z", F.col("x") / scale, F.col("y") / scale, F.lit(0.0), n, persistence, lacunarity, seed=seed)
    return out.withColumn("z", low + (high - low) * (F.col("z") * 0.5 + 0.5))
