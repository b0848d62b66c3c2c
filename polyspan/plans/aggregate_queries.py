"""Folds over clouds and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import fields, grids, mesh, sampling
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6

_BOX = ", ".join(f"{sql6(f'min({k})')} AS lo{k}, {sql6(f'max({k})')} AS hi{k}" for k in "xyz")


@query("bounding_boxes", f"WITH p AS ({B.CLOUD}) SELECT cloud_id, {_BOX}, {sql6('sqrt(' + ' + '.join(f'pow(max({k}) - min({k}), 2)' for k in 'xyz') + ')')} AS diagonal, {sql6('(max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z))')} AS volume FROM p GROUP BY cloud_id")
def bounding_boxes(spark, sf_dir):
    sides = [F.max(k) - F.min(k) for k in "xyz"]
    ends = [r6(f(k)).alias(n + k) for k in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return B.cloud(spark, sf_dir).groupBy("cloud_id").agg(*ends, r6(V.norm(tuple(sides))).alias("diagonal"), r6(sides[0] * sides[1] * sides[2]).alias("volume"))


@query("cloud_centroids", f"WITH p AS ({B.CLOUD}) SELECT cloud_id, count(*) AS n, {', '.join(f'{sql6(f'avg({k})')} AS m{k}' for k in 'xyz')} FROM p GROUP BY cloud_id")
def cloud_centroids(spark, sf_dir):
    return B.cloud(spark, sf_dir).groupBy("cloud_id").agg(F.count("*").alias("n"), *(r6(F.avg(k)).alias("m" + k) for k in "xyz"))


@query("cloud_covariance", f"WITH p AS ({B.CLOUD}) SELECT cloud_id, " + ", ".join(f"{sql6(f'covar_pop({a}, {b})')} AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM p GROUP BY cloud_id")
def cloud_covariance(spark, sf_dir):
    return B.cloud(spark, sf_dir).groupBy("cloud_id").agg(*(r6(F.covar_pop(a, b)).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


_VOX = "CAST(floor(x / 2) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, CAST(floor(z / 2) AS BIGINT) AS iz"


@query("voxel_count", f"WITH p AS ({B.BIG_CLOUD}) SELECT {_VOX}, count(*) AS n, {sql6('min(sqrt(pow(x - floor(x/2)*2, 2) + pow(y - floor(y/2)*2, 2) + pow(z - floor(z/2)*2, 2)))')} AS distance FROM p GROUP BY 1, 2, 3")
def voxel_count(spark, sf_dir):
    return grids.voxels(B.big_cloud(spark, sf_dir), 2.0).withColumn("distance", r6(F.col("distance")))


@query("voxel_centroids", f"WITH p AS ({B.BIG_CLOUD}) SELECT {_VOX}, {', '.join(f'round(avg({k}), 8) AS m{k}' for k in 'xyz')} FROM p GROUP BY 1, 2, 3")
def voxel_centroids(spark, sf_dir):
    key = [F.floor(F.col(k) / 2).cast("long").alias("i" + k) for k in "xyz"]
    return B.big_cloud(spark, sf_dir).groupBy(*key).agg(*(F.round(F.avg(k), 8).alias("m" + k) for k in "xyz"))


@query("voxel_outline", f"WITH p AS ({B.BIG_CLOUD}), c AS (SELECT DISTINCT {_VOX} FROM p) SELECT * FROM c a WHERE (SELECT count(*) FROM c b WHERE abs(a.ix-b.ix) + abs(a.iy-b.iy) + abs(a.iz-b.iz) = 1) < 6")
def voxel_outline(spark, sf_dir):
    return fields.outline(B.big_cloud(spark, sf_dir), 2.0).select(*(F.col("c" + k).cast("long").alias("i" + k) for k in "xyz"))


@query("value_histogram", """SELECT CAST(greatest(0, least(31, floor((CAST(value AS DOUBLE) - 0) / (500.0 / 32)))) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def value_histogram(spark, sf_dir):
    return fields.histogram(B.table(spark, sf_dir, "events").select(F.col("value").cast("double").alias("value")), "value", 32, 0.0, 500.0)


_HASH = "CAST(('0x' || substr(md5(concat_ws(':', CAST(pid AS VARCHAR), '{seed}')), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("uniform_sample", f"WITH p AS ({B.CLOUD}) SELECT pid, {sql6('x')} AS x FROM p ORDER BY {_HASH.format(seed=3)}, pid LIMIT 40")
def uniform_sample(spark, sf_dir):
    return sampling.uniform(B.cloud(spark, sf_dir), 40, seed=3).select("pid", r6(F.col("x")).alias("x"))


@query("fraction_sample", f"WITH p AS ({B.CLOUD}) SELECT pid FROM p WHERE {_HASH.format(seed=5)} < 0.25")
def fraction_sample(spark, sf_dir):
    return sampling.fraction(B.cloud(spark, sf_dir), 0.25, seed=5).select("pid")


@query("stratified_sample", f"WITH p AS ({B.CLOUD}) SELECT cloud_id, pid FROM p QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY {_HASH.format(seed=0)}, pid) <= 5")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(B.cloud(spark, sf_dir), "cloud_id", 5).select("cloud_id", "pid")


@query("weighted_sample", f"WITH p AS ({B.CLOUD}) SELECT pid FROM p WHERE abs(x) > 0 ORDER BY round(ln(greatest({_HASH.format(seed=9)}, 1e-300)) / abs(x), 9) DESC, pid LIMIT 30")
def weighted_sample(spark, sf_dir):
    return sampling.weighted(B.cloud(spark, sf_dir).withColumn("w", F.abs("x")), "w", 30, seed=9).select("pid")


@query("sequential_sample", f"WITH p AS ({B.CLOUD}) SELECT pid, cloud_id FROM p WHERE pid % 7 = 0")
def sequential_sample(spark, sf_dir):
    return sampling.every_nth(B.cloud(spark, sf_dir), 7).select("pid", "cloud_id")


@query("plane_slice", f"WITH p AS ({B.CLOUD}), o AS (SELECT pid, (x - 0.1) * 0.6 + (y + 0.2) * 0.8 AS off FROM p) SELECT pid, {sql6('off')} AS offset_ FROM o WHERE abs(off) <= 0.3")
def plane_slice(spark, sf_dir):
    return sampling.slice_plane(B.cloud(spark, sf_dir), (0.1, -0.2, 0.0), (0.6, 0.8, 0.0), 0.3).select("pid", r6(F.col("offset")).alias("offset_"))


@query("mesh_measures", f"WITH {B.MESH}, m AS (SELECT 0.5 * sqrt(pow((by-ay)*(cz-az) - (bz-az)*(cy-ay), 2) + pow((bz-az)*(cx-ax) - (bx-ax)*(cz-az), 2) + pow((bx-ax)*(cy-ay) - (by-ay)*(cx-ax), 2)) AS area, (ay*bz-az*by)*cx + (az*bx-ax*bz)*cy + (ax*by-ay*bx)*cz AS six, (ax+bx+cx)/3 AS x, (ay+by+cy)/3 AS y, (az+bz+cz)/3 AS z FROM tris) SELECT CAST(0 AS BIGINT) AS mesh_id, round(sum(area), 4) AS area, round(abs(sum(six) / 6), 4) AS volume, {', '.join(f'{sql6(f'sum(area * {k}) / sum(area)')} AS c{k}' for k in 'xyz')} FROM m")
def mesh_measures(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.measures(f, v).select("mesh_id", F.round("area", 4).alias("area"), F.round("volume", 4).alias("volume"), *(r6(F.col("c" + k)).alias("c" + k) for k in "xyz"))
