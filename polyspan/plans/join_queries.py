"""Spatial joins; the twins compare all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import fields, fixpoint, joins, sampling
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6

P = f"WITH p AS ({B.CLOUD})"
D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


@query("radius_join", f"{P} SELECT a.pid, b.pid AS other, {sql6(D)} AS d FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid < b.pid WHERE {D} <= 0.5")
def radius_join(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    return joins.radius_join(p, p, 0.5, by=["cloud_id"]).where("pid < other").select("pid", "other", r6(F.col("d")).alias("d"))


@query("knn_join", f"{P} SELECT a.pid, b.pid AS other, {sql6(D)} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D}, b.pid) AS rank FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid <> b.pid QUALIFY rank <= 3")
def knn_join(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    cell = joins.suggested_cell(p, 80)
    return joins.knn_join(p, p, 3, cell, by=["cloud_id"]).select("pid", "other", r6(F.col("d")).alias("d"), F.col("rank").cast("long").alias("rank"))


@query("nearest_other_cloud", f"{P} SELECT a.pid, b.pid AS other, {sql6(D)} AS d FROM p a JOIN p b ON b.cloud_id <> a.cloud_id QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY {D}, b.pid) = 1")
def nearest_other_cloud(spark, sf_dir):
    """The nearest point of any other cloud, for every point."""
    p = B.cloud(spark, sf_dir)
    return joins.knn_join(p, p, 1, joins.suggested_cell(p, 8), apart="cloud_id").select("pid", "other", r6(F.col("d")).alias("d"))


@query("mean_knn_distance", f"{P}, n AS (SELECT a.cloud_id, a.pid, {D} AS d FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid <> b.pid QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY {D}, b.pid) <= 4), m AS (SELECT cloud_id, pid, sqrt(sum(d * d) / 4) AS d FROM n GROUP BY cloud_id, pid) SELECT cloud_id, {sql6('avg(d)')} AS mean FROM m GROUP BY cloud_id")
def mean_knn_distance(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    near = joins.knn_join(p, p, 4, joins.suggested_cell(p, 80), by=["cloud_id"])
    each = near.groupBy("cloud_id", "pid").agg(F.sqrt(F.sum(F.col("d") * F.col("d")) / 4).alias("d"))
    return each.groupBy("cloud_id").agg(r6(F.avg("d")).alias("mean"))


@query("min_pair_distance", f"{P} SELECT a.cloud_id, {sql6(f'min({D})')} AS d FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid < b.pid GROUP BY a.cloud_id")
def min_pair_distance(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    return joins.knn_join(p, p, 1, joins.suggested_cell(p, 40), by=["cloud_id"]).groupBy("cloud_id").agg(r6(F.min("d")).alias("d"))


@query("hausdorff_distance", f"{P}, n AS (SELECT a.cloud_id AS a, b.cloud_id AS b, a.pid, min({D}) AS d FROM p a JOIN p b ON a.cloud_id <> b.cloud_id GROUP BY 1, 2, 3) SELECT least(a, b) AS a, greatest(a, b) AS b, {sql6('max(d)')} AS distance FROM n GROUP BY 1, 2")
def hausdorff_distance(spark, sf_dir):
    """Of all pairs of clouds."""
    p = B.cloud(spark, sf_dir)
    return fields.hausdorff_pairs(p, joins.suggested_cell(p, 40)).withColumn("distance", r6(F.col("distance")))


_BOXES = "b AS (SELECT pid AS bid, x - 0.3 AS lox, x + 0.3 AS hix, y - 0.3 AS loy, y + 0.3 AS hiy, z - 0.3 AS loz, z + 0.3 AS hiz FROM p)"


def _boxes(p):
    return p.select(F.col("pid").alias("bid"), *((F.col(k) + s * 0.3).alias(e + k) for k in "xyz" for e, s in (("lo", -1), ("hi", 1))))


@query("box_join", f"{P}, {_BOXES} SELECT bid, pid FROM b JOIN p ON x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz")
def box_join(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    return joins.box_join(_boxes(p), p, 0.6)


@query("box_semi_join", f"{P}, {_BOXES} SELECT bid FROM b WHERE EXISTS (SELECT 1 FROM p WHERE pid <> bid AND x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz)")
def box_semi_join(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    return joins.box_join(_boxes(p), p, 0.6).where("pid <> bid").select("bid").distinct()


@query("box_pairs", f"{P}, {_BOXES} SELECT a.bid AS a, c.bid AS b FROM b a JOIN b c ON a.bid < c.bid AND a.lox <= c.hix AND c.lox <= a.hix AND a.loy <= c.hiy AND c.loy <= a.hiy AND a.loz <= c.hiz AND c.loz <= a.hiz")
def box_pairs(spark, sf_dir):
    return joins.box_pairs(_boxes(B.cloud(spark, sf_dir)), 0.6)


@query("points_outside_spheres", f"{P} SELECT pid FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.pid <> a.pid AND {D} <= 0.2 + abs(b.x) / 10)")
def points_outside_spheres(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    spheres = p.select(F.col("pid").alias("other"), (0.2 + F.abs("x") / 10).alias("radius"))
    widest = spheres.agg(F.max("radius")).first()[0] or 1.0
    hit = joins.radius_join(p, p, widest).where("pid <> other").join(spheres, "other").where("d <= radius").select("pid").distinct()
    return p.join(hit, "pid", "left_anti").select("pid")




@query("radius_clusters", f"WITH RECURSIVE p AS ({B.CLOUD}), e AS (SELECT a.pid AS u, b.pid AS v FROM p a JOIN p b ON a.pid <> b.pid AND {D} < 0.2), r AS (SELECT pid AS node, pid AS seen FROM p UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen) SELECT node AS pid, min(seen) AS cluster FROM r GROUP BY node")
def radius_clusters(spark, sf_dir):
    return fixpoint.radius_clusters(B.cloud(spark, sf_dir), 0.2)


@query("poisson_disc_sample")
def poisson_disc_sample(spark, sf_dir):
    return sampling.poisson_disc(B.cloud(spark, sf_dir), 0.8).select("pid")


@query("cloud_distance_field", f"{P}, n AS (SELECT DISTINCT cloud_id, CAST(floor(x / 0.5) AS BIGINT) + i AS ix, CAST(floor(y / 0.5) AS BIGINT) + j AS iy, CAST(floor(z / 0.5) AS BIGINT) + k AS iz FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) SELECT n.cloud_id, ix, iy, iz, {sql6('min(sqrt(pow(ix * 0.5 - x, 2) + pow(iy * 0.5 - y, 2) + pow(iz * 0.5 - z, 2)))')} AS value FROM n JOIN p ON p.cloud_id = n.cloud_id AND abs(ix - floor(x / 0.5)) <= 1 AND abs(iy - floor(y / 0.5)) <= 1 AND abs(iz - floor(z / 0.5)) <= 1 GROUP BY 1, 2, 3, 4")
def cloud_distance_field(spark, sf_dir):
    """One field a cloud."""
    found = fields.cloud_field(B.cloud(spark, sf_dir), 0.5, 1, by=["cloud_id"])
    return found.select("cloud_id", *(F.col("i" + k).cast("long").alias("i" + k) for k in "xyz"), r6(F.col("value")).alias("value"))
