"""Queries of curvature, subdivision, intersections, hulls and clouds."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import curves, grids, hulls, joins, mesh, shapes, surface
from . import bindings as B
from .mesh_queries import _CORNERS, _UNIT, W
from .registry import query
from .scalar_queries import r6, sql6

P = f"WITH p AS ({B.CLOUD})"
D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


def _cot(at: str, p: str, q: str) -> str:
    u, v = [f"({p}{k}-{at}{k})" for k in "xyz"], [f"({q}{k}-{at}{k})" for k in "xyz"]
    c = [f"({u[i]}*{v[j]} - {u[j]}*{v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    return f"({' + '.join(f'{a}*{b}' for a, b in zip(u, v))}) / sqrt({' + '.join(f'{x}*{x}' for x in c)})"


_COT = f"cot AS (SELECT least(v1, v2) AS e0, greatest(v1, v2) AS e1, {_cot('a', 'b', 'c')} AS w FROM tris UNION ALL SELECT least(v2, v0), greatest(v2, v0), {_cot('b', 'c', 'a')} FROM tris UNION ALL SELECT least(v0, v1), greatest(v0, v1), {_cot('c', 'a', 'b')} FROM tris), cw AS (SELECT e0, e1, sum(w) AS w FROM cot GROUP BY 1, 2)"


@query("cotan_weights", f"{W}, {_COT} SELECT e0, e1, {sql6('w')} AS w FROM cw")
def cotan_weights(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return surface.cotan_weights(f, v).select("e0", "e1", r6(F.col("w")).alias("w"))


@query("mean_curvature", f"{W}, {_UNIT}, {_CORNERS}, {_COT}, rim AS (SELECT e0 AS vid FROM edges WHERE n_faces = 1 UNION SELECT e1 FROM edges WHERE n_faces = 1), o AS (SELECT e0 AS vid, e1 AS q, w FROM cw UNION ALL SELECT e1, e0, w FROM cw), l AS (SELECT o.vid, {', '.join(f'sum(w * (q.{k} - p.{k})) AS l{k}' for k in 'xyz')} FROM o JOIN verts p ON p.vid = o.vid JOIN verts q ON q.vid = o.q WHERE o.vid NOT IN (SELECT vid FROM rim) GROUP BY o.vid), ar AS (SELECT vid, sum(area) / 3 AS area FROM crn GROUP BY vid) SELECT vid, {sql6('sqrt(lx*lx + ly*ly + lz*lz) / (2 * area) / 2')} AS mean FROM l JOIN ar USING (vid)")
def mean_curvature(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return surface.mean_curvatures(f, v).select("vid", r6(F.col("mean")).alias("mean"))


@query("loop_subdivision", f"{W}, nb AS (SELECT e0 AS vid, e1 AS o, n_faces FROM edges UNION ALL SELECT e1, e0, n_faces FROM edges), s AS (SELECT nb.vid, count(*) AS n, bool_or(n_faces = 1) AS rim, sum(z) AS sz, sum(CASE WHEN n_faces = 1 THEN z END) AS rz FROM nb JOIN verts q ON q.vid = o GROUP BY nb.vid) SELECT p.vid, round(CASE WHEN rim THEN 0.75 * z + 0.125 * rz ELSE (1 - (0.625 - pow(0.375 + 0.25 * cos(2 * pi() / n), 2))) * z + (0.625 - pow(0.375 + 0.25 * cos(2 * pi() / n), 2)) / n * sz END, 9) AS z FROM verts p JOIN s USING (vid)")
def loop_subdivision(spark, sf_dir):
    """Heights of the old vertices after one step."""
    v, f = surface.loop_subdivide(*B.heightfield(spark, sf_dir))
    return v.where("vid >= 0").select("vid", F.round("z", 9).alias("z"))


def _loop_points() -> str:
    """Places of all vertices after a Loop step: old ones by their rings, new ones by their edges and the corners opposite."""
    beta = "(0.625 - pow(0.375 + 0.25 * cos(2 * pi() / n), 2))"
    old = ", ".join(f"round(CASE WHEN n IS NULL THEN p.{k} WHEN rim THEN 0.75 * p.{k} + 0.125 * r{k} ELSE (1 - {beta}) * p.{k} + {beta} / n * s{k} END, 9) + 0.0 AS {k}" for k in "xyz")
    new = ", ".join(f"round(CASE WHEN n_faces = 2 THEN 0.375 * (a.{k} + b.{k}) + 0.125 * w{k} ELSE (a.{k} + b.{k}) / 2 END, 9) + 0.0 AS {k}" for k in "xyz")
    ring = ", ".join(f"sum(q.{k}) AS s{k}, sum(CASE WHEN n_faces = 1 THEN q.{k} END) AS r{k}" for k in "xyz")
    return (
        f"{W}, nb AS (SELECT e0 AS vid, e1 AS o, n_faces FROM edges UNION ALL SELECT e1, e0, n_faces FROM edges), "
        f"sm AS (SELECT nb.vid, count(*) AS n, bool_or(n_faces = 1) AS rim, {ring} FROM nb JOIN verts q ON q.vid = o GROUP BY nb.vid), "
        "op AS (SELECT v0 AS s, v1 AS e, v2 AS o FROM faces UNION ALL SELECT v1, v2, v0 FROM faces UNION ALL SELECT v2, v0, v1 FROM faces), "
        "wg AS (SELECT least(s, e) AS e0, greatest(s, e) AS e1, sum(x) AS wx, sum(y) AS wy, sum(z) AS wz FROM op JOIN verts ON vid = o GROUP BY 1, 2) "
        f"SELECT p.vid, {old} FROM verts p LEFT JOIN sm USING (vid) UNION ALL SELECT NULL, {new} FROM edges JOIN wg USING (e0, e1) JOIN verts a ON a.vid = e0 JOIN verts b ON b.vid = e1"
    )


@query("loop_subdivision_points", _loop_points())
def loop_subdivision_points(spark, sf_dir):
    """Places of all vertices after one step; new ones have no number in common with another engine."""
    v, _ = surface.loop_subdivide(*B.heightfield(spark, sf_dir))
    return v.select(F.when(F.col("vid") >= 0, F.col("vid")).alias("vid"), *((F.round(k, 9) + F.lit(0.0)).alias(k) for k in "xyz"))


@query("feature_edges", f"{W}, {_UNIT}, hf AS (SELECT least(s, e) AS e0, greatest(s, e) AS e1, h.fid, nx, ny, nz FROM half h JOIN nrm USING (fid)) SELECT e0, e1, 'boundary' AS kind FROM edges WHERE n_faces = 1 UNION ALL SELECT a.e0, a.e1, 'angle' FROM hf a JOIN hf b ON a.e0 = b.e0 AND a.e1 = b.e1 AND a.fid < b.fid WHERE acos(greatest(-1.0, least(1.0, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz))) > 1.0")
def feature_edges(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return surface.feature_edges(f, v, 1.0).select("e0", "e1", "kind")


def _hit(s: str, o: str, e: str, t: str) -> str:
    """Whether the segment o-e of s passes through t, in SQL."""
    c = lambda x, p, k: f"{x}.{p}{k}"
    d, e1, e2, w = ([f"({c(x, q, k)} - {c(x2, p, k)})" for k in "xyz"] for x, q, x2, p in ((s, e, s, o), (t, "b", t, "a"), (t, "c", t, "a"), (s, o, t, "a")))
    x = lambda a, b: [f"({a[i]}*{b[j]} - {a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    dot = lambda a, b: "(" + " + ".join(f"{p}*{q}" for p, q in zip(a, b)) + ")"
    pv, qv = x(d, e2), x(w, e1)
    det = dot(e1, pv)
    u, v, h = (f"({dot(*z)} / nullif({det}, 0))" for z in ((w, pv), (d, qv), (e2, qv)))
    return f"(abs({det}) > 1e-9 AND {u} >= 0 AND {v} >= 0 AND {u} + {v} <= 1 AND {h} BETWEEN 0 AND 1)"


@query("intersecting_triangles", f"WITH t AS ({B.TRIANGLES}) SELECT s.fid AS a, t.fid AS b FROM t s JOIN t ON s.fid < t.fid WHERE " + " OR ".join(_hit(s, o, e, t) for s, t in (("s", "t"), ("t", "s")) for o, e in (("a", "b"), ("b", "c"), ("c", "a"))))
def intersecting_triangles(spark, sf_dir):
    return surface.intersecting_triangles(B.triangles(spark, sf_dir), 0.25)


@query("hits_above", f"{W}, p AS ({B.CLOUD}), q AS (SELECT pid, 11 + 3 * x + 0.0137 AS px, 11 + 3 * y + 0.0071 AS py, 24 + z AS pz FROM p) SELECT pid, (SELECT count(*) FROM tris WHERE ((bx-ax)*(py-ay) - (by-ay)*(px-ax)) >= 0 AND ((cx-bx)*(py-by) - (cy-by)*(px-bx)) >= 0 AND ((ax-cx)*(py-cy) - (ay-cy)*(px-cx)) >= 0 AND az + (bz-az) * ((px-ax)*(cy-ay) - (cx-ax)*(py-ay)) / ((bx-ax)*(cy-ay) - (cx-ax)*(by-ay)) + (cz-az) * ((bx-ax)*(py-ay) - (px-ax)*(by-ay)) / ((bx-ax)*(cy-ay) - (cx-ax)*(by-ay)) >= pz) AS hits FROM q")
def hits_above(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    p = B.cloud(spark, sf_dir).select("pid", (11 + 3 * F.col("x") + 0.0137).alias("x"), (11 + 3 * F.col("y") + 0.0071).alias("y"), (24 + F.col("z")).alias("z"))
    return surface.hits_above(p, mesh.placed(f, v), 1.0)


@query("bounding_spheres", f"{P}, c AS (SELECT cloud_id, {', '.join(f'(min({k}) + max({k})) / 2 AS c{k}' for k in 'xyz')} FROM p GROUP BY cloud_id) SELECT cloud_id, {sql6('max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)))')} AS radius FROM p JOIN c USING (cloud_id) GROUP BY cloud_id")
def bounding_spheres(spark, sf_dir):
    return surface.bounding_spheres(B.cloud(spark, sf_dir)).select("cloud_id", r6(F.col("radius")).alias("radius"))


@query("convex_hulls", f"{P}, e AS (SELECT a.cloud_id, a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid <> b.pid WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.cloud_id = a.cloud_id AND c.pid <> a.pid AND c.pid <> b.pid AND (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0)) SELECT cloud_id, a AS pid FROM e")
def convex_hulls(spark, sf_dir):
    return hulls.convex_hulls(B.cloud(spark, sf_dir)).select("cloud_id", "pid")


@query("principal_axes")
def principal_axes(spark, sf_dir):
    return hulls.principal_axes(B.cloud(spark, sf_dir)).select("cloud_id", *(r6(F.col(f"e{i}")).alias(f"e{i}") for i in (1, 2, 3)))


@query("octahedron_areas", f"WITH p AS ({B.CLOUD}) SELECT pid AS mesh_id, {sql6('8 * 0.5 * sqrt(3) * (1 + abs(x)) * (1 + abs(x))')} AS area, {sql6('4 * pow(1 + abs(x), 3) / 3')} AS volume FROM p")
def octahedron_areas(spark, sf_dir):
    """A solid around each point; volumes are about the origin, so solids are centred there."""
    c = B.cloud(spark, sf_dir).select(F.col("pid").alias("mesh_id"), *(F.lit(0.0).alias(k) for k in "xyz"), (1 + F.abs("x")).alias("r"))
    v, f = surface.solids(c, "octahedron")
    return mesh.measures(f, v).select("mesh_id", r6(F.col("area")).alias("area"), r6(F.col("volume")).alias("volume"))


@query("sphere_meshes", f"{P} SELECT pid AS mesh_id, round(8 * (1.5 * sqrt(1.75 - sqrt(2)) + sqrt(3) / 4) / (4 * pi()), 6) AS share FROM p")
def sphere_meshes(spark, sf_dir):
    """Spheres around all points: an octahedron, subdivided and projected; the share of the sphere's area."""
    c = B.cloud(spark, sf_dir).select(F.col("pid").alias("mesh_id"), "x", "y", "z", (1 + F.abs("x")).alias("r"))
    v, f = surface.solids(c, "octahedron")
    v, f = mesh.subdivide(v, f)
    v = surface.projected(v, c)
    return mesh.measures(f, v).join(c, "mesh_id").select("mesh_id", r6(F.col("area") / (4 * math.pi * F.col("r") * F.col("r"))).alias("share"))


@query("plane_sections", f"{W}, c AS (SELECT fid, " + ", ".join(f"CASE WHEN ({p}z > 25.0) <> ({q}z > 25.0) THEN {p}{k} + (25.0 - {p}z) / ({q}z - {p}z) * ({q}{k} - {p}{k}) END AS {k}{i}" for i, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a"))) for k in "xy") + f" FROM tris) SELECT fid, {sql6('CASE WHEN x0 IS NULL THEN sqrt(pow(x1-x2, 2) + pow(y1-y2, 2)) WHEN x1 IS NULL THEN sqrt(pow(x0-x2, 2) + pow(y0-y2, 2)) ELSE sqrt(pow(x0-x1, 2) + pow(y0-y1, 2)) END')} AS length FROM c WHERE x0 IS NOT NULL OR x1 IS NOT NULL OR x2 IS NOT NULL")
def plane_sections(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return surface.plane_sections(f, v, 25.0).select("fid", r6(F.col("length")).alias("length"))


@query("voxel_downsample", f"WITH p AS ({B.CLOUD}) SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, min(pid) AS pid, count(*) AS n FROM p GROUP BY 1, 2, 3")
def voxel_downsample(spark, sf_dir):
    return B.cloud(spark, sf_dir).groupBy(*(F.floor(k).cast("long").alias("i" + k) for k in "xyz")).agg(F.min("pid").alias("pid"), F.count("*").alias("n"))


@query("densest_voxels", f"WITH p AS ({B.BIG_CLOUD}) SELECT CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 5) AS BIGINT) AS iy, count(*) AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, ix, iy LIMIT 20")
def densest_voxels(spark, sf_dir):
    v = grids.voxels(B.big_cloud(spark, sf_dir), 5.0, "xy")
    return v.orderBy(F.desc("n"), "ix", "iy").limit(20).select("ix", "iy", "n")


@query("point_density", f"{P} SELECT a.pid, count(b.pid) AS n FROM p a LEFT JOIN p b ON a.pid <> b.pid AND {D} <= 0.8 GROUP BY a.pid")
def point_density(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    near = joins.radius_join(p, p, 0.8).where("pid <> other").groupBy("pid").agg(F.count("*").alias("n"))
    return p.join(near, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n"))


@query("isolated_points", f"{P} SELECT pid FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.pid <> b.pid AND {D} <= 0.8)")
def isolated_points(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    return p.join(joins.radius_join(p, p, 0.8).where("pid <> other").select("pid").distinct(), "pid", "left_anti").select("pid")


@query("curve_gaps", f"WITH c AS ({B.CURVES}), g AS (SELECT *, x - lag(x) OVER (PARTITION BY curve_id ORDER BY seq) AS gap FROM c), r AS (SELECT *, sum(CASE WHEN gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY curve_id ORDER BY seq) AS piece FROM g) SELECT curve_id, CAST(piece AS BIGINT) AS piece, count(*) AS n, {sql6('min(x)')} AS first, {sql6('max(x)')} AS last FROM r GROUP BY 1, 2")
def curve_gaps(spark, sf_dir):
    """Curves cut where their points are more than twelve hours apart."""
    w = Window.partitionBy("curve_id").orderBy("seq")
    c = B.curves(spark, sf_dir).withColumn("gap", F.col("x") - F.lag("x").over(w)).withColumn("piece", F.sum(F.when(F.col("gap") > 12, 1).otherwise(0)).over(w))
    return c.groupBy("curve_id", "piece").agg(F.count("*").alias("n"), r6(F.min("x")).alias("first"), r6(F.max("x")).alias("last"))


@query("filled_curves", f"WITH c AS ({B.CURVES}), m AS (SELECT *, CASE WHEN y > 100 THEN y END AS mark FROM c) SELECT curve_id, seq, {sql6('last(mark IGNORE NULLS) OVER (PARTITION BY curve_id ORDER BY seq)')} AS before, {sql6('first(mark IGNORE NULLS) OVER (PARTITION BY curve_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS after FROM m")
def filled_curves(spark, sf_dir):
    """The last and the next marked value of every point of a curve."""
    m = B.curves(spark, sf_dir).withColumn("mark", F.when(F.col("y") > 100, F.col("y")))
    return m.select("curve_id", "seq", r6(curves.filled(m, "mark")).alias("before"), r6(curves.filled(m, "mark", forward=False)).alias("after"))


@query("moving_averages", f"WITH c AS ({B.CURVES}) SELECT curve_id, seq, {sql6('avg(y) OVER (PARTITION BY curve_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS mean FROM c")
def moving_averages(spark, sf_dir):
    w = Window.partitionBy("curve_id").orderBy("seq").rowsBetween(-2, 2)
    return B.curves(spark, sf_dir).select("curve_id", "seq", r6(F.avg("y").over(w)).alias("mean"))


@query("merged_clouds", f"{P} SELECT row_number() OVER (ORDER BY cloud_id, pid) - 1 AS pid, cloud_id, {sql6('x')} AS x FROM p")
def merged_clouds(spark, sf_dir):
    """All clouds as one with new ids, in the order of cloud and id."""
    return shapes.numbered(B.cloud(spark, sf_dir).select("cloud_id", F.col("pid").alias("old"), "x"), ["cloud_id", "old"], "pid").select("pid", "cloud_id", r6(F.col("x")).alias("x"))


@query("cloud_differences", f"WITH p AS ({B.CLOUD}), a AS (SELECT pid FROM p WHERE x > 0), b AS (SELECT pid FROM p WHERE y > 0) SELECT pid, CASE WHEN pid IN (SELECT pid FROM a) AND pid IN (SELECT pid FROM b) THEN 'both' WHEN pid IN (SELECT pid FROM a) THEN 'x' ELSE 'y' END AS side FROM (SELECT pid FROM a UNION SELECT pid FROM b)")
def cloud_differences(spark, sf_dir):
    p = B.cloud(spark, sf_dir)
    a, b = p.where("x > 0").select("pid", F.lit(1).alias("a")), p.where("y > 0").select("pid", F.lit(1).alias("b"))
    return a.join(b, "pid", "full").select("pid", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "x").otherwise("y").alias("side"))


@query("vector_field_divergence", f"WITH {B.GRID}, v AS (SELECT ix, iy, value * 0.5 AS vx, value * ix * 0.01 AS vy FROM grid) SELECT g.ix, g.iy, {'round((r.vx - l.vx) / 2 + (u.vy - d.vy) / 2 + 1e-9, 4)'} AS divergence FROM v g JOIN v r ON r.ix = g.ix + 1 AND r.iy = g.iy JOIN v l ON l.ix = g.ix - 1 AND l.iy = g.iy JOIN v u ON u.ix = g.ix AND u.iy = g.iy + 1 JOIN v d ON d.ix = g.ix AND d.iy = g.iy - 1")
def vector_field_divergence(spark, sf_dir):
    g = B.price_grid(spark, sf_dir).select("ix", "iy", (F.col("value") * 0.5).alias("vx"), (F.col("value") * F.col("ix") * 0.01).alias("vy"))
    out = g.select("ix", "iy")
    for name, c, a, b in (("r", "vx", 1, 0), ("l", "vx", -1, 0), ("u", "vy", 0, 1), ("d", "vy", 0, -1)):
        out = out.join(g.select((F.col("ix") - a).alias("ix"), (F.col("iy") - b).alias("iy"), F.col(c).alias(name)), ["ix", "iy"])
    return out.select("ix", "iy", F.round((F.col("r") - F.col("l")) / 2 + (F.col("u") - F.col("d")) / 2 + 1e-9, 4).alias("divergence"))


@query("nearest_grid_values", f"WITH {B.GRID}, s AS (SELECT vec_id AS pid, 25 + 8 * CAST(embedding[1] AS DOUBLE) AS x, 5 + 2 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) SELECT pid, value FROM s LEFT JOIN grid ON ix = greatest(1, least(50, CAST(floor(x + 0.5) AS BIGINT))) AND iy = greatest(0, least(10, CAST(floor(y + 0.5) AS BIGINT)))")
def nearest_grid_values(spark, sf_dir):
    at = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(c + 0.5))).cast("long")
    p = B.cloud(spark, sf_dir).select("pid", at(25 + F.col("x"), 1, 50).alias("ix"), at(5 + F.col("y") / 4, 0, 10).alias("iy"))
    return p.join(B.price_grid(spark, sf_dir), ["ix", "iy"], "left").select("pid", "value")
