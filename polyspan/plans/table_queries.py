"""Queries that flag, count and rewrite meshes, curves and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import curves, grids, mesh
from . import bindings as B
from .mesh_queries import _UNIT, W
from .registry import query
from .scalar_queries import r6, sql6
from .sequence_queries import N

_GRID = f"WITH {B.GRID}"


@query("flipped_faces", f"{W} SELECT fid, v0, v2 AS v1, v1 AS v2 FROM faces")
def flipped_faces(spark, sf_dir):
    return mesh.flipped(B.heightfield(spark, sf_dir)[1]).drop("mesh_id")


@query("face_kinds", f"{W} SELECT * FROM (VALUES (CAST(0 AS BIGINT), TRUE, FALSE), (1, FALSE, TRUE), (2, FALSE, FALSE)) t(mesh_id, is_triangle_mesh, is_quad_mesh) WHERE EXISTS (SELECT 1 FROM faces)")
def face_kinds(spark, sf_dir):
    """The heightfield as triangles, as quads, and as both."""
    f, n = B.heightfield(spark, sf_dir)[1], B.side(spark, sf_dir)
    three = f.select(F.array("v0", "v1", "v2").alias("vids"), "fid", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("mesh_id"))
    four = f.where("fid % 2 = 0").select(F.array("v0", "v1", "v2", F.col("v0") + n).alias("vids"), "fid", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("mesh_id"))
    return mesh.face_kinds(three.union(four))


@query("manifold_vertices", f"{W}, h AS (SELECT * FROM faces WHERE (v0 // {B.SIDE} + v0 % {B.SIDE}) % 2 = 0), r AS (SELECT v0 AS s, v1 AS e FROM h UNION ALL SELECT v1, v2 FROM h UNION ALL SELECT v2, v0 FROM h), o AS (SELECT r.s, CASE WHEN b.s IS NULL THEN 1 ELSE 0 END AS gap FROM r LEFT JOIN r b ON b.s = r.e AND b.e = r.s) SELECT s AS vid, sum(gap) < 2 AS manifold FROM o GROUP BY s")
def manifold_vertices(spark, sf_dir):
    """On every second cell of the heightfield, as on a chessboard, where cells meet in corners."""
    f, n = B.heightfield(spark, sf_dir)[1], B.side(spark, sf_dir)
    cells = f.where((F.floor(F.col("v0") / n) + F.col("v0") % n) % 2 == 0)
    return mesh.manifold_vertices(cells).drop("mesh_id")


_FACES_AT = "(SELECT v0 AS vid, * FROM nrm UNION ALL SELECT v1, * FROM nrm UNION ALL SELECT v2, * FROM nrm)"


@query("vertex_metrics", f"{W}, {_UNIT} SELECT vid, {sql6('avg(CASE WHEN area > 10 THEN 0 ELSE area END)')} AS area, {sql6('avg(CASE WHEN nz > 0.05 THEN 1 ELSE -1 END)')} AS flag, {sql6('sum(pow(-(nx*ax + ny*ay + nz*az), 2)) / 1e6')} AS q9, round(sum(nz * nz), 6) AS q7 FROM {_FACES_AT} GROUP BY vid")
def vertex_metrics(spark, sf_dir):
    """Of incident faces: the mean area (over 10: not in the sum), the mean sign of a flag, two coefficients of the quadric."""
    v, f = B.heightfield(spark, sf_dir)
    at = mesh.placed(f, v)
    n = V.cross(V.minus(V.vec("b"), V.vec("a")), V.minus(V.vec("c"), V.vec("a")))
    area = at.select("mesh_id", "fid", (V.norm(n) / 2).alias("value"))
    flags = at.select("mesh_id", "fid", (V.normalize(n)[2] > 0.05).alias("flag"))
    signs = mesh.vertex_signs(f, flags).withColumnRenamed("value", "flag")
    q = mesh.vertex_quadrics(f, v).select("mesh_id", "vid", "q9", "q7")
    all_ = mesh.vertex_metric(f, area, 10.0).join(signs, ["mesh_id", "vid"]).join(q, ["mesh_id", "vid"])
    return all_.select("vid", r6(F.col("value")).alias("area"), r6(F.col("flag")).alias("flag"), r6(F.col("q9") / 1e6).alias("q9"), F.round("q7", 6).alias("q7"))


@query("covolume_stats", f"{W}, {_UNIT}, s AS (SELECT vid, sum(area) / 3 AS area FROM {_FACES_AT} GROUP BY vid) SELECT CAST(0 AS BIGINT) AS mesh_id, {sql6('min(area)')} AS least, {sql6('max(area)')} AS most, {sql6('avg(area)')} AS mean FROM s")
def covolume_stats(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.covolume_stats(f, v).select("mesh_id", *(r6(F.col(c)).alias(c) for c in ("least", "most", "mean")))


_N = B.SIDE


@query("dual_mesh", f"{W} SELECT vid AS fid, concat_ws(',', 2*(vid-{_N}-1), 2*(vid-{_N})+1, 2*vid, 2*vid+1, 2*(vid-1), 2*(vid-{_N}-1)+1) AS ring FROM verts WHERE vid % {_N} BETWEEN 1 AND {_N} - 2 AND vid // {_N} BETWEEN 1 AND {_N} - 2")
def dual_mesh(spark, sf_dir):
    """Polygons around inner vertices; the twin knows the heightfield's pattern."""
    v, f = B.heightfield(spark, sf_dir)
    return mesh.dual(f, v)[1].select("fid", F.concat_ws(",", F.transform("vids", lambda k: k.cast("string"))).alias("ring"))


_E0, _E1 = "sqrt(pow(x-px,2)+pow(y-py,2))", "sqrt(pow(nx-x,2)+pow(ny-y,2))"
_NORMALS = f"m AS (SELECT curve_id, seq, coalesce((y-py) / nullif({_E0}, 0), 0) + coalesce((ny-y) / nullif({_E1}, 0), 0) AS sx, coalesce((px-x) / nullif({_E0}, 0), 0) + coalesce((x-nx) / nullif({_E1}, 0), 0) AS sy FROM n)"


@query("curve_normals", f"{N}, {_NORMALS} SELECT curve_id, seq, " + ", ".join(f"round(CASE WHEN sx = 0 AND sy = 0 THEN 0 ELSE s{k} / sqrt(sx*sx + sy*sy) END, 5) + 0.0 AS n{k}" for k in "xy") + " FROM m")
def curve_normals(spark, sf_dir):
    return curves.vertex_normals(B.curves(spark, sf_dir)).select("curve_id", "seq", *((F.round("n" + k, 5) + 0.0).alias("n" + k) for k in "xy"))


@query("curve_covolumes", f"{N} SELECT curve_id, seq, {sql6(f'coalesce(({_E0} + {_E1}) / 2, 0)')} AS length, {sql6('(x + nx) / 2')} AS mx, {sql6('(y + ny) / 2')} AS my FROM n")
def curve_covolumes(spark, sf_dir):
    """Half of both edges, and the middle of the next edge."""
    c = B.curves(spark, sf_dir)
    m = curves.edge_midpoints(c).select("curve_id", "seq", r6(F.col("x")).alias("mx"), r6(F.col("y")).alias("my"))
    return curves.covolumes(c).select("curve_id", "seq", r6(F.col("length")).alias("length")).join(m, ["curve_id", "seq"], "left")


@query("curve_summaries", f"WITH c AS ({B.CURVES}) SELECT curve_id, count(*) AS n, {sql6('least(max(x) - min(x), max(y) - min(y))')} AS min_dimension, {sql6('greatest(max(x) - min(x), max(y) - min(y))')} AS max_dimension, count(*) > 1 AND first(x ORDER BY seq) = last(x ORDER BY seq) AND first(y ORDER BY seq) = last(y ORDER BY seq) AS closed FROM c GROUP BY curve_id")
def curve_summaries(spark, sf_dir):
    return curves.summaries(B.curves(spark, sf_dir)).withColumn("min_dimension", r6(F.col("min_dimension"))).withColumn("max_dimension", r6(F.col("max_dimension")))


@query("reversed_curves", f"WITH c AS ({B.CURVES}) SELECT curve_id, 1 + count(*) OVER (PARTITION BY curve_id) - seq AS seq, {sql6('x')} AS x, {sql6('y')} AS y FROM c")
def reversed_curves(spark, sf_dir):
    return curves.reversed_order(B.curves(spark, sf_dir)).select("curve_id", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("grid_algebra", f"{_GRID}, s AS (SELECT *, CASE WHEN ix BETWEEN 10 AND 20 AND iy BETWEEN 2 AND 4 THEN -value ELSE value END AS flipped, (value - (SELECT min(value) FROM grid)) / ((SELECT max(value) FROM grid) - (SELECT min(value) FROM grid)) AS share FROM grid) SELECT ix - 5 AS ix, iy - 1 AS iy, {sql6('-1 + 2 * share + 0.5 * flipped')} AS value FROM s WHERE ix BETWEEN 5 AND 40 AND iy BETWEEN 1 AND 9")
def grid_algebra(spark, sf_dir):
    """The normalised grid (-1 to 1) plus half of one with a negated part; a window of it, counted from its corner."""
    grid = B.price_grid(spark, sf_dir)
    half = grids.negated(grid, (10, 2), (20, 4)).withColumn("value", F.col("value") * 0.5)
    both = grids.combined(grids.normalised(grid, -1.0, 1.0), half, lambda a, b: a + b)
    return grids.sub_grid(both, (5, 1), (40, 9)).withColumn("value", r6(F.col("value")))


_TOP = "SELECT ix, iy FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid n WHERE abs(n.ix - g.ix) <= 1 AND abs(n.iy - g.iy) <= 1 AND (n.ix <> g.ix OR n.iy <> g.iy) AND {} )"


@query("near_extremes", f"{_GRID}, top AS ({_TOP.format('n.value >= g.value')}), low AS ({_TOP.format('n.value <= g.value')}), ends AS (FROM top UNION FROM low) SELECT ix, iy, " + ", ".join(f"EXISTS (SELECT 1 FROM {t} m WHERE abs(m.ix - g.ix) <= 1 AND abs(m.iy - g.iy) <= 1) AS {n}" for t, n in (("top", "near_maximum"), ("ends", "near_extreme"))) + " FROM grid g")
def near_extremes(spark, sf_dir):
    """Nodes next to a local maximum, and to a local maximum or minimum."""
    grid = B.price_grid(spark, sf_dir)
    tops = grids.near(grid, grids.local_maxima(grid)).withColumnRenamed("near", "near_maximum")
    return tops.join(grids.near(grid, grids.extremes(grid)).withColumnRenamed("near", "near_extreme"), ["ix", "iy"])


def _at(name: str, dx: int, dy: int, kind: str = "JOIN") -> str:
    return f"{kind} v {name} ON {name}.ix = g.ix + {dx} AND {name}.iy = g.iy + {dy}"


@query("near_shocks", f"{_GRID}, v AS (SELECT * FROM grid), d AS (SELECT g.ix, g.iy, (r.value * 2 - l.value * 2 + u.value * -1 - d.value * -1) / 2 AS s FROM v g {_at('r', 1, 0)} {_at('l', -1, 0)} {_at('u', 0, 1)} {_at('d', 0, -1)}) SELECT ix, iy, EXISTS (SELECT 1 FROM d WHERE s < -0.25 AND abs(d.ix - g.ix) <= 1 AND abs(d.iy - g.iy) <= 1) AS near FROM grid g")
def near_shocks(spark, sf_dir):
    """Nodes next to one where the field (2 value, -value) converges."""
    grid = B.price_grid(spark, sf_dir)
    field = grid.select("ix", "iy", (F.col("value") * 2).alias("gx"), (-F.col("value")).alias("gy"))
    return grids.near(grid, grids.divergence(field).where("divergence < -0.25"))


@query("level_boxes", f"{_GRID} SELECT min(ix) AS lox, min(iy) AS loy, max(ix) AS hix, max(iy) AS hiy FROM grid WHERE abs(value - 53) <= 0.1")
def level_boxes(spark, sf_dir):
    return grids.level_box(B.price_grid(spark, sf_dir), 53.0, 0.1)


@query("repaired_grid", f"{_GRID}, v AS (SELECT ix, iy, CASE WHEN (3 * ix + iy) % 7 <> 0 THEN value END AS value FROM grid), f AS (SELECT g.ix, g.iy, g.value, [r.value, l.value, u.value, d.value] AS four FROM v g {_at('r', 1, 0, 'LEFT JOIN')} {_at('l', -1, 0, 'LEFT JOIN')} {_at('u', 0, 1, 'LEFT JOIN')} {_at('d', 0, -1, 'LEFT JOIN')}) SELECT ix, iy, {sql6('coalesce(value, list_avg(four))')} AS value FROM f")
def repaired_grid(spark, sf_dir):
    """Every seventh node of a diagonal pattern is lost and filled from its neighbours."""
    holes = B.price_grid(spark, sf_dir).withColumn("value", F.when((3 * F.col("ix") + F.col("iy")) % 7 != 0, F.col("value")))
    return grids.repaired(holes, lambda v: F.isnan(v)).withColumn("value", r6(F.col("value")))


@query("resampled_grid", f"{_GRID}, j AS (SELECT jx, jy, jx / 2 AS x, jy / 2 AS y FROM (SELECT unnest(range(0, 200)) AS jx), (SELECT unnest(range(0, 60)) AS jy)) SELECT jx AS ix, jy AS iy, {sql6('a.value * (1-(x-floor(x))) * (1-(y-floor(y))) + b.value * (x-floor(x)) * (1-(y-floor(y))) + c.value * (1-(x-floor(x))) * (y-floor(y)) + d.value * (x-floor(x)) * (y-floor(y))')} AS value FROM j JOIN grid a ON a.ix = floor(x) AND a.iy = floor(y) JOIN grid b ON b.ix = floor(x) + 1 AND b.iy = floor(y) JOIN grid c ON c.ix = floor(x) AND c.iy = floor(y) + 1 JOIN grid d ON d.ix = floor(x) + 1 AND d.iy = floor(y) + 1")
def resampled_grid(spark, sf_dir):
    """Half the cell side."""
    return grids.resampled(B.price_grid(spark, sf_dir), 0.5).withColumn("value", r6(F.col("value")))
