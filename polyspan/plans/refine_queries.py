"""Curves and grids written and read again, refined meshes, mesh distance fields, streamlines and cloud normals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, joins, mesh, refine
from ..sources import sinks, text_meshes
from . import bindings as B
from .registry import query
from .scalar_queries import _D, NX, NY, NZ, _seg, r6, sql6

W = f"WITH {B.MESH}"


@query("curve_ply_roundtrip", f"WITH c AS (SELECT curve_id, x, y, row_number() OVER (ORDER BY curve_id, seq) - 1 AS vid, row_number() OVER (PARTITION BY curve_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY curve_id) AS n FROM ({B.CURVES})) SELECT vid, {sql6('x')} AS x, {sql6('y')} AS y, CASE WHEN n = 1 THEN 0 WHEN k IN (1, n) THEN 1 ELSE 2 END AS n_edges FROM c")
def curve_ply_roundtrip(spark, sf_dir):
    """All curves as one PLY of edges and back: points with the number of their edges."""
    path = B.shared_path(spark, "curves")
    sinks.write_lines(sinks.curve_ply_lines(B.curves(spark, sf_dir)), path)
    v, e = text_meshes.read_ply(spark, path + "/*/*.txt", True, "edge")
    uses = e.select(F.explode("vids").alias("vid")).groupBy("vid").agg(F.count("*").alias("n_edges"))
    return v.join(uses, "vid", "left").select("vid", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


@query("polylines_roundtrip", f"SELECT row_number() OVER (ORDER BY curve_id) - 1 AS lid, count(*) AS n, {sql6('sum(y)')} AS y FROM ({B.CURVES}) GROUP BY curve_id")
def polylines_roundtrip(spark, sf_dir):
    """All curves as one OBJ of l lines and back: points of each curve and the sum of their values."""
    path = B.shared_path(spark, "polylines")
    sinks.write_lines(sinks.polyline_obj_lines(B.curves(spark, sf_dir)), path)
    v, polylines = text_meshes.read_polylines(spark, path + "/*/*.txt", True)
    points = polylines.select("lid", F.explode("vids").alias("vid")).join(v, "vid")
    return points.groupBy("lid").agg(F.count("*").alias("n"), r6(F.sum("y")).alias("y"))


@query("vti_roundtrip", f"WITH {B.VOLUME} SELECT ix, iy, iz, {sql6('value')} AS value FROM vol")
def vti_roundtrip(spark, sf_dir):
    """A 3D grid as image data and back."""
    path = B.shared_path(spark, "vti")
    sinks.write_lines(sinks.vti_lines(B.volume(spark, sf_dir)), path)
    g = text_meshes.read_vti(spark, path + "/*/*.txt", True)
    return g.where(~F.isnan("value")).select("ix", "iy", "iz", r6(F.col("value")).alias("value"))


@query("catmull_clark", f"""{W}, corner AS (SELECT fid, unnest([v0, v1, v2]) AS vid FROM faces), f AS (SELECT fid, avg(z) AS fz FROM corner JOIN verts USING (vid) GROUP BY fid),
fv AS (SELECT vid, avg(fz) AS fz FROM corner JOIN f USING (fid) GROUP BY vid), nb AS (SELECT e0 AS vid, e1 AS o, n_faces FROM edges UNION ALL SELECT e1, e0, n_faces FROM edges),
s AS (SELECT nb.vid, count(*) AS n, bool_or(n_faces = 1) AS rim, avg(z) AS az, sum(CASE WHEN n_faces = 1 THEN z END) AS rz FROM nb JOIN verts q ON q.vid = o GROUP BY nb.vid)
SELECT p.vid, round(CASE WHEN rim THEN (6 * z + rz) / 8 ELSE (fz + z + az + (n - 3) * z) / n END, 9) AS z FROM verts p JOIN s USING (vid) JOIN fv USING (vid)""")
def catmull_clark(spark, sf_dir):
    """Heights of the old vertices after one step."""
    v, f = B.heightfield(spark, sf_dir)
    new, _ = refine.catmull_clark(v, f.select("mesh_id", "fid", F.array("v0", "v1", "v2").alias("vids")))
    return new.where("vid >= 0").select("vid", F.round("z", 9).alias("z"))


_BAND = 1.37


def _field() -> str:
    least, most = ({k: f"{f}(a{k}, b{k}, c{k})" for k in "xyz"} for f in ("least", "greatest"))
    for_k = lambda k: f"unnest(generate_series(CAST(ceil({least[k]} - {_BAND}) AS BIGINT), CAST(floor({most[k]} + {_BAND}) AS BIGINT))) AS i{k}"
    nodes = "tris"
    for k in "xyz":
        nodes = f"(SELECT *, {for_k(k)} FROM {nodes})"
    distance = f"CASE WHEN 1-v-w >= 0 AND v >= 0 AND w >= 0 THEN abs((px-ax)*nx + (py-ay)*ny + (pz-az)*nz) / sqrt(nx*nx + ny*ny + nz*nz) ELSE least({_seg('a', 'b')}, {_seg('b', 'c')}, {_seg('c', 'a')}) END"
    dots = ", ".join(f"{e} AS d{n}" for n, e in _D.items())
    return f"{W}, t AS (SELECT *, CAST(ix AS DOUBLE) AS px, CAST(iy AS DOUBLE) AS py, CAST(iz AS DOUBLE) AS pz FROM {nodes}), d AS (SELECT *, {dots}, {NX} AS nx, {NY} AS ny, {NZ} AS nz FROM t), w AS (SELECT *, (d11*d20 - d01*d21) / (d00*d11 - d01*d01) AS v, (d00*d21 - d01*d20) / (d00*d11 - d01*d01) AS w FROM d) SELECT ix, iy, iz, {sql6(f'min({distance})')} AS value FROM w GROUP BY 1, 2, 3 HAVING min({distance}) <= {_BAND}"


@query("mesh_distance_field", _field())
def mesh_distance_field(spark, sf_dir):
    """The distance to the heightfield at all grid nodes near it."""
    v, f = B.heightfield(spark, sf_dir)
    return refine.mesh_field(mesh.placed(f, v), 1.0, _BAND).select("ix", "iy", "iz", r6(F.col("value")).alias("value"))


@query("streamlines")
def streamlines(spark, sf_dir):
    """Three Runge-Kutta steps down the gradient of mean prices, from the middle of every cell."""
    g = B.price_grid(spark, sf_dir)
    seeds = g.select((F.col("iy") * 1000 + F.col("ix")).alias("pid"), (F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.5).alias("y"))
    return refine.streamlines(grids.gradient(g), seeds, -0.001, 3).select("pid", "step", *(r6(F.col(k)).alias(k) for k in "xy"))


@query("cloud_normals")
def cloud_normals(spark, sf_dir):
    """The normal of every point from its eight nearest."""
    p = B.cloud(spark, sf_dir).select("pid", "x", "y", "z")
    return refine.cloud_normals(p, 8, joins.suggested_cell(p)).select("pid", *(r6(F.col("n" + k)).alias("n" + k) for k in "xyz"))
