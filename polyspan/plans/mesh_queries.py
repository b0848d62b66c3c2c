"""Queries over the heightfield mesh and derived topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from ..operators import mesh
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6

W = f"WITH {B.MESH}"
_N = "SELECT fid, v0, v1, v2, (by-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by-ay)*(cx-ax) AS nz, * EXCLUDE (fid, v0, v1, v2) FROM tris"
_UNIT = f"nrm AS (SELECT * EXCLUDE (nx, ny, nz), nx / sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny / sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz / sqrt(nx*nx+ny*ny+nz*nz) AS nz, 0.5 * sqrt(nx*nx+ny*ny+nz*nz) AS area FROM ({_N}))"


def _ang(at: str, p: str, q: str) -> str:
    d = " + ".join(f"({p}{k}-{at}{k})*({q}{k}-{at}{k})" for k in "xyz")
    n = lambda r: "sqrt(" + " + ".join(f"({r}{k}-{at}{k})*({r}{k}-{at}{k})" for k in "xyz") + ")"
    return f"acos(greatest(-1.0, least(1.0, ({d}) / ({n(p)} * {n(q)}))))"


_CORNERS = f"crn AS (SELECT fid, v0 AS vid, {_ang('a', 'b', 'c')} AS w, nx, ny, nz, area FROM nrm UNION ALL SELECT fid, v1, {_ang('b', 'c', 'a')}, nx, ny, nz, area FROM nrm UNION ALL SELECT fid, v2, {_ang('c', 'a', 'b')}, nx, ny, nz, area FROM nrm)"


@query("mesh_corners", f"{W} SELECT fid, CAST(k AS INTEGER) AS k, vid, vid_next, vid_prev FROM (SELECT fid, 0 AS k, v0 AS vid, v1 AS vid_next, v2 AS vid_prev FROM faces UNION ALL SELECT fid, 1, v1, v2, v0 FROM faces UNION ALL SELECT fid, 2, v2, v0, v1 FROM faces)")
def mesh_corners(spark, sf_dir):
    return mesh.corners(B.heightfield(spark, sf_dir)[1]).drop("mesh_id")


@query("mesh_edges", f"{W} SELECT e0, e1, n_faces FROM edges")
def mesh_edges(spark, sf_dir):
    return mesh.edges(B.heightfield(spark, sf_dir)[1]).select("e0", "e1", "n_faces")


@query("vertex_valence", f"{W} SELECT vid, count(*) AS valence FROM (SELECT e0 AS vid FROM edges UNION ALL SELECT e1 FROM edges) GROUP BY vid")
def vertex_valence(spark, sf_dir):
    return mesh.valence(B.heightfield(spark, sf_dir)[1]).select("vid", "valence")


@query("boundary_vertices", f"{W} SELECT e0 AS vid FROM edges WHERE n_faces = 1 UNION SELECT e1 FROM edges WHERE n_faces = 1")
def boundary_vertices(spark, sf_dir):
    return mesh.boundary_vertices(B.heightfield(spark, sf_dir)[1]).select("vid")


@query("euler_characteristic", f"{W}, u AS (SELECT s FROM half GROUP BY s) SELECT (SELECT count(*) FROM u) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM faces) AS n_faces, (SELECT count(*) FROM edges WHERE n_faces = 1) AS n_boundary, (SELECT count(*) FROM u) - (SELECT count(*) FROM edges) + (SELECT count(*) FROM faces) AS euler")
def euler_characteristic(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.counts(v, f).drop("mesh_id")


@query("unreferenced_vertices", f"{W}, g AS (SELECT * FROM faces WHERE fid % 5 = 0) SELECT vid FROM verts WHERE vid NOT IN (SELECT v0 FROM g UNION ALL SELECT v1 FROM g UNION ALL SELECT v2 FROM g)")
def unreferenced_vertices(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.unreferenced(v, f.where("fid % 5 = 0")).select("vid")


@query("face_normals", f"{W}, {_UNIT} SELECT fid, {sql6('nx')} AS nx, {sql6('ny')} AS ny, {sql6('nz')} AS nz FROM nrm")
def face_normals(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.face_normals(f, v).select("fid", *(r6(F.col("n" + k)).alias("n" + k) for k in "xyz"))


_VN = f"{W}, {_UNIT}, {_CORNERS}, s AS (SELECT vid, sum(w*nx) AS sx, sum(w*ny) AS sy, sum(w*nz) AS sz FROM crn GROUP BY vid)"


@query("vertex_normals", f"{_VN} SELECT vid, {', '.join(f'{sql6(f's{k} / sqrt(sx*sx+sy*sy+sz*sz)')} AS n{k}' for k in 'xyz')} FROM s")
def vertex_normals(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.vertex_normals(f, v).select("vid", *(r6(F.col("n" + k)).alias("n" + k) for k in "xyz"))


@query("dihedral_angles", f"{W}, {_UNIT}, hf AS (SELECT least(s, e) AS e0, greatest(s, e) AS e1, h.fid, nx, ny, nz FROM half h JOIN nrm USING (fid)) SELECT a.e0, a.e1, {sql6('acos(greatest(-1.0, least(1.0, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))')} AS angle FROM hf a JOIN hf b ON a.e0 = b.e0 AND a.e1 = b.e1 AND a.fid < b.fid")
def dihedral_angles(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.dihedral_angles(f, v).select("e0", "e1", r6(F.col("angle")).alias("angle"))


@query("edge_length_stats", f"{W}, l AS (SELECT sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) AS len FROM edges JOIN verts a ON a.vid = e0 JOIN verts b ON b.vid = e1) SELECT count(*) AS n, {sql6('min(len)')} AS shortest, {sql6('avg(len)')} AS mean, {sql6('max(len)')} AS longest FROM l")
def edge_length_stats(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.edge_lengths(f, v).agg(F.count("*").alias("n"), r6(F.min("length")).alias("shortest"), r6(F.avg("length")).alias("mean"), r6(F.max("length")).alias("longest"))


@query("vertex_min_angles", f"{W}, {_UNIT}, {_CORNERS}, f AS (SELECT fid, min(w) AS a FROM crn GROUP BY fid) SELECT vid, {sql6('avg(a)')} AS value FROM crn JOIN f USING (fid) GROUP BY vid")
def vertex_min_angles(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    value = mesh.placed(f, v).select("mesh_id", "fid", G.min_angle(V.vec("a"), V.vec("b"), V.vec("c")).alias("value"))
    return mesh.face_to_vertex(f, value).select("vid", r6(F.col("value")).alias("value"))


@query("vertex_areas", f"{W}, {_UNIT}, {_CORNERS} SELECT vid, {sql6('sum(area) / 3')} AS area FROM crn GROUP BY vid")
def vertex_areas(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.barycentric_areas(f, v).select("vid", r6(F.col("area")).alias("area"))


@query("gauss_curvature", f"{W}, {_UNIT}, {_CORNERS}, b AS (SELECT e0 AS vid FROM edges WHERE n_faces = 1 UNION SELECT e1 FROM edges WHERE n_faces = 1) SELECT vid, {sql6('(2 * pi() - sum(w)) / (sum(area) / 3)')} AS gauss FROM crn WHERE vid NOT IN (SELECT vid FROM b) GROUP BY vid")
def gauss_curvature(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.angle_defects(f, v).select("vid", r6(F.col("gauss")).alias("gauss"))


@query("smoothed_mesh", f"{W}, nb AS (SELECT e0 AS vid, e1 AS o FROM edges UNION ALL SELECT e1, e0 FROM edges), b AS (SELECT e0 AS vid FROM edges WHERE n_faces = 1 UNION SELECT e1 FROM edges WHERE n_faces = 1), m AS (SELECT nb.vid, avg(q.x) AS mx, avg(q.y) AS my, avg(q.z) AS mz FROM nb JOIN verts q ON q.vid = o WHERE nb.vid NOT IN (SELECT vid FROM b) GROUP BY nb.vid) SELECT p.vid, {', '.join(f'{sql6(f'CASE WHEN m{k} IS NULL THEN p.{k} ELSE p.{k} + 0.5 * (m{k} - p.{k}) END')} AS {k}' for k in 'xyz')} FROM verts p LEFT JOIN m USING (vid)")
def smoothed_mesh(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return mesh.umbrella(f, v, 0.5).select("vid", *(r6(F.col(k)).alias(k) for k in "xyz"))


@query("subdivided_mesh", f"{W} SELECT (SELECT count(*) FROM verts) + (SELECT count(*) FROM edges) AS n_vertices, 4 * (SELECT count(*) FROM faces) AS n_faces, {sql6('(SELECT avg(z) FROM (SELECT z FROM verts UNION ALL SELECT (a.z + b.z) / 2 FROM edges JOIN verts a ON a.vid = e0 JOIN verts b ON b.vid = e1))')} AS mean_z, 4 * (SELECT count(*) FROM faces) * 3 - (2 * (SELECT count(*) FROM edges) + 3 * (SELECT count(*) FROM faces)) AS shared")
def subdivided_mesh(spark, sf_dir):
    """Sizes after a midpoint subdivision; `shared` counts the edges that two faces share."""
    v, f = mesh.subdivide(*B.heightfield(spark, sf_dir))
    shared = mesh.edges(f).where("n_faces = 2").agg(F.count("*").alias("shared"))
    return v.agg(F.count("*").alias("n_vertices"), r6(F.avg("z")).alias("mean_z")).join(f.agg(F.count("*").alias("n_faces"))).join(shared)


@query("fan_triangulation", f"{W}, q AS (SELECT v AS fid, [v, v + 1, v + {B.SIDE} + 1, v + {B.SIDE}] AS vids FROM inner_cells) SELECT fid, CAST(i AS INTEGER) AS part, vids[1] AS v0, vids[i + 1] AS v1, vids[i + 2] AS v2 FROM q, (SELECT unnest([1, 2]) AS i)")
def fan_triangulation(spark, sf_dir):
    _, f = B.heightfield(spark, sf_dir)
    quads = f.where("fid % 2 = 0").select("mesh_id", (F.col("fid") / 2).cast("long").alias("fid"), F.array("v0", "v1", "v2", F.col("v0") + B.side(spark, sf_dir)).alias("vids"))
    return mesh.fan(quads).drop("mesh_id")


@query("welded_mesh", f"{W}, r AS (SELECT vid, min(vid) OVER (PARTITION BY floor(x / 2), floor(y / 2), floor(z / 50)) AS t FROM verts), g AS (SELECT fid, a.t AS v0, b.t AS v1, c.t AS v2 FROM faces JOIN r a ON a.vid = v0 JOIN r b ON b.vid = v1 JOIN r c ON c.vid = v2) SELECT fid, v0, v1, v2 FROM g WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0")
def welded_mesh(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    v = v.withColumn("z", F.col("z") / 25)
    return mesh.weld(v, f, 2.0)[1].drop("mesh_id")
