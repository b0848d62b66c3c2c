"""Queries of creased normals, the Laplacian over Voronoi areas, and samples with normals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normals
from . import bindings as B
from .aggregate_queries import _HASH
from .mesh_queries import _CORNERS, _UNIT, _VN, W
from .registry import query
from .scalar_queries import r6, sql6
from .shape_queries import _voronoi_parts
from .surface_queries import _COT

_CREASE = 0.5
_LENGTH = "sqrt(sx*sx + sy*sy + sz*sz)"


@query("corner_normals", f"{W}, {_UNIT}, {_CORNERS}, s AS (SELECT a.fid, a.vid, {', '.join(f'sum(b.w * b.n{k}) AS s{k}' for k in 'xyz')} FROM crn a JOIN crn b ON b.vid = a.vid AND a.nx*b.nx + a.ny*b.ny + a.nz*b.nz >= cos({_CREASE}) GROUP BY 1, 2) SELECT fid, vid, {', '.join(f'{sql6(f's{k} / {_LENGTH}')} AS n{k}' for k in 'xyz')} FROM s")
def corner_normals(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return normals.corner_normals(f, v, _CREASE).select("fid", "vid", *(r6(F.col("n" + k)).alias("n" + k) for k in "xyz"))


@query("laplace_voronoi", f"{W}, {_COT}, o AS (SELECT e0 AS vid, e1 AS q, w FROM cw UNION ALL SELECT e1, e0, w FROM cw), l AS (SELECT o.vid, {', '.join(f'sum(w * (q.{k} - p.{k})) AS s{k}' for k in 'xyz')} FROM o JOIN verts p ON p.vid = o.vid JOIN verts q ON q.vid = o.q GROUP BY o.vid), va AS (SELECT vid, sum(area) AS area FROM ({_voronoi_parts()}) GROUP BY vid) SELECT vid, {', '.join(f'{sql6(f's{k} / (2 * area)')} AS l{k}' for k in 'xyz')} FROM l JOIN va USING (vid)")
def laplace_voronoi(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return normals.laplace_voronoi(f, v).select("vid", *(r6(F.col("l" + k)).alias("l" + k) for k in "xyz"))


@query("oriented_sample", f"{_VN} SELECT vid, {', '.join(f'{sql6(k)} AS {k}' for k in 'xyz')}, {', '.join(f'{sql6(f's{k} / {_LENGTH}')} AS n{k}' for k in 'xyz')} FROM verts JOIN s USING (vid) ORDER BY {_HASH.format(seed=9).replace('pid', chr(39) + '0:' + chr(39) + ' || vid')}, vid LIMIT 60")
def oriented_sample(spark, sf_dir):
    """Sixty vertices of the mesh with their normals."""
    v, f = B.heightfield(spark, sf_dir)
    return normals.oriented_sample(f, v, 60, seed=9).select("vid", *(r6(F.col(k)).alias(k) for k in ("x", "y", "z", "nx", "ny", "nz")))
