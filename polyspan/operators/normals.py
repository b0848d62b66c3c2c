"""Normals of corners up to a crease, samples with normals, and the Laplacian over Voronoi areas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import mesh, sampling, shapes, surface
from .lineage import cut


def corner_normals(faces: DataFrame, vertices: DataFrame, crease: float) -> DataFrame:
    """(mesh_id, fid, vid, nx, ny, nz): at each corner of a triangle the mean of the normals of the faces around its vertex that
    turn from the triangle's own by at most `crease` (in radians), by the angles of their corners, normalised; under 0.01
    the triangle's normal, from pi the vertex's. A triangle without an area has the normal zero, and adds nothing.

    Corners of a vertex meet each other, so rows grow with the square of the faces around one vertex."""
    if crease < 0.01:
        own = mesh.corners(faces).select("mesh_id", "fid", "vid")
        return own.join(mesh.face_normals(faces, vertices), ["mesh_id", "fid"])
    if crease >= math.pi:
        return mesh.corners(faces).select("mesh_id", "fid", "vid").join(mesh.vertex_normals(faces, vertices), ["mesh_id", "vid"])
    t = mesh.placed(faces, vertices)
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    each = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), w.alias("w")) for k, w in enumerate(G.corner_angles(a, b, c))])
    at = t.select("mesh_id", "fid", *(p.alias("n" + k) for k, p in zip("xyz", n, strict=True)), F.explode(each).alias("c")).select("mesh_id", "fid", "c.vid", "c.w", "nx", "ny", "nz")
    other = at.select("mesh_id", "vid", F.col("w").alias("ow"), *(F.col("n" + k).alias("o" + k) for k in "xyz"))
    near = at.join(other, ["mesh_id", "vid"]).where(V.dot(V.vec("n"), V.vec("o")) >= math.cos(crease))
    sums = near.groupBy("mesh_id", "fid", "vid").agg(*(F.sum(F.col("ow") * F.col("o" + k)).alias("s" + k) for k in "xyz"))
    all_ = at.select("mesh_id", "fid", "vid").join(sums, ["mesh_id", "fid", "vid"], "left")
    unit = V.normalize(tuple(F.coalesce("s" + k, F.lit(0.0)) for k in "xyz"))
    return all_.select("mesh_id", "fid", "vid", *(p.alias("n" + k) for k, p in zip("xyz", unit, strict=True)))


def laplace_voronoi(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, lx, ly, lz): the cotangent-weighted sum of the ways to the neighbours over twice the Voronoi area, at all
    vertices of faces; null where that area is 0."""
    w = surface.cotan_weights(faces, vertices)
    both = w.unionByName(w.select("mesh_id", F.col("e1").alias("e0"), F.col("e0").alias("e1"), "w"))
    at = vertices.select("mesh_id", F.col("vid").alias("e0"), *(F.col(k).alias("p" + k) for k in "xyz"))
    to = vertices.select("mesh_id", F.col("vid").alias("e1"), *(F.col(k).alias("q" + k) for k in "xyz"))
    sums = both.join(at, ["mesh_id", "e0"]).join(to, ["mesh_id", "e1"]).groupBy("mesh_id", F.col("e0").alias("vid")).agg(*(F.sum(F.col("w") * (F.col("q" + k) - F.col("p" + k))).alias("s" + k) for k in "xyz"))
    areas = shapes.voronoi_areas(mesh.placed(faces, vertices))
    return sums.join(areas, ["mesh_id", "vid"]).select("mesh_id", "vid", *(F.try_divide("s" + k, 2 * F.col("area")).alias("l" + k) for k in "xyz"))


def oriented_sample(faces: DataFrame, vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(mesh_id, vid, x, y, z, nx, ny, nz): n vertices of all meshes, each set of n as likely, with their normals; a vertex of no
    face has the normal zero. Only the faces around the sample are measured."""
    order = sampling.unit_hash(F.col("mesh_id"), F.col("vid"), seed=seed)
    kept = cut(vertices.select("mesh_id", "vid", "x", "y", "z").orderBy(order, "mesh_id", "vid").limit(n))
    around = mesh.corners(faces).join(kept.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid").distinct()
    found = mesh.vertex_normals(faces.join(around, ["mesh_id", "fid"], "left_semi"), vertices)
    return kept.join(found, ["mesh_id", "vid"], "left").select("mesh_id", "vid", "x", "y", "z", *(F.coalesce("n" + k, F.lit(0.0)).alias("n" + k) for k in "xyz"))
