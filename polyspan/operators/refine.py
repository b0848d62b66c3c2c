"""Refined meshes, distance fields of meshes, streamlines and normals of point clouds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import mesh
from .grids import shifted
from .distances import distance_by_terms, triangle_terms
from .joins import knn_join
from .lineage import cut
from .surface import hits_above


def catmull_clark(vertices: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of Catmull-Clark on polygons (mesh_id, fid, vids): a point for each face and edge, a quad for each corner.
    New vertices have negative numbers, hashes of their edge (`mesh.edge_number`) or of their face and its corners; a clash
    raises."""
    n = F.size("vids")
    at = vertices.select("mesh_id", "vid", "x", "y", "z")
    c = polygons.select("mesh_id", "fid", "vids", n.alias("n"), (-F.xxhash64("fid", "vids").bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("own"), F.posexplode("vids").alias("k", "vid"))
    c = c.select("mesh_id", "fid", "own", "n", "k", "vid", F.col("vids")[F.pmod(F.col("k") + 1, "n")].alias("to"), F.col("vids")[F.pmod(F.col("k") - 1, "n")].alias("back"))
    middle = cut(c.join(at, ["mesh_id", "vid"]).groupBy("mesh_id", "fid", "own").agg(*(F.avg(k).alias("f" + k) for k in "xyz")))
    held = c.join(middle.drop("own"), ["mesh_id", "fid"])
    e = held.groupBy("mesh_id", F.least("vid", "to").alias("e0"), F.greatest("vid", "to").alias("e1")).agg(F.count("*").alias("n_faces"), *(F.sum("f" + k).alias("f" + k) for k in "xyz"))
    for i in (0, 1):
        e = e.join(at.select("mesh_id", F.col("vid").alias(f"e{i}"), *(F.col(k).alias(f"p{i}{k}") for k in "xyz")), ["mesh_id", f"e{i}"])
    e = cut(e)
    both = lambda k: F.col(f"p0{k}") + F.col(f"p1{k}")
    on_edge = e.select("mesh_id", mesh.edge_number(F.col("e0"), F.col("e1")).alias("vid"), *(F.when(F.col("n_faces") == 2, (both(k) + F.col("f" + k)) / 4).otherwise(both(k) / 2).alias(k) for k in "xyz"))
    on_face = middle.select("mesh_id", F.col("own").alias("vid"), *(F.col("f" + k).alias(k) for k in "xyz"))
    ends = F.array(*[F.struct(F.col(f"e{i}").alias("vid"), *(F.col(f"p{1 - i}{k}").alias(k) for k in "xyz")) for i in (0, 1)])
    rim = F.col("n_faces") <= 1
    ring = e.select("mesh_id", "n_faces", F.explode(ends).alias("q")).groupBy("mesh_id", "q.vid").agg(F.count("*").alias("m"), F.max(rim).alias("rim"), *(F.avg("q." + k).alias("a" + k) for k in "xyz"), *(F.sum(F.when(rim, F.col("q." + k))).alias("r" + k) for k in "xyz"))
    faces = held.groupBy("mesh_id", "vid").agg(*(F.avg("f" + k).alias("f" + k) for k in "xyz"))
    moved = lambda k: F.when(F.col("m").isNull(), F.col(k)).when(F.col("rim"), (6 * F.col(k) + F.col("r" + k)) / 8).otherwise((F.col("f" + k) + F.col(k) + F.col("a" + k) + (F.col("m") - 3) * F.col(k)) / F.col("m"))
    old = at.join(ring, ["mesh_id", "vid"], "left").join(faces, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(moved(k).alias(k) for k in "xyz"))
    widest = polygons.agg(F.max(n)).first()[0] or 1
    quad = F.array("vid", mesh.edge_number(F.col("vid"), F.col("to")), F.col("own"), mesh.edge_number(F.col("back"), F.col("vid")))
    return mesh.checked_numbers(old.unionByName(on_edge).unionByName(on_face)), c.select("mesh_id", (F.col("fid") * widest + F.col("k")).alias("fid"), quad.alias("vids"))


#: Nodes along a side of the tiles that `mesh_field` is dealt by.
TILE = 64


def mesh_field(triangles: DataFrame, cell: float, band: float) -> DataFrame:
    """(ix, iy, iz, value): the distance to the nearest triangle (fid, ax .. cz) at all grid nodes within `band` of one.
    Triangles go to the tiles that their boxes come near, and each finds the nodes near its box within the tile; one
    aggregate takes the least. Nodes are made and summed up where their tile lies and never sent."""
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    lo, hi = G.bounds(a, b, c)
    first = {k: F.ceil((x - band) / cell) for k, x in zip("xyz", lo, strict=True)}
    last = {k: F.floor((x + band) / cell) for k, x in zip("xyz", hi, strict=True)}
    t = triangles.select(*(p + k for p in "abc" for k in "xyz"))
    for k in "xyz":
        t = t.where(first[k] <= last[k]).withColumn("t" + k, F.explode(F.sequence(F.floor(first[k] / TILE), F.floor(last[k] / TILE))))
    tile = ["tx", "ty", "tz"]
    t = t.repartition(int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tile)
    t = triangle_terms(t, [*tile, *(F.sequence(F.greatest(first[k], F.col("t" + k) * TILE), F.least(last[k], F.col("t" + k) * TILE + TILE - 1)).alias("r" + k) for k in "xyz")])
    for k in "xyz":
        t = t.withColumn("i" + k, F.explode("r" + k)).drop("r" + k)
    t = distance_by_terms(t, tuple(F.col("i" + k) * float(cell) for k in "xyz"))
    # not a filter, which would be pushed below the terms and work them out again
    t = t.select(*tile, "ix", "iy", "iz", F.explode(F.when(F.col("d") <= band, F.array("d"))).alias("d"))
    return t.groupBy(*tile, "ix", "iy", "iz").agg(F.min("d").alias("value")).select("ix", "iy", "iz", "value")


def signed_mesh_field(triangles: DataFrame, cell: float, band: float) -> DataFrame:
    """`mesh_field` of a closed surface, negative inside: where a ray upwards meets an odd number of triangles. The rays
    start a little off their nodes, so as not to run along edges."""
    field = cut(mesh_field(triangles, cell, band))
    pid = F.concat_ws(":", "ix", "iy", "iz")
    off = {"x": 1.2345e-7, "y": 2.7183e-7, "z": 0.0}
    hits = hits_above(field.select(pid.alias("pid"), *((F.col("i" + k) * float(cell) + off[k] * cell).alias(k) for k in "xyz")), triangles, max(cell, 1e-9))
    odd = hits.where(F.col("hits") % 2 == 1).select("pid", F.lit(-1.0).alias("sign"))
    return field.withColumn("pid", pid).join(odd, "pid", "left").select("ix", "iy", "iz", (F.col("value") * F.coalesce("sign", F.lit(1.0))).alias("value"))


def streamlines(vectors: DataFrame, seeds: DataFrame, h: float, steps: int, cell: float = 1.0, order: int = 4) -> DataFrame:
    """(pid, step, x, y): lines from seeds (pid, x, y) through a vector grid (ix, iy, gx, gy), blended bilinearly, by
    Runge-Kutta of order 4 or by Euler steps (order 1). A line ends where it leaves the grid."""
    if order not in (1, 4):
        raise ValueError("order must be 1 or 4")
    cells = vectors.select("ix", "iy")
    for i, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        for g in ("gx", "gy"):
            cells = cells.join(shifted(vectors.select("ix", "iy", F.col(g).alias("value")), f"{g}{i}", ix=a, iy=b), ["ix", "iy"])
    cells = cut(cells)

    def slope(points: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
        at = points.withColumn("_x", x / cell).withColumn("_y", y / cell).withColumn("ix", F.floor("_x")).withColumn("iy", F.floor("_y")).join(cells, ["ix", "iy"])
        u, v = F.col("_x") - F.col("ix"), F.col("_y") - F.col("iy")
        blend = lambda g: F.col(g + "0") * (1 - u) * (1 - v) + F.col(g + "1") * u * (1 - v) + F.col(g + "2") * (1 - u) * v + F.col(g + "3") * u * v
        return at.select(*points.columns, blend("gx").alias(name + "x"), blend("gy").alias(name + "y"))

    state = seeds.select("pid", F.lit(0).alias("step"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = state
    for step in range(1, steps + 1):
        now = slope(state, F.col("x"), F.col("y"), "k1")
        if order == 4:
            for name, last, share in (("k2", "k1", 0.5), ("k3", "k2", 0.5), ("k4", "k3", 1.0)):
                now = slope(now, F.col("x") + share * h * F.col(last + "x"), F.col("y") + share * h * F.col(last + "y"), name)
        mean = lambda a: (F.col("k1" + a) + 2 * F.col("k2" + a) + 2 * F.col("k3" + a) + F.col("k4" + a)) / 6 if order == 4 else F.col("k1" + a)
        state = cut(now.select("pid", F.lit(step).alias("step"), *((F.col(a) + h * mean(a)).alias(a) for a in "xy")))
        out = out.unionByName(state)
    return out


def smallest_axes(moments: DataFrame) -> DataFrame:
    """A table with the entries xx, xy, xz, yy, yz, zz of symmetric matrices, and (nx, ny, nz): the unit eigenvector of the
    least eigenvalue by the trigonometric formula, with its last coordinate that is not 0 above it; null where it is
    not unique. Every step is a column of its own, so that none is computed twice."""
    m = {a + b: F.col(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]}
    d = {k: F.col("_" + k) for k in "xyz"}
    out = moments.withColumn("_q", (m["xx"] + m["yy"] + m["zz"]) / 3).select("*", *((m[k + k] - F.col("_q")).alias("_" + k) for k in "xyz"))
    square = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])
    det = d["x"] * (d["y"] * d["z"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * d["z"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - d["y"] * m["xz"])
    p = F.col("_p")
    out = out.withColumn("_p", F.sqrt(square / 6)).withColumn("_turn", F.acos(G.clamp(F.try_divide(det, 2 * p * p * p), -1.0, 1.0)) / 3)
    out = out.withColumn("_least", 2 * p * F.cos(F.col("_turn") + 2 * math.pi / 3)).select("*", *((d[k] - F.col("_least")).alias("_r" + k) for k in "xyz"))
    rows = [(F.col("_rx"), m["xy"], m["xz"]), (m["xy"], F.col("_ry"), m["yz"]), (m["xz"], m["yz"], F.col("_rz"))]
    crosses = [V.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    out = out.select("*", *(x.alias(f"_c{i}{k}") for i, v in enumerate(crosses) for k, x in zip("xyz", v, strict=True)))
    found = [F.struct(V.sqrnorm(V.vec(f"_c{i}")).alias("size"), *(F.col(f"_c{i}{k}").alias(k) for k in "xyz")) for i in range(3)]
    best = F.col("_best")
    sign = F.when(best["z"] != 0, F.signum(best["z"])).when(best["y"] != 0, F.signum(best["y"])).otherwise(F.signum(best["x"]))
    out = out.withColumn("_best", F.greatest(*found)).withColumn("_by", F.when(best["size"] > 1e-12 * p * p * p * p, sign / F.sqrt(best["size"])))
    return out.select(*moments.columns, *((F.col("_by") * best[k]).alias("n" + k) for k in "xyz"))


def cloud_normals(points: DataFrame, k: int, cell: float) -> DataFrame:
    """(pid, nx, ny, nz): across the plane of least squares through each point and its k nearest, upwards; null for
    points whose neighbours lie on a line."""
    near = knn_join(points, points, k, cell).select("pid", "other").unionByName(points.select("pid", F.col("pid").alias("other")))
    at = near.join(points.select(F.col("pid").alias("other"), "x", "y", "z"), "other")
    moments = at.groupBy("pid").agg(*(F.covar_pop(a, b).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]))
    return smallest_axes(moments).select("pid", "nx", "ny", "nz")
