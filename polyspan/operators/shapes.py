"""Shapes from parameters, 3D grids, isosurfaces and nearest triangles.

Generators explode a parameter grid for every centre, so many shapes and fine ones are made alike by all tasks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from .nearest import nearest_triangle  # noqa: F401
from .order import numbered  # noqa: F401


def _grid_faces(nu: int, nv: int, loop_u: bool, loop_v: bool, twist: bool = False) -> Column:
    """Triangles of a parameter grid of nu x nv points (vid = i * nv + j), as an array of structs (fid, v0, v1, v2)."""
    faces = []
    for i, j in itertools.product(range(nu if loop_u else nu - 1), range(nv if loop_v else nv - 1)):
        k, m = (i + 1) % nu, (j + 1) % nv
        across = lambda r, c, last=i + 1 == nu: r * nv + (nv - 1 - c if twist and last else c)
        a, b, c, d = i * nv + j, across(k, j), across(k, m), i * nv + m
        faces += [(a, b, c), (a, c, d)]
    return F.array(*[F.struct(F.lit(i).cast("long").alias("fid"), *(F.lit(v).cast("long").alias(f"v{k}") for k, v in enumerate(f))) for i, f in enumerate(faces)])


def parametric(centres: DataFrame, nu: int, nv: int, point, loop_u: bool = False, loop_v: bool = False, twist: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a surface around each centre (mesh_id, x, y, z, r): point(u, v, r) gives offsets for u and v in
    [0, 1], open at 1 where they loop."""
    i, j = F.floor(F.col("_k") / nv), F.pmod("_k", F.lit(nv))
    u, v = i / (nu if loop_u else max(1, nu - 1)), j / (nv if loop_v else max(1, nv - 1))
    rows = centres.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(nu * nv - 1))))
    vertices = rows.select("mesh_id", F.col("_k").cast("long").alias("vid"), *((F.col(k) + d).alias(k) for k, d in zip("xyz", point(u, v, F.col("r")), strict=True)))
    faces = centres.select("mesh_id", F.explode(_grid_faces(nu, nv, loop_u, loop_v, twist)).alias("f")).select("mesh_id", "f.*")
    return vertices, faces


_TURN = 2 * math.pi
#: Offsets of surfaces of size r for parameters u and v.
SURFACES = {
    "plane": (lambda u, v, r: (r * (u - 0.5), r * (v - 0.5), F.lit(0.0)), {}),
    "torus": (lambda u, v, r: ((r + r / 3 * F.cos(_TURN * v)) * F.cos(_TURN * u), (r + r / 3 * F.cos(_TURN * v)) * F.sin(_TURN * u), r / 3 * F.sin(_TURN * v)), {"loop_u": True, "loop_v": True}),
    "sphere": (lambda u, v, r: (r * F.sin(math.pi * v) * F.cos(_TURN * u), r * F.sin(math.pi * v) * F.sin(_TURN * u), r * F.cos(math.pi * v)), {"loop_u": True}),
    "cone": (lambda u, v, r: (r * (1 - v) * F.cos(_TURN * u), r * (1 - v) * F.sin(_TURN * u), r * v), {"loop_u": True}),
    "mobius": (lambda u, v, r: ((r + r * (v - 0.5) * F.cos(math.pi * u)) * F.cos(_TURN * u), (r + r * (v - 0.5) * F.cos(math.pi * u)) * F.sin(_TURN * u), r * (v - 0.5) * F.sin(math.pi * u)), {"loop_u": True, "twist": True}),
}


def surface(centres: DataFrame, name: str, nu: int, nv: int) -> tuple[DataFrame, DataFrame]:
    point, options = SURFACES[name]
    return parametric(centres, nu, nv, point, **options)


#: Points of closed curves of size r for a parameter t in [0, 1).
CURVES = {
    "circle": lambda t, r: (r * F.cos(_TURN * t), r * F.sin(_TURN * t)),
    "sine_circle": lambda t, r: (r * (1 + 0.1 * F.sin(5 * _TURN * t)) * F.cos(_TURN * t), r * (1 + 0.1 * F.sin(5 * _TURN * t)) * F.sin(_TURN * t)),
    "hyper_ellipse": lambda t, r: tuple(r * F.signum(c) * F.sqrt(F.abs(c)) for c in (F.cos(_TURN * t), F.sin(_TURN * t))),
    "rectangle": lambda t, r: tuple(r * G.clamp(4 * F.abs(F.pmod(t + s, F.lit(1.0)) - 0.5) - 1, -0.5, 0.5) * 2 for s in (0.0, 0.25)),
}


def curve(centres: DataFrame, name: str, n: int, turn: float = 1.0) -> DataFrame:
    """polyline (curve_id, seq, x, y) around each centre (curve_id, x, y, r); a part of a turn gives an arc."""
    t = F.col("seq") / n * turn
    rows = centres.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.select("curve_id", "seq", *((F.col(k) + d).alias(k) for k, d in zip("xy", CURVES[name](t, F.col("r")), strict=True)))


def filtered_circles(circles: DataFrame, by: str = "cloud_id") -> DataFrame:
    """Circles (by, pid, x, y, r) that lie in no larger one of their group (ties: of the smaller id). Cells have the side
    of the largest radius, so a holder's centre is in a neighbouring cell."""
    widest = circles.agg(F.max("r")).first()[0] or 1.0
    at = [F.floor(F.col(k) / widest) for k in "xy"]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = circles.withColumn("_s", F.explode(steps)).select(by, "pid", "x", "y", "r", (at[0] + F.col("_s.a")).alias("cx"), (at[1] + F.col("_s.b")).alias("cy"))
    other = circles.select(by, F.col("pid").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("r").alias("orad"), at[0].alias("cx"), at[1].alias("cy"))
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    bigger = (F.col("orad") > F.col("r")) | ((F.col("orad") == F.col("r")) & (F.col("o") < F.col("pid")))
    inside = near.join(other, [by, "cx", "cy"]).where(bigger & (d + F.col("r") <= F.col("orad"))).select("pid").distinct()
    return circles.join(inside, "pid", "left_anti")


_CORNERS = list(itertools.product((0, 1), repeat=3))


def _shift3(grid: DataFrame, name: str, step: tuple[int, int, int]) -> DataFrame:
    return grid.select(*((F.col("i" + k) - d).alias("i" + k) for k, d in zip("xyz", step, strict=True)), F.col("value").alias(name))


def gradient3(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """(ix, iy, iz, gx, gy, gz): central differences at nodes with all six neighbours."""
    out = grid.select("ix", "iy", "iz")
    for axis, k in enumerate("xyz"):
        for name, d in (("_u" + k, 1), ("_d" + k, -1)):
            out = out.join(_shift3(grid, name, tuple(d if a == axis else 0 for a in range(3))), ["ix", "iy", "iz"])
    return out.select("ix", "iy", "iz", *(((F.col("_u" + k) - F.col("_d" + k)) / (2 * cell)).alias("g" + k) for k in "xyz"))


def _cells(grid: DataFrame) -> DataFrame:
    """Whole cells: the lower node's place and the values c000 .. c111 of the eight corners."""
    steps = F.array(*[F.struct(*(F.lit(d).alias("d" + k) for k, d in zip("xyz", s, strict=True)), F.lit("c" + "".join(map(str, s))).alias("n")) for s in _CORNERS])
    rows = grid.withColumn("_s", F.explode(steps)).select(*((F.col("i" + k) - F.col("_s.d" + k)).alias("i" + k) for k in "xyz"), "_s.n", "value")
    held = rows.groupBy("ix", "iy", "iz").agg(F.count("*").alias("_m"), *(F.max(F.when(F.col("n") == F.lit(n), F.col("value"))).alias(n) for n in ("c" + "".join(map(str, s)) for s in _CORNERS)))
    return held.where("_m = 8").drop("_m")


def trilinear(grid: DataFrame, points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points (pid, x, y, z) with `sample`: the blend of the eight nodes around each; null where one is missing."""
    at = points.select("pid", *((F.col(k) / cell).alias("_" + k) for k in "xyz")).select("*", *(F.floor("_" + k).alias("i" + k) for k in "xyz"))
    joined = at.join(_cells(grid), ["ix", "iy", "iz"], "left")
    u = {k: F.col("_" + k) - F.col("i" + k) for k in "xyz"}
    part = lambda s: F.col("c" + "".join(map(str, s))) * math.prod((u[k] if d else 1 - u[k] for k, d in zip("xyz", s, strict=True)), start=F.lit(1.0))
    return joined.select("pid", sum((part(s) for s in _CORNERS[1:]), part(_CORNERS[0])).alias("sample"))


def blur3(grid: DataFrame, weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> DataFrame:
    """(ix, iy, iz, value): a separable blur over the nodes that exist, weights normalised to those."""
    half, out, nodes = len(weights) // 2, grid.select("ix", "iy", "iz", "value"), grid.select("ix", "iy", "iz")
    for axis in ("ix", "iy", "iz"):
        steps = F.array(*[F.struct(F.lit(d - half).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights)])
        spread = out.withColumn("_s", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("_s.d"))
        out = spread.groupBy("ix", "iy", "iz").agg((F.sum(F.col("_s.w") * F.col("value")) / F.sum("_s.w")).alias("value")).join(nodes, ["ix", "iy", "iz"], "left_semi")
    return out


#: The six tetrahedra of a cube that share its long diagonal: one for each order of the axes.
_TETRAHEDRA = [[(0, 0, 0), *list(itertools.accumulate((tuple(int(a == k) for a in range(3)) for k in order), lambda p, q: tuple(x + y for x, y in zip(p, q))))] for order in itertools.permutations(range(3))]


def isosurface(grid: DataFrame, level: float, cell: float = 1.0) -> DataFrame:
    """Triangles (ix, iy, iz, tet, part, ax .. cz) where a field (ix, iy, iz, value) crosses `level`, by marching through six
    tetrahedra a cell. Cells meet in the same points, so the surface closes. Orientation is not set."""
    tets = F.array(*[F.array(*[F.struct(F.col("c" + "".join(map(str, p))).alias("v"), *((F.col("i" + k) + d).cast("double").alias(k) for k, d in zip("xyz", p, strict=True))) for p in t]) for t in _TETRAHEDRA])
    low, high = F.least(*(F.col("c" + "".join(map(str, s))) for s in _CORNERS)), F.greatest(*(F.col("c" + "".join(map(str, s))) for s in _CORNERS))
    rows = _cells(grid).where((low < level) & (high >= level)).select("ix", "iy", "iz", F.posexplode(tets).alias("tet", "t"))
    rows = rows.select("ix", "iy", "iz", "tet", F.filter("t", lambda p: p["v"] >= level).alias("up"), F.filter("t", lambda p: p["v"] < level).alias("down"))

    def between(p: Column, r: Column) -> Column:
        s = (F.lit(level) - p["v"]) / (r["v"] - p["v"])
        return F.struct(*(((p[k] + s * (r[k] - p[k])) * cell).alias(k) for k in "xyz"))

    one = lambda a, many: F.array(F.array(*[between(a[0], many[i]) for i in range(3)]))
    u, d = F.col("up"), F.col("down")
    q = [between(u[0], d[0]), between(u[0], d[1]), between(u[1], d[1]), between(u[1], d[0])]
    two = F.array(F.array(q[0], q[1], q[2]), F.array(q[0], q[2], q[3]))
    made = F.when(F.size(u) == 1, one(u, d)).when(F.size(d) == 1, one(d, u)).when(F.size(u) == 2, two)
    out = rows.where((F.size("up") > 0) & (F.size("down") > 0)).select("ix", "iy", "iz", "tet", F.posexplode(made).alias("part", "f"))
    return out.select("ix", "iy", "iz", "tet", "part", *(F.col("f")[i][k].alias(p + k) for i, p in enumerate("abc") for k in "xyz"))


def voronoi_areas(placed: DataFrame) -> DataFrame:
    """(mesh_id, vid, area) of faces with corners: the part of each triangle that is nearest to a corner; of an obtuse
    triangle half for the obtuse corner and a quarter for each other."""
    points = [V.vec(p) for p in "abc"]
    area = G.triangle_area(*points)
    parts = []
    for k in range(3):
        p, r, s = points[k], points[(k + 1) % 3], points[(k + 2) % 3]
        cot = lambda at, x, y: F.try_divide(V.dot(V.minus(x, at), V.minus(y, at)), V.norm(V.cross(V.minus(x, at), V.minus(y, at))))
        round_ = (V.sqrnorm(V.minus(r, p)) * cot(s, p, r) + V.sqrnorm(V.minus(s, p)) * cot(r, p, s)) / 8
        blunt = lambda at, x, y: V.dot(V.minus(x, at), V.minus(y, at)) < 0
        part = F.when(blunt(p, r, s), area / 2).when(blunt(r, p, s) | blunt(s, p, r), area / 4).otherwise(round_)
        parts.append(F.struct(F.col(f"v{k}").alias("vid"), F.coalesce(part, F.lit(0.0)).alias("area")))
    return placed.select("mesh_id", F.explode(F.array(*parts)).alias("p")).groupBy("mesh_id", "p.vid").agg(F.sum("p.area").alias("area"))
