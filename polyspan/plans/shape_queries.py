"""Generated shapes, 3D grids, isosurfaces and nearest triangles."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import mesh, shapes
from . import bindings as B
from .mesh_queries import W
from .registry import query
from .scalar_queries import r6, sql6
from .surface_queries import _cot

P = f"WITH p AS ({B.CLOUD}), c AS (SELECT *, 1 + abs(x) AS r FROM p)"


def _centres(spark, sf_dir, name: str = "mesh_id"):
    return B.cloud(spark, sf_dir).select(F.col("pid").alias(name), "x", "y", "z", (1 + F.abs("x")).alias("r"))


#: SQL for the offsets of shapes.SURFACES, and whether u and v loop.
_OFFSETS = {
    "plane": (("r * (u - 0.5)", "r * (v - 0.5)", "0"), 0, 0),
    "torus": (("(r + r / 3 * cos(2 * pi() * v)) * cos(2 * pi() * u)", "(r + r / 3 * cos(2 * pi() * v)) * sin(2 * pi() * u)", "r / 3 * sin(2 * pi() * v)"), 1, 1),
    "sphere": (("r * sin(pi() * v) * cos(2 * pi() * u)", "r * sin(pi() * v) * sin(2 * pi() * u)", "r * cos(pi() * v)"), 1, 0),
    "cone": (("r * (1 - v) * cos(2 * pi() * u)", "r * (1 - v) * sin(2 * pi() * u)", "r * v"), 1, 0),
    "mobius": (("(r + r * (v - 0.5) * cos(pi() * u)) * cos(2 * pi() * u)", "(r + r * (v - 0.5) * cos(pi() * u)) * sin(2 * pi() * u)", "r * (v - 0.5) * sin(pi() * u)"), 1, 0),
}
_NU, _NV = 8, 5


def _surface_sql(name: str) -> str:
    offsets, u, v = _OFFSETS[name]
    at = ", ".join(f"round({k} + {o}, 5) AS {k}" for k, o in zip("xyz", offsets, strict=True))
    return f"{P}, k AS (SELECT c.*, CAST(k AS BIGINT) AS vid, (k // {_NV}) / CAST({_NU if u else _NU - 1} AS DOUBLE) AS u, (k % {_NV}) / CAST({_NV if v else _NV - 1} AS DOUBLE) AS v FROM c, range({_NU * _NV}) t(k)) SELECT pid AS mesh_id, vid, {at} FROM k"


def _add_surface(name: str) -> None:
    @query(f"{name}_vertices", _surface_sql(name))
    def vertices(spark, sf_dir):
        v, _ = shapes.surface(_centres(spark, sf_dir), name, _NU, _NV)
        return v.select("mesh_id", "vid", *(F.round(k, 5).alias(k) for k in "xyz"))


for _name in _OFFSETS:
    _add_surface(_name)


def _topology(name: str, counts: tuple[int, int, int, int]):
    v, e, f, b = counts

    @query(f"{name}_topology", f"WITH p AS ({B.CLOUD}) SELECT pid AS mesh_id, CAST({v} AS BIGINT) AS n_vertices, CAST({e} AS BIGINT) AS n_edges, CAST({f} AS BIGINT) AS n_faces, CAST({b} AS BIGINT) AS n_boundary, CAST({v - e + f} AS BIGINT) AS euler FROM p")
    def topology(spark, sf_dir):
        return mesh.counts(*shapes.surface(_centres(spark, sf_dir), name, _NU, _NV)).select("mesh_id", "n_vertices", "n_edges", "n_faces", "n_boundary", "euler")


# a torus closes; a plane has one rim; a Moebius strip has one rim and no inside
_topology("torus", (_NU * _NV, 3 * _NU * _NV, 2 * _NU * _NV, 0))
_topology("plane", (_NU * _NV, 3 * (_NU - 1) * (_NV - 1) + _NU - 1 + _NV - 1, 2 * (_NU - 1) * (_NV - 1), 2 * (_NU - 1 + _NV - 1)))
_topology("mobius", (_NU * _NV, 3 * _NU * (_NV - 1) + _NU, 2 * _NU * (_NV - 1), 2 * _NU))

_T = "2 * pi() * t"
_CURVES = {
    "circle": (f"r * cos({_T})", f"r * sin({_T})"),
    "sine_circle": (f"r * (1 + 0.1 * sin(5 * {_T})) * cos({_T})", f"r * (1 + 0.1 * sin(5 * {_T})) * sin({_T})"),
    "hyper_ellipse": tuple(f"r * sign({c}({_T})) * sqrt(abs({c}({_T})))" for c in ("cos", "sin")),
    "rectangle": tuple(f"2 * r * greatest(-0.5, least(0.5, 4 * abs((t + {s}) % 1.0 - 0.5) - 1))" for s in ("CAST(0.0 AS DOUBLE)", "CAST(0.25 AS DOUBLE)")),
}


def _add_curve(name: str, n: int = 10) -> None:
    x, y = _CURVES[name]

    @query(f"{name}_curves", f"{P}, k AS (SELECT c.*, CAST(k AS BIGINT) AS seq, k / CAST({n} AS DOUBLE) AS t FROM c, range({n}) g(k)) SELECT pid AS curve_id, seq, round(x + {x}, 5) + 0.0 AS x, round(y + {y}, 5) + 0.0 AS y FROM k")
    def points(spark, sf_dir):
        found = shapes.curve(_centres(spark, sf_dir, "curve_id"), name, n)
        return found.select("curve_id", "seq", *((F.round(k, 5) + 0.0).alias(k) for k in "xy"))


for _name in ("circle", "sine_circle", "rectangle"):
    _add_curve(_name)
_add_curve("hyper_ellipse", 7)  # no point where a sine is nothing but rounding


@query("filtered_circles", f"WITH p AS ({B.CLOUD}), c AS (SELECT *, 0.1 + abs(z) / 4 AS r FROM p) SELECT pid FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.cloud_id = a.cloud_id AND (b.r > a.r OR (b.r = a.r AND b.pid < a.pid)) AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + a.r <= b.r)")
def filtered_circles(spark, sf_dir):
    return shapes.filtered_circles(B.cloud(spark, sf_dir).withColumn("r", 0.1 + F.abs("z") / 4)).select("pid")


V = f"WITH {B.VOLUME}"


def _near(name: str, step: tuple[int, int, int], kind: str = "JOIN") -> str:
    return f"{kind} vol {name} ON " + " AND ".join(f"{name}.i{k} = g.i{k} + {d}" for k, d in zip("xyz", step, strict=True))


_STEPS = ", ".join(f"({', '.join(str(d if a == i else 0) for a in range(3))}, '{k}', {d})" for i, k in enumerate("xyz") for d in (1, -1))


@query("grid3_gradient", f"{V}, n AS (SELECT ix - dx AS ix, iy - dy AS iy, iz - dz AS iz, axis, sgn * value AS v FROM vol, (VALUES {_STEPS}) s(dx, dy, dz, axis, sgn)), m AS (SELECT ix, iy, iz, " + ", ".join(f"round(sum(v) FILTER (axis = '{k}') / 2, 6) AS g{k}" for k in "xyz") + " FROM n GROUP BY 1, 2, 3 HAVING count(*) = 6) SELECT m.* FROM m SEMI JOIN vol USING (ix, iy, iz)")
def grid3_gradient(spark, sf_dir):
    return shapes.gradient3(B.volume(spark, sf_dir)).select("ix", "iy", "iz", *(r6(F.col("g" + k)).alias("g" + k) for k in "xyz"))


def _blur_sql(source: str, axis: str) -> str:
    on = " AND ".join(f"n.i{k} = g.i{k}" + (" + d" if k == axis else "") for k in "xyz")
    return f"(SELECT g.ix, g.iy, g.iz, sum(w * n.value) / sum(w) AS value FROM {source} g, s JOIN {source} n ON {on} GROUP BY 1, 2, 3)"


@query("grid3_blur", f"{V}, s AS (SELECT d, CAST(w AS DOUBLE) AS w FROM (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) t(d, w)), a AS {_blur_sql('vol', 'x')}, b AS {_blur_sql('a', 'y')}, e AS {_blur_sql('b', 'z')} SELECT ix, iy, iz, round(value, 9) AS value FROM e")
def grid3_blur(spark, sf_dir):
    return shapes.blur3(B.volume(spark, sf_dir)).withColumn("value", F.round("value", 9))


_CORNERS = list(itertools.product((0, 1), repeat=3))
_NAMES = ["c" + "".join(map(str, s)) for s in _CORNERS]
_CELLS = "cells3 AS (SELECT g.ix, g.iy, g.iz, g.value AS c000, " + ", ".join(f"{n}.value AS {n}" for n in _NAMES[1:]) + " FROM vol g " + " ".join(_near(n, s) for n, s in zip(_NAMES[1:], _CORNERS[1:], strict=True)) + ")"
_PART = {k: f"(s{k} - floor(s{k}))" for k in "xyz"}


@query("trilinear_samples", f"{V}, {_CELLS}, q AS (SELECT vec_id AS pid, " + ", ".join(f"4 + 8 * CAST(embedding[{i + 1}] AS DOUBLE) AS s{k}" for i, k in enumerate("xyz")) + " FROM embeddings) SELECT pid, round(" + " + ".join(n + " * " + " * ".join(_PART[k] if d else f"(1 - {_PART[k]})" for k, d in zip("xyz", s, strict=True)) for n, s in zip(_NAMES, _CORNERS, strict=True)) + ", 6) AS sample FROM q LEFT JOIN cells3 ON ix = floor(sx) AND iy = floor(sy) AND iz = floor(sz)")
def trilinear_samples(spark, sf_dir):
    p = B.cloud(spark, sf_dir).select("pid", *((4 + F.col(k)).alias(k) for k in "xyz"))
    return shapes.trilinear(B.volume(spark, sf_dir), p).select("pid", r6(F.col("sample")).alias("sample"))


def _tets_sql(level: float) -> str:
    ups = ["(" + " + ".join(f"CAST({'c' + ''.join(map(str, p))} >= {level} AS INTEGER)" for p in t) + ")" for t in shapes._TETRAHEDRA]
    return " + ".join(f"(CASE {u} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)" for u in ups)


@query("isosurface_triangles", f"{V}, {_CELLS} SELECT * FROM (SELECT ix, iy, iz, CAST({_tets_sql(3.0)} AS BIGINT) AS n FROM cells3) WHERE n > 0")
def isosurface_triangles(spark, sf_dir):
    """Triangles of each cell that the level 3 crosses."""
    return shapes.isosurface(B.volume(spark, sf_dir), 3.0).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))


def _nearest_sql() -> str:
    dot = lambda p, q: "(" + " + ".join(f"{p(k)} * {q(k)}" for k in "xyz") + ")"
    way = lambda a, b: lambda k: f"({b}{k}-{a}{k})"
    u, v, p = way("a", "b"), way("a", "c"), way("a", "o")
    inner = ", ".join(f"{dot(*m)} AS d{n}" for n, m in (("00", (u, u)), ("01", (u, v)), ("11", (v, v)), ("20", (p, u)), ("21", (p, v))))
    nx, ny, nz = (f"({u(i)} * {v(j)} - {u(j)} * {v(i)})" for i, j in (("y", "z"), ("z", "x"), ("x", "y")))

    def side(a: str, b: str) -> str:
        t = f"greatest(0.0, least(1.0, {dot(way(a, 'o'), way(a, b))} / {dot(way(a, b), way(a, b))}))"
        return "sqrt(" + " + ".join(f"pow(o{k} - {a}{k} - {t} * ({b}{k}-{a}{k}), 2)" for k in "xyz") + ")"

    plane = f"abs({p('x')} * nx + {p('y')} * ny + {p('z')} * nz) / sqrt(nx*nx + ny*ny + nz*nz)"
    d = f"CASE WHEN v >= 0 AND w >= 0 AND v + w <= 1 THEN {plane} ELSE least({side('a', 'b')}, {side('b', 'c')}, {side('c', 'a')}) END"
    return (
        f"WITH o AS (SELECT pid, x / 8 AS ox, y / 8 AS oy, z / 8 AS oz FROM ({B.CLOUD})), t AS ({B.TRIANGLES}), m AS (SELECT *, {inner}, {nx} AS nx, {ny} AS ny, {nz} AS nz FROM o, t), "
        f"w AS (SELECT *, (d11*d20 - d01*d21) / (d00*d11 - d01*d01) AS v, (d00*d21 - d01*d20) / (d00*d11 - d01*d01) AS w FROM m), e AS (SELECT pid, fid, {d} AS d FROM w) "
        f"SELECT pid, fid, {sql6('d')} AS d FROM e QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, fid) = 1"
    )


@query("nearest_triangles", _nearest_sql())
def nearest_triangles(spark, sf_dir):
    """The nearest triangle of every point, against all triangles."""
    p = B.cloud(spark, sf_dir).select("pid", *((F.col(k) / 8).alias(k) for k in "xyz"))
    return shapes.nearest_triangle(p, B.triangles(spark, sf_dir), 0.2).select("pid", "fid", r6(F.col("d")).alias("d"))


def _voronoi_parts() -> str:
    sq = lambda p, q: "(" + " + ".join(f"({q}{k}-{p}{k})*({q}{k}-{p}{k})" for k in "xyz") + ")"
    blunt = lambda at, p, q: "(" + " + ".join(f"({p}{k}-{at}{k})*({q}{k}-{at}{k})" for k in "xyz") + ") < 0"
    area = "0.5 * sqrt(pow((by-ay)*(cz-az) - (bz-az)*(cy-ay), 2) + pow((bz-az)*(cx-ax) - (bx-ax)*(cz-az), 2) + pow((bx-ax)*(cy-ay) - (by-ay)*(cx-ax), 2))"
    parts = [f"SELECT v{i} AS vid, CASE WHEN {blunt(p, r, s)} THEN {area} / 2 WHEN {blunt(r, p, s)} OR {blunt(s, p, r)} THEN {area} / 4 ELSE ({sq(p, r)} * ({_cot(s, p, r)}) + {sq(p, s)} * ({_cot(r, p, s)})) / 8 END AS area FROM tris" for i, (p, r, s) in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")))]
    return " UNION ALL ".join(parts)


@query("voronoi_areas", f"{W} SELECT vid, {sql6('sum(area)')} AS area FROM ({_voronoi_parts()}) GROUP BY vid")
def voronoi_areas(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return shapes.voronoi_areas(mesh.placed(f, v)).select("vid", r6(F.col("area")).alias("area"))
