"""Queries of transforms with a matrix a row, and of predicates and measures of triangles, boxes and rays."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import transforms as M
from ..functions import vector as V
from . import bindings as B
from .registry import query
from .scalar_queries import AREA, NX, NY, NZ, T, _left, _side, r6, sql6


def _all(prefix: str, exprs: dict[str, str]) -> str:
    return ", ".join(f"{sql6(e)} AS {prefix}{k}" for k, e in exprs.items())


def _lo(k: str, *of: str) -> str:
    return f"least({', '.join(p + k for p in of)})"


def _hi(k: str, *of: str) -> str:
    return f"greatest({', '.join(p + k for p in of)})"


def _ratio(k: str) -> str:
    return f"(({_hi(k, 'c', 'p')} - {_lo(k, 'c', 'p')}) / ({_hi(k, 'a', 'b')} - {_lo(k, 'a', 'b')}))"


_MOVE = {k: f"({_lo(k, 'c', 'p')} - {_lo(k, 'a', 'b')})" for k in "xyz"}
_MEAN3, _MEAN2 = f"(({' + '.join(_ratio(k) for k in 'xyz')}) / 3)", f"(({' + '.join(_ratio(k) for k in 'xy')}) / 2)"


@query("box_transforms", f"{T} SELECT fid, {_all('s', {k: f'd{k} * {_ratio(k)} + {_MOVE[k]}' for k in 'xyz'})}, {_all('u', {k: f'd{k} * {_MEAN3} + {_MOVE[k]}' for k in 'xyz'})}, {_all('f', {k: f'd{k} * {_MEAN2} + {_MOVE[k]}' for k in 'xy'})} FROM t")
def box_transforms(spark, sf_dir):
    """The box of a, b to that of c, p, by side, uniformly, and in the plane; applied to d."""
    d, ab, cp = V.vec("d"), G.bounds(V.vec("a"), V.vec("b")), G.bounds(V.vec("c"), V.vec("p"))
    flat = [tuple(v[:2]) for v in (*ab, *cp)]
    found = {"s": M.applied(M.between_boxes(*ab, *cp), d), "u": M.applied(M.between_boxes(*ab, *cp, uniform=True), d), "f": M.applied(M.between_boxes(*flat, uniform=True), d[:2])}
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias(n + k) for n, q in found.items() for k, v in zip("xyz", q)))


_U = f"{T}, u AS (SELECT *, {', '.join(f'b{k} / sqrt(bx*bx + by*by + bz*bz) AS u{k}' for k in 'xyz')}, radians(90 * cx) AS w FROM t)"
_UXA = {"x": "(uy*az - uz*ay)", "y": "(uz*ax - ux*az)", "z": "(ux*ay - uy*ax)"}
_UA = "(ux*ax + uy*ay + uz*az)"
_TURN = {k: f"a{k} * cos(w) + {_UXA[k]} * sin(w) + u{k} * {_UA} * (1 - cos(w))" for k in "xyz"}


@query("rotations", f"{_U} SELECT fid, {_all('t', _TURN)}, {_all('q', {k: f'u{k} * {_UA} + {_UXA[k]}' for k in 'xyz'})}, {_all('k', {**{k: f'u{k} * sin(w / 2)' for k in 'xyz'}, 'w': 'cos(w / 2)'})}, {sql6('px + cos(w) * (ax - px) - sin(w) * (ay - py)')} AS fx, {sql6('py + sin(w) * (ax - px) + cos(w) * (ay - py)')} AS fy, {sql6('cos(w) * ay + sin(w) * az')} AS xy, {sql6('cos(w) * az - sin(w) * ax * -1')} AS yz, {sql6('cos(w) * ax + sin(w) * ay')} AS zx FROM u")
def rotations(spark, sf_dir):
    """a around b by a right angle times cx: by matrix; by a right angle as quaternion; in the plane around p; around the axes."""
    a, u, deg = V.vec("a"), V.normalize(V.vec("b")), F.col("cx") * 90
    q = M.quaternion(u, F.radians(deg))
    flat = M.applied(M.rotation_2d(V.vec("p")[:2], deg), a[:2])
    around = {k: M.applied(M.rotation_about(k, deg), a) for k in "xyz"}
    return B.triangles(spark, sf_dir).select(
        "fid", *(r6(v).alias("t" + k) for k, v in zip("xyz", M.applied(M.rotation(V.vec("b"), deg), a))), *(r6(v).alias("q" + k) for k, v in zip("xyz", M.quarter_turn(a, u))),
        *(r6(v).alias("k" + k) for k, v in zip("xyzw", q)), r6(flat[0]).alias("fx"), r6(flat[1]).alias("fy"), r6(around["x"][1]).alias("xy"), r6(around["y"][2]).alias("yz"), r6(around["z"][0]).alias("zx"))


@query("quaternion_turns", f"{_U} SELECT fid, {_all('t', _TURN)} FROM u")
def quaternion_turns(spark, sf_dir):
    """a around b as in `rotations`, by the quaternion."""
    q = M.quaternion(V.normalize(V.vec("b")), F.radians(F.col("cx") * 90))
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias("t" + k) for k, v in zip("xyz", M.turned(V.vec("a"), q))))


@query("inverse_transforms", f"{_U} SELECT fid, {_all('i', {k: f'(p{k} - a{k}) / (2 + b{k})' for k in 'xyz'})}, {sql6('(2 + bx) * (2 + by) * (2 + bz)')} AS det FROM u")
def inverse_transforms(spark, sf_dir):
    """The inverse of scaling by 2 + b and moving by a, applied to p; the determinant."""
    m = M.multiplied(M.translation(V.vec("a")), M.scaling(tuple(2 + c for c in V.vec("b"))))
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias("i" + k) for k, v in zip("xyz", M.applied(M.inverse(m), V.vec("p")))), r6(M.determinant(m)).alias("det"))


def _corner_heights(normal: dict[str, str], at: str, axes: str = "xyz") -> list[str]:
    return ["(" + " + ".join(f"({normal[k]}) * ({side(k, 'c', 'd')} - {at}{k})" for k, side in zip(axes, s)) + ")" for s in itertools.product((_lo, _hi), repeat=len(axes))]


def _both_sides(heights: list[str]) -> str:
    return f"(least({', '.join(heights)}) <= 0 AND greatest({', '.join(heights)}) >= 0)"


def _touch(of: tuple[str, ...], axes: str = "xyz") -> str:
    return "(" + " AND ".join(f"{_lo(k, *of)} <= {_hi(k, 'c', 'd')} AND {_lo(k, 'c', 'd')} <= {_hi(k, *of)}" for k in axes) + ")"


def _apart() -> str:
    """SQL: the products of a triangle's edges (a, b, p) with the box's axes don't part the triangle from the box of c, d."""
    tests = []
    for s, e in (("a", "b"), ("b", "p"), ("p", "a")):
        for k in range(3):
            i, j = "xyz"[(k + 1) % 3], "xyz"[(k + 2) % 3]
            d = {q: f"({e}{q} - {s}{q})" for q in (i, j)}
            mid = {q: f"(({_lo(q, 'c', 'd')} + {_hi(q, 'c', 'd')}) / 2)" for q in (i, j)}
            half = {q: f"(({_hi(q, 'c', 'd')} - {_lo(q, 'c', 'd')}) / 2)" for q in (i, j)}
            shadow = [f"{d[i]} * ({q}{j} - {mid[j]}) - {d[j]} * ({q}{i} - {mid[i]})" for q in ("a", "b", "p")]
            reach = f"({half[i]} * abs({d[j]}) + {half[j]} * abs({d[i]}))"
            tests.append(f"least({', '.join(shadow)}) <= {reach} AND greatest({', '.join(shadow)}) >= -{reach}")
    return " AND ".join(tests)


_ABP = {"x": "(by-ay)*(pz-az) - (bz-az)*(py-ay)", "y": "(bz-az)*(px-ax) - (bx-ax)*(pz-az)", "z": "(bx-ax)*(py-ay) - (by-ay)*(px-ax)"}


@query("boxes_cut", f"{T} SELECT fid, {_both_sides(_corner_heights({k: 'a' + k for k in 'xyz'}, 'b'))} AS plane, {_touch(('a', 'b', 'p'))} AND {_both_sides(_corner_heights(_ABP, 'a'))} AND {_apart()} AS triangle, {_touch(('a', 'b'), 'xy')} AND {_both_sides(_corner_heights({'x': '(ay-by)', 'y': '(bx-ax)'}, 'a', 'xy'))} AS segment FROM t")
def boxes_cut(spark, sf_dir):
    """Whether the plane through b with normal a, the triangle a, b, p and, in the plane, the segment a, b meet the box of c, d."""
    a, b, p = V.vec("a"), V.vec("b"), V.vec("p")
    lo, hi = G.bounds(V.vec("c"), V.vec("d"))
    return B.triangles(spark, sf_dir).select("fid", G.plane_meets_box(a, b, lo, hi).alias("plane"), G.triangle_meets_box(a, b, p, lo, hi).alias("triangle"), G.segment_meets_box_2d(a[:2], b[:2], lo[:2], hi[:2]).alias("segment"))


def _crossing(s: str, e: str, p: str, q: str) -> str:
    return f"({_left(s, e, p)} * {_left(s, e, q)} <= 0 AND {_left(p, q, s)} * {_left(p, q, e)} <= 0)"


def _within(p: str, a: str, b: str, c: str) -> str:
    turns = ", ".join(_left(*e, p) for e in ((a, b), (b, c), (c, a)))
    return f"(least({turns}) >= 0 OR greatest({turns}) <= 0)"


_LOOPS = [[(s, e) for s, e in zip(names, names[1:] + names[:1])] for names in ("abc", "pdo")]


@query("flat_triangles_meet", f"WITH t AS (SELECT *, 0.1 AS ox, -0.1 AS oy FROM ({B.TRIANGLES})) SELECT fid, " + " OR ".join([_crossing(*e, *f) for e in _LOOPS[0] for f in _LOOPS[1]] + [_within("a", *"pdo"), _within("p", *"abc")]) + " AS meet FROM t")
def flat_triangles_meet(spark, sf_dir):
    """Whether the plane triangles a, b, c and p, d, (0.1, -0.1) share a point; the twin looks at crossings and corners."""
    flat = lambda n: V.vec(n)[:2]
    return B.triangles(spark, sf_dir).select("fid", G.triangles_meet_2d((flat("a"), flat("b"), flat("c")), (flat("p"), flat("d"), (F.lit(0.1), F.lit(-0.1)))).alias("meet"))


_DET = "((bx-ax) * dy - (by-ay) * dx)"


def _slab2(k: str, f: str) -> str:
    return f"{f}(({_lo(k, 'a', 'b')} - p{k}) / d{k}, ({_hi(k, 'a', 'b')} - p{k}) / d{k})"


_IN, _OUT = f"greatest(0.0, {_slab2('x', 'least')}, {_slab2('y', 'least')})", f"least({_slab2('x', 'greatest')}, {_slab2('y', 'greatest')})"


@query("flat_rays", f"{T} SELECT fid, CASE WHEN abs({_DET}) >= 1e-9 THEN round(((px-ax) * dy - (py-ay) * dx) / {_DET}, 4) + 0.0 END AS meets, CASE WHEN {_IN} <= {_OUT} THEN {sql6(_IN)} END AS enters, CASE WHEN {_IN} <= {_OUT} THEN {sql6(_OUT)} END AS leaves FROM t")
def flat_rays(spark, sf_dir):
    """In the plane: where the ray a to b meets the line of the ray from p along d; the latter through the box of a, b."""
    a, b, p, d = (V.vec(n)[:2] for n in "abpd")
    enters, leaves = G.ray_through_box(p, d, *G.bounds(a, b))
    return B.triangles(spark, sf_dir).select("fid", (F.round(G.rays_meet_2d(a, V.minus(b, a), p, d), 4) + 0.0).alias("meets"), r6(enters).alias("enters"), r6(leaves).alias("leaves"))


_BC, _H = _side("b", "c"), f"(2 * {AREA} / {_side('b', 'c')})"
_ALONG = "((" + " + ".join(f"(a{k}-c{k})*(b{k}-c{k})" for k in "xyz") + f") / {_BC})"


def _cond(along: str, eps: str) -> str:
    rows = f"greatest({_BC} + abs({along}), {_H}) * greatest((1 + abs({along}) / {_H}) / {_BC}, 1 / {_H})"
    return f"CASE WHEN 2 * {AREA} < {eps} THEN -1 ELSE round({rows}, 4) END"


_SQ = "(" + " + ".join(f"pow({_side(p, q)}, 2)" for p, q in ("ab", "bc", "ca")) + f") / pow(greatest({_side('a', 'b')}, {_BC}, {_side('c', 'a')}), 2)"
_UNIT_AREA = f"({AREA} / pow(greatest({_side('a', 'b')}, {_BC}, {_side('c', 'a')}), 2))"


@query("triangle_conditions", f"{T}, m AS (SELECT fid, {_cond(_ALONG, '1e-5')} AS jacobian, {_cond(f'({_ALONG} - {_BC} / 2)', '1e-7')} AS equilateral, {_SQ} AS s, {_UNIT_AREA} AS u FROM t) SELECT fid, jacobian, equilateral, CASE WHEN 48 * u >= s * s THEN round(sqrt(48 * u) / (8 * u), 4) ELSE -1 END AS stiffness FROM m")
def triangle_conditions(spark, sf_dir):
    """Condition numbers of triangles; -1 stands for infinite or not a number."""
    corners = V.vec("a"), V.vec("b"), V.vec("c")
    found = {"jacobian": G.jacobian_condition(*corners), "equilateral": G.equilateral_condition(*corners), "stiffness": G.stiffness_condition(*corners)}
    return B.triangles(spark, sf_dir).select("fid", *(F.when(F.isnan(c) | (c == float("inf")), -1.0).otherwise(F.round(c, 4)).alias(n) for n, c in found.items()))


@query("blends", f"{T} SELECT fid, {sql6('CASE WHEN 2 * abs(ax) <= 0.1 THEN 2 * abs(ax) WHEN 2 * abs(ax) >= 0.5 THEN 1 ELSE 2 * abs(ax) - 0.1 * pow(2 * abs(ax) - 0.2, 2) END')} AS quadratic, {sql6('least(ax, bx)')} AS distance_union, {_all('m', {k: f'(a{k} + b{k}) / 2' for k in 'xyz'})} FROM t")
def blends(spark, sf_dir):
    x = 2 * F.abs("ax")
    return B.triangles(spark, sf_dir).select("fid", r6(G.quadratic_blend(x, 0.3, 0.2)).alias("quadratic"), r6(G.IMPLICIT["intersection"](F.col("ax"), F.col("bx"))).alias("distance_union"), *(r6(v).alias("m" + k) for k, v in zip("xyz", G.midpoint(V.vec("a"), V.vec("b")))))


_PLANE = f"((px-ax)*{NX} + (py-ay)*{NY} + (pz-az)*{NZ}) / (2 * {AREA})"


@query("plane_quadrics", f"{T} SELECT fid, {sql6(f'pow({_PLANE}, 2)')} AS error FROM t")
def plane_quadrics(spark, sf_dir):
    """The quadric of each triangle's plane at p: the squared distance."""
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    return B.triangles(spark, sf_dir).select("fid", r6(G.quadric_value(G.plane_quadric(n, a), V.vec("p"))).alias("error"))
