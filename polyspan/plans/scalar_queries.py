"""Queries of vector algebra and geometric predicates, one row in, one row out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import bindings as B
from .registry import query

def r6(x):
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


T = f"WITH t AS ({B.TRIANGLES})"
DOT_AB, LEN_A, LEN_B = "(ax*bx + ay*by + az*bz)", "sqrt(ax*ax + ay*ay + az*az)", "sqrt(bx*bx + by*by + bz*bz)"
NX, NY, NZ = "((by-ay)*(cz-az) - (bz-az)*(cy-ay))", "((bz-az)*(cx-ax) - (bx-ax)*(cz-az))", "((bx-ax)*(cy-ay) - (by-ay)*(cx-ax))"
AREA = f"(0.5 * sqrt({NX}*{NX} + {NY}*{NY} + {NZ}*{NZ}))"


def _side(p: str, q: str) -> str:
    return f"sqrt(({p}x-{q}x)*({p}x-{q}x) + ({p}y-{q}y)*({p}y-{q}y) + ({p}z-{q}z)*({p}z-{q}z))"


def _angle(at: str, p: str, q: str) -> str:
    d = " + ".join(f"({p}{k}-{at}{k})*({q}{k}-{at}{k})" for k in "xyz")
    return f"acos(greatest(-1.0, least(1.0, ({d}) / ({_side(p, at)} * {_side(q, at)}))))"


@query("vector_norms", f"{T} SELECT fid, {sql6(LEN_A)} AS norm, {sql6('ax*ax + ay*ay + az*az')} AS sqrnorm, {sql6(_side('a', 'b'))} AS distance FROM t")
def vector_norms(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(V.norm(V.vec("a"))).alias("norm"), r6(V.sqrnorm(V.vec("a"))).alias("sqrnorm"), r6(V.distance(V.vec("a"), V.vec("b"))).alias("distance"))


@query("vector_products", f"{T} SELECT fid, {sql6(DOT_AB)} AS dot, {sql6('ay*bz - az*by')} AS crossx, {sql6('az*bx - ax*bz')} AS crossy, {sql6('ax*by - ay*bx')} AS crossz, {sql6('ax*bx')} AS cmultx FROM t")
def vector_products(spark, sf_dir):
    c = V.cross(V.vec("a"), V.vec("b"))
    return B.triangles(spark, sf_dir).select("fid", r6(V.dot(V.vec("a"), V.vec("b"))).alias("dot"), *(r6(v).alias(f"cross{k}") for k, v in zip("xyz", c)), r6(V.times(V.vec("a"), V.vec("b"))[0]).alias("cmultx"))


@query("vector_normalize", f"{T} SELECT fid, {sql6(f'ax / {LEN_A}')} AS nx, {sql6(f'ay / {LEN_A}')} AS ny, {sql6(f'az / {LEN_A}')} AS nz, {sql6('-ay')} AS perpx, {sql6('ax')} AS perpy FROM t")
def vector_normalize(spark, sf_dir):
    n, p = V.normalize(V.vec("a")), V.perp(V.vec("a")[:2])
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias("n" + k) for k, v in zip("xyz", n)), r6(p[0]).alias("perpx"), r6(p[1]).alias("perpy"))


@query("vector_min_max", f"{T} SELECT fid, {', '.join(f'{sql6(f'least(a{k}, b{k})')} AS lo{k}, {sql6(f'greatest(a{k}, b{k})')} AS hi{k}' for k in 'xyz')} FROM t")
def vector_min_max(spark, sf_dir):
    lo, hi = V.least(V.vec("a"), V.vec("b")), V.greatest(V.vec("a"), V.vec("b"))
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias(p + k) for p, x in (("lo", lo), ("hi", hi)) for k, v in zip("xyz", x)))


_M = [[0.0, -1.0, 0.0, 2.0], [1.0, 0.0, 0.0, -1.0], [0.0, 0.0, 2.0, 0.5], [0.1, 0.0, 0.0, 2.0]]


@query("transforms", f"{T} SELECT fid, {sql6('-ay + 2')} AS affx, {sql6('ax - 1')} AS affy, {sql6('2 * az + 0.5')} AS affz, {sql6('(-ay + 2) / (0.1 * ax + 2)')} AS projx, {sql6('-ay')} AS linx, {sql6('2 * az')} AS linz FROM t")
def transforms(spark, sf_dir):
    aff, proj, lin = V.affine(_M, V.vec("a")), V.projective(_M, V.vec("a")), V.linear(_M, V.vec("a"))
    return B.triangles(spark, sf_dir).select("fid", *(r6(v).alias("aff" + k) for k, v in zip("xyz", aff)), r6(proj[0]).alias("projx"), r6(lin[0]).alias("linx"), r6(lin[2]).alias("linz"))


@query("triangle_measures", f"{T} SELECT fid, {sql6(AREA)} AS area, {sql6('(ax+bx+cx)/3')} AS mx, {sql6('(ay+by+cy)/3')} AS my, {sql6('(az+bz+cz)/3')} AS mz FROM t")
def triangle_measures(spark, sf_dir):
    m = G.face_centroid(V.vec("a"), V.vec("b"), V.vec("c"))
    return B.triangles(spark, sf_dir).select("fid", r6(G.triangle_area(V.vec("a"), V.vec("b"), V.vec("c"))).alias("area"), *(r6(v).alias("m" + k) for k, v in zip("xyz", m)))


_ANGLES = ", ".join((_angle("a", "b", "c"), _angle("b", "c", "a"), _angle("c", "a", "b")))


@query("triangle_angles", f"{T} SELECT fid, {sql6(f'least({_ANGLES})')} AS min_angle, {sql6(f'greatest({_ANGLES})')} AS max_angle FROM t")
def triangle_angles(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(G.min_angle(V.vec("a"), V.vec("b"), V.vec("c"))).alias("min_angle"), r6(G.max_angle(V.vec("a"), V.vec("b"), V.vec("c"))).alias("max_angle"))


@query("triangle_quality", f"{T}, s AS (SELECT fid, {_side('a', 'b')} AS u, {_side('b', 'c')} AS v, {_side('c', 'a')} AS w FROM t) SELECT fid, {sql6('8 * ((v+w-u)/2) * ((u+w-v)/2) * ((u+v-w)/2) / (u*v*w)')} AS ratio FROM s")
def triangle_quality(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(G.radius_ratio(V.vec("a"), V.vec("b"), V.vec("c"))).alias("ratio"))


def _seg(a: str, b: str) -> str:
    num = " + ".join(f"(p{k}-{a}{k})*({b}{k}-{a}{k})" for k in "xyz")
    den = " + ".join(f"({b}{k}-{a}{k})*({b}{k}-{a}{k})" for k in "xyz")
    t = f"greatest(0.0, least(1.0, ({num}) / ({den})))"
    return "sqrt(" + " + ".join(f"pow(p{k} - ({a}{k} + {t} * ({b}{k}-{a}{k})), 2)" for k in "xyz") + ")"


@query("point_segment_distance", f"{T} SELECT fid, {sql6(_seg('a', 'b'))} AS distance FROM t")
def point_segment_distance(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(G.segment_distance(V.vec("p"), V.vec("a"), V.vec("b"))).alias("distance"))


_D = {"00": " + ".join(f"(b{k}-a{k})*(b{k}-a{k})" for k in "xyz"), "01": " + ".join(f"(b{k}-a{k})*(c{k}-a{k})" for k in "xyz"), "11": " + ".join(f"(c{k}-a{k})*(c{k}-a{k})" for k in "xyz"), "20": " + ".join(f"(p{k}-a{k})*(b{k}-a{k})" for k in "xyz"), "21": " + ".join(f"(p{k}-a{k})*(c{k}-a{k})" for k in "xyz")}
_BARY = f"{T}, d AS (SELECT *, " + ", ".join(f"{e} AS d{n}" for n, e in _D.items()) + f", {NX} AS nx, {NY} AS ny, {NZ} AS nz FROM t), w AS (SELECT *, (d11*d20 - d01*d21) / (d00*d11 - d01*d01) AS v, (d00*d21 - d01*d20) / (d00*d11 - d01*d01) AS w FROM d)"


@query("barycentric_coordinates", f"{_BARY} SELECT fid, {sql6('1 - v - w')} AS u, {sql6('v')} AS v, {sql6('w')} AS w FROM w")
def barycentric_coordinates(spark, sf_dir):
    u, v, w = G.barycentric(V.vec("p"), V.vec("a"), V.vec("b"), V.vec("c"))
    return B.triangles(spark, sf_dir).select("fid", r6(u).alias("u"), r6(v).alias("v"), r6(w).alias("w"))


@query("point_triangle_distance", f"{_BARY} SELECT fid, {sql6(f'CASE WHEN 1-v-w >= 0 AND v >= 0 AND w >= 0 THEN abs((px-ax)*nx + (py-ay)*ny + (pz-az)*nz) / sqrt(nx*nx + ny*ny + nz*nz) ELSE least({_seg('a', 'b')}, {_seg('b', 'c')}, {_seg('c', 'a')}) END')} AS distance FROM w")
def point_triangle_distance(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(G.triangle_distance(V.vec("p"), V.vec("a"), V.vec("b"), V.vec("c"))).alias("distance"))


@query("box_predicates", f"{T} SELECT fid, " + " AND ".join(f"least(a{k}, b{k}) <= greatest(c{k}, p{k}) AND least(c{k}, p{k}) <= greatest(a{k}, b{k})" for k in "xyz") + " AS meets, " + " AND ".join(f"p{k} BETWEEN least(a{k}, b{k}, c{k}) AND greatest(a{k}, b{k}, c{k})" for k in "xyz") + f" AS contains, {sql6('sqrt(' + ' + '.join(f'pow(greatest(least(a{k}, b{k}) - p{k}, p{k} - greatest(a{k}, b{k}), 0.0), 2)' for k in 'xyz') + ')')} AS distance FROM t")
def box_predicates(spark, sf_dir):
    ab, cp, abc = G.bounds(V.vec("a"), V.vec("b")), G.bounds(V.vec("c"), V.vec("p")), G.bounds(V.vec("a"), V.vec("b"), V.vec("c"))
    return B.triangles(spark, sf_dir).select("fid", G.boxes_meet(*ab, *cp).alias("meets"), G.box_contains(*abc, V.vec("p")).alias("contains"), r6(G.box_distance(*ab, V.vec("p"))).alias("distance"))


_RT = f"""{T}, e AS (SELECT *, dy*(cz-az) - dz*(cy-ay) AS qx, dz*(cx-ax) - dx*(cz-az) AS qy, dx*(cy-ay) - dy*(cx-ax) AS qz,
 (py-ay)*(bz-az) - (pz-az)*(by-ay) AS rx, (pz-az)*(bx-ax) - (px-ax)*(bz-az) AS ry, (px-ax)*(by-ay) - (py-ay)*(bx-ax) AS rz FROM t),
f AS (SELECT *, (bx-ax)*qx + (by-ay)*qy + (bz-az)*qz AS det FROM e),
g AS (SELECT fid, det, ((px-ax)*qx + (py-ay)*qy + (pz-az)*qz) / det AS u, (dx*rx + dy*ry + dz*rz) / det AS v, ((cx-ax)*rx + (cy-ay)*ry + (cz-az)*rz) / det AS h FROM f)"""


@query("ray_triangle_hits", f"{_RT} SELECT fid, CASE WHEN abs(det) > 1e-9 AND u >= 0 AND v >= 0 AND u + v <= 1 AND h >= 0 THEN {sql6('h')} END AS hit FROM g")
def ray_triangle_hits(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", r6(G.ray_hits_triangle(V.vec("p"), V.vec("d"), V.vec("a"), V.vec("b"), V.vec("c"))).alias("hit"))


def _slab(k: str, f: str) -> str:
    return f"{f}((least(a{k}, b{k}) - p{k}) / d{k}, (greatest(a{k}, b{k}) - p{k}) / d{k})"


@query("ray_box_hits", f"{T} SELECT fid, greatest(0.0, {', '.join(_slab(k, 'least') for k in 'xyz')}) <= least({', '.join(_slab(k, 'greatest') for k in 'xyz')}) AS hit FROM t")
def ray_box_hits(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", G.ray_hits_box(V.vec("p"), V.vec("d"), *G.bounds(V.vec("a"), V.vec("b"))).alias("hit"))


@query("spheres_meet", f"{T} SELECT fid, {_side('a', 'b')} < abs(cx) + abs(cy) AS meets, sqrt((ax-bx)*(ax-bx) + (ay-by)*(ay-by)) < abs(cx) + abs(cy) AS circles FROM t")
def spheres_meet(spark, sf_dir):
    r0, r1 = F.abs("cx"), F.abs("cy")
    return B.triangles(spark, sf_dir).select("fid", G.spheres_meet(V.vec("a"), r0, V.vec("b"), r1).alias("meets"), G.spheres_meet(V.vec("a")[:2], r0, V.vec("b")[:2], r1).alias("circles"))


def _left(a: str, b: str, p: str) -> str:
    return f"(({b}x-{a}x)*({p}y-{a}y) - ({b}y-{a}y)*({p}x-{a}x))"


@query("planar_predicates", f"{T} SELECT fid, {_left('a', 'b', 'c')} > 0 AS is_left, {_left('a', 'b', 'c')} * {_left('a', 'b', 'p')} < 0 AND {_left('c', 'p', 'a')} * {_left('c', 'p', 'b')} < 0 AS crosses, (least({_left('a', 'b', 'p')}, {_left('b', 'c', 'p')}, {_left('c', 'a', 'p')}) >= 0 OR greatest({_left('a', 'b', 'p')}, {_left('b', 'c', 'p')}, {_left('c', 'a', 'p')}) <= 0) AS inside FROM t")
def planar_predicates(spark, sf_dir):
    a, b, c, p = V.vec("a")[:2], V.vec("b")[:2], V.vec("c")[:2], V.vec("p")[:2]
    return B.triangles(spark, sf_dir).select("fid", (G.left_of(a, b, c) > 0).alias("is_left"), G.segments_cross(a, b, c, p).alias("crosses"), G.in_triangle_2d(p, a, b, c).alias("inside"))


_IMPLICIT_SQL = {"union": "greatest(ax, bx)", "intersection": "least(ax, bx)", "difference": "greatest(ax - bx, 0.0)", "blended_union": "ax + bx + sqrt(ax*ax + bx*bx)", "blended_intersection": "ax + bx - sqrt(ax*ax + bx*bx)", "blended_difference": "ax - bx - sqrt(ax*ax + bx*bx)"}


@query("implicit_solids", f"{T} SELECT fid, {', '.join(f'{sql6(e)} AS s_{n}' for n, e in _IMPLICIT_SQL.items())} FROM t")
def implicit_solids(spark, sf_dir):
    return B.triangles(spark, sf_dir).select("fid", *(r6(f(F.col("ax"), F.col("bx"))).alias("s_" + n) for n, f in G.IMPLICIT.items()))


@query("subdivision_counts", """WITH c AS (SELECT label AS mesh, count(*) AS v FROM embeddings GROUP BY label), s AS (SELECT unnest([1, 2, 3]) AS step)
SELECT CAST(mesh AS BIGINT) AS mesh, CAST(step AS BIGINT) AS step, CAST(pow(4, step) * (3 * v - 6) AS BIGINT) AS n_edges, CAST(((3 * v - 6) * (pow(4, step) - 1) + 3 * v) / 3 AS BIGINT) AS n_vertices, CAST(pow(4, step) * (2 * v - 4) AS BIGINT) AS n_faces FROM c, s""")
def subdivision_counts(spark, sf_dir):
    """Sizes of closed genus-0 meshes, one with as many vertices as each cloud, after some subdivision steps."""
    c = B.cloud(spark, sf_dir).groupBy(F.col("cloud_id").alias("mesh")).agg(F.count("*").alias("v"))
    s = c.withColumn("step", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])))
    e, k = 3 * F.col("v") - 6, F.pow(F.lit(4.0), F.col("step"))
    return s.select("mesh", "step", (k * e).cast("long").alias("n_edges"), ((e * (k - 1) + 3 * F.col("v")) / 3).cast("long").alias("n_vertices"), (k * (2 * F.col("v") - 4)).cast("long").alias("n_faces"))
