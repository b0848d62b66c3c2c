"""Geometric predicates and measures over columns: triangles, boxes, rays, segments, implicit solids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vector, angle, cross, distance, dot, greatest, least, minus, norm, normalize, perp, plus, scaled, sqrnorm


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) * 0.5


def face_centroid(a: Vector, b: Vector, c: Vector) -> Vector:
    return tuple((p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True))


def corner_angles(a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    return angle(minus(b, a), minus(c, a)), angle(minus(c, b), minus(a, b)), angle(minus(a, c), minus(b, c))


def min_angle(a: Vector, b: Vector, c: Vector) -> Column:
    return F.least(*corner_angles(a, b, c))


def max_angle(a: Vector, b: Vector, c: Vector) -> Column:
    return F.greatest(*corner_angles(a, b, c))


def radius_ratio(a: Vector, b: Vector, c: Vector) -> Column:
    """Twice the inscribed by the circumscribed radius: 1 for an equilateral triangle, 0 for a degenerate one."""
    u, v, w = distance(a, b), distance(b, c), distance(c, a)
    s = (u + v + w) / 2
    return F.coalesce(F.try_divide(8 * (s - u) * (s - v) * (s - w), u * v * w), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """From a point to a segment, by clamped projection."""
    d = minus(b, a)
    t = clamp(F.coalesce(F.try_divide(dot(minus(p, a), d), sqrnorm(d)), F.lit(0.0)), 0.0, 1.0)
    return distance(p, plus(a, scaled(d, t)))


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    """Weights of the corners at the projection of p on the triangle's plane; nulls for a degenerate triangle."""
    v0, v1, v2 = minus(b, a), minus(c, a), minus(p, a)
    d00, d01, d11, d20, d21 = dot(v0, v0), dot(v0, v1), dot(v1, v1), dot(v2, v0), dot(v2, v1)
    den = d00 * d11 - d01 * d01
    v, w = F.try_divide(d11 * d20 - d01 * d21, den), F.try_divide(d00 * d21 - d01 * d20, den)
    return 1 - v - w, v, w


def triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """From a point to a triangle: to its plane where the projection lies inside, else to the nearest side."""
    u, v, w = barycentric(p, a, b, c)
    n = cross(minus(b, a), minus(c, a))
    plane = F.abs(F.try_divide(dot(minus(p, a), n), norm(n)))
    sides = F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a))
    return F.when((u >= 0) & (v >= 0) & (w >= 0), F.coalesce(plane, sides)).otherwise(sides)


def boxes_meet(lo0: Vector, hi0: Vector, lo1: Vector, hi1: Vector) -> Column:
    """Closed boxes."""
    out = F.lit(True)
    for a, b, c, d in zip(lo0, hi0, lo1, hi1, strict=True):
        out = out & (a <= d) & (c <= b)
    return out


def box_contains(lo: Vector, hi: Vector, p: Vector) -> Column:
    return boxes_meet(lo, hi, p, p)


def box_distance(lo: Vector, hi: Vector, p: Vector) -> Column:
    """Zero inside."""
    return norm(tuple(F.greatest(a - x, x - b, F.lit(0.0)) for a, b, x in zip(lo, hi, p, strict=True)))


def ray_hits_triangle(o: Vector, d: Vector, a: Vector, b: Vector, c: Vector, eps: float = 1e-9) -> Column:
    """The ray's parameter at the hit, null without one."""
    e1, e2 = minus(b, a), minus(c, a)
    p = cross(d, e2)
    det = dot(e1, p)
    s = minus(o, a)
    q = cross(s, e1)
    u, v, t = F.try_divide(dot(s, p), det), F.try_divide(dot(d, q), det), F.try_divide(dot(e2, q), det)
    return F.when((F.abs(det) > eps) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def watertight_hit(o: Vector, d: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """The ray's parameter at the hit, null without one, by signs of areas as seen along the ray: the axis in which the
    direction is longest goes to the front, and the corners are sheared so that the ray is that axis. The area beside an edge
    has the same size for both triangles that share it, so no ray slips between them; an edge or corner counts as met."""
    longest = F.greatest(*(F.abs(x) for x in d))
    front = lambda v: F.when(F.abs(d[2]) == longest, F.array(v[0], v[1], v[2])).when(F.abs(d[0]) == longest, F.array(v[1], v[2], v[0])).otherwise(F.array(v[2], v[0], v[1]))
    turned = F.transform(F.array(front(d)), lambda e: F.transform(F.array(*[front(minus(p, o)) for p in (a, b, c)]), lambda p: F.struct((p[0] * e[2] - e[0] * p[2]).alias("x"), (p[1] * e[2] - e[1] * p[2]).alias("y"), (p[2] / e[2]).alias("z"))))[0]

    def met(p: Column) -> Column:
        area = lambda i, j: p[i]["x"] * p[j]["y"] - p[i]["y"] * p[j]["x"]
        w = F.array(area(1, 2), area(2, 0), area(0, 1))
        return F.transform(F.array(w), lambda w: F.struct(F.array_min(w).alias("least"), F.array_max(w).alias("most"), (w[0] + w[1] + w[2]).alias("sum"), (w[0] * p[0]["z"] + w[1] * p[1]["z"] + w[2] * p[2]["z"]).alias("depth")))[0]

    found = F.transform(F.array(F.transform(F.array(turned), met)[0]), lambda m: F.when(((m["least"] >= 0) | (m["most"] <= 0)) & (m["sum"] != 0), F.try_divide(m["depth"], m["sum"])))[0]
    return F.transform(F.array(found), lambda t: F.when(t >= 0, t))[0]


def ray_hits_box(o: Vector, d: Vector, lo: Vector, hi: Vector) -> Column:
    """Whether a ray from o meets a closed box (slabs; a direction of zero needs the origin inside the slab)."""
    far = 1e300
    enter, leave, inside = [F.lit(0.0)], [F.lit(far)], F.lit(True)
    for p, v, a, b in zip(o, d, lo, hi, strict=True):
        t0, t1 = F.try_divide(a - p, v), F.try_divide(b - p, v)
        enter.append(F.coalesce(F.least(t0, t1), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(t0, t1), F.lit(far)))
        inside = inside & ((v != 0) | ((p >= a) & (p <= b)))
    return inside & (F.greatest(*enter) <= F.least(*leave))


def spheres_meet(c0: Vector, r0: Column, c1: Vector, r1: Column) -> Column:
    """Strictly: touching ones don't."""
    return distance(c0, c1) < r0 + r1


def left_of(a: Vector, b: Vector, p: Vector) -> Column:
    """Twice the signed area of a, b, p: positive where p lies left of the line."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def segments_cross(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Whether two 2D segments cross properly."""
    return (left_of(a, b, c) * left_of(a, b, d) < 0) & (left_of(c, d, a) * left_of(c, d, b) < 0)


def in_triangle_2d(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    s, t, u = left_of(a, b, p), left_of(b, c, p), left_of(c, a, p)
    return ((s >= 0) & (t >= 0) & (u >= 0)) | ((s <= 0) & (t <= 0) & (u <= 0))


def circumradius_2d(a: Vector, b: Vector, c: Vector) -> Column:
    """Null for points on a line."""
    return F.try_divide(distance(a, b) * distance(b, c) * distance(c, a), 2 * F.abs(left_of(a, b, c)))


#: Solids f >= 0: name -> combination of two field values.
IMPLICIT = {
    "union": lambda f, g: F.greatest(f, g),
    "intersection": lambda f, g: F.least(f, g),
    "difference": lambda f, g: F.greatest(f - g, F.lit(0.0)),
    "blended_union": lambda f, g: f + g + F.sqrt(f * f + g * g),
    "blended_intersection": lambda f, g: f + g - F.sqrt(f * f + g * g),
    "blended_difference": lambda f, g: f - g - F.sqrt(f * f + g * g),
}


def bounds(*points: Vector) -> tuple[Vector, Vector]:
    """Box of some points of a row."""
    lo, hi = points[0], points[0]
    for p in points[1:]:
        lo, hi = least(lo, p), greatest(hi, p)
    return lo, hi


def midpoint(a: Vector, b: Vector) -> Vector:
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def _spans_meet(axis: Vector, p: list[Vector], q: list[Vector]) -> Column:
    """Whether the shadows of two convex shapes on an axis meet."""
    s, t = [dot(axis, c) for c in p], [dot(axis, c) for c in q]
    return (F.least(*s) <= F.greatest(*t)) & (F.least(*t) <= F.greatest(*s))


def _corners(lo: Vector, hi: Vector) -> list[Vector]:
    out: list[Vector] = [()]
    for a, b in zip(lo, hi, strict=True):
        out = [(*c, k) for c in out for k in (a, b)]
    return out


def plane_meets_box(normal: Vector, origin: Vector, lo: Vector, hi: Vector) -> Column:
    """A plane and a closed box: corners on both sides, or on the plane."""
    heights = [dot(normal, minus(c, origin)) for c in _corners(lo, hi)]
    return (F.least(*heights) <= 0) & (F.greatest(*heights) >= 0)


def triangle_meets_box(a: Vector, b: Vector, c: Vector, lo: Vector, hi: Vector) -> Column:
    """A triangle and a closed box, exactly: no axis of the box, normal of the triangle or product of their edges parts them.
    Corners are taken from the box's middle and the box as its half sides."""
    middle, half = midpoint(lo, hi), tuple((q - p) / 2 for p, q in zip(lo, hi, strict=True))
    p, q, r = (minus(x, middle) for x in (a, b, c))
    out = boxes_meet(lo, hi, *bounds(a, b, c)) & plane_meets_box(cross(minus(q, p), minus(r, p)), p, tuple(-h for h in half), half)
    for e in (minus(q, p), minus(r, q), minus(p, r)):
        for k in range(3):
            i, j = (k + 1) % 3, (k + 2) % 3
            shadows = [e[i] * x[j] - e[j] * x[i] for x in (p, q, r)]
            reach = half[i] * F.abs(e[j]) + half[j] * F.abs(e[i])
            out = out & (F.least(*shadows) <= reach) & (F.greatest(*shadows) >= -reach)
    return out


def segment_meets_box_2d(a: Vector, b: Vector, lo: Vector, hi: Vector) -> Column:
    """A segment of the plane and a closed box."""
    return boxes_meet(lo, hi, *bounds(a, b)) & plane_meets_box(perp(minus(b, a)), a, lo, hi)


def triangles_meet_2d(s: tuple[Vector, Vector, Vector], t: tuple[Vector, Vector, Vector]) -> Column:
    """Two triangles of the plane share a point: no side of either parts them."""
    out = F.lit(True)
    for corners in (s, t):
        for k in range(3):
            out = out & _spans_meet(perp(minus(corners[(k + 1) % 3], corners[k])), list(s), list(t))
    return out


def rays_meet_2d(o0: Vector, d0: Vector, o1: Vector, d1: Vector, eps: float = 1e-9) -> Column:
    """The first ray's parameter where its line meets the second one's; null for parallel ones."""
    det = dot(perp(d1), d0)
    return F.when(F.abs(det) >= eps, F.try_divide(dot(perp(d1), minus(o1, o0)), det))


def ray_through_box(o: Vector, d: Vector, lo: Vector, hi: Vector, eps: float = 1e-9) -> tuple[Column, Column]:
    """The ray's parameters where it enters (0 if it starts inside) and leaves a closed box; nulls without a hit. A ray that
    lies in all slabs but is parallel to every axis leaves at infinity."""
    enter, leave, inside = [F.lit(0.0)], [F.lit(float("inf"))], F.lit(True)
    for p, v, a, b in zip(o, d, lo, hi, strict=True):
        runs = F.abs(v) > eps
        t0, t1 = F.try_divide(a - p, v), F.try_divide(b - p, v)
        enter.append(F.when(runs, F.least(t0, t1)).otherwise(0.0))
        leave.append(F.when(runs, F.greatest(t0, t1)).otherwise(float("inf")))
        inside = inside & (runs | p.between(a, b))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    hit = inside & (t0 <= t1)
    return F.when(hit, t0), F.when(hit, t1)


def _condition(base: Column, along: Column, height: Column, eps: float) -> Column:
    """Of the matrix (base, along; 0, height): the largest row sum times that of its inverse; infinite if singular."""
    rows = F.greatest(base + F.abs(along), height)
    inverse = F.greatest(1 / base + F.abs(along) / (base * height), 1 / height)
    return F.when((base > 0) & (height > 0) & (base * height >= eps), rows * inverse).otherwise(F.lit(float("inf")))


def jacobian_condition(a: Vector, b: Vector, c: Vector, eps: float = 1e-5) -> Column:
    """Of the map from the unit right triangle with its right angle at c; its first axis goes from c to b."""
    base, h = distance(b, c), norm(cross(minus(b, c), minus(a, c)))
    return F.when(base > 0, _condition(base, dot(minus(a, c), normalize(minus(b, c))), h / F.nullif(base, F.lit(0.0)), eps)).otherwise(F.lit(float("inf")))


def equilateral_condition(a: Vector, b: Vector, c: Vector, eps: float = 1e-7) -> Column:
    """As jacobian_condition, from the middle of the side b, c: the apex a lies above it in a symmetric triangle."""
    base, h = distance(b, c), norm(cross(minus(b, c), minus(a, c)))
    along = dot(minus(a, midpoint(b, c)), normalize(minus(b, c)))
    return F.when(base > 0, _condition(base, along, h / F.nullif(base, F.lit(0.0)), eps)).otherwise(F.lit(float("inf")))


def stiffness_condition(a: Vector, b: Vector, c: Vector) -> Column:
    """From areas and squared sides in units of the longest side: NaN where 48 area is below the square of the sides' sum,
    infinite for areas below 1e-6."""
    sides = [sqrnorm(minus(p, q)) for p, q in ((a, b), (b, c), (c, a))]
    longest, area = F.greatest(*sides), triangle_area(a, b, c)
    total, unit = (sides[0] + sides[1] + sides[2]) / longest, area / longest
    rest = 48 * unit - total * total
    return F.when(area < 1e-6, F.lit(float("inf"))).when(rest < 0, F.lit(float("nan"))).otherwise(F.sqrt(total * total + rest) / (8 * unit))


def quadratic_blend(x: Column, a: float, r: float) -> Column:
    """x up to a - r, 1 from a + r on, a parabola between."""
    y = x - r
    return F.when(x <= a - r, x).when(x >= a + r, F.lit(1.0)).otherwise(y + r - y * y * (0.5 * r))


def plane_quadric(normal: Vector, p: Vector) -> list[Column]:
    """The ten coefficients of the squared distance to a plane: the upper triangle of n n' with n = (normal, -normal p)."""
    n = (*normal, -dot(normal, p))
    return [n[i] * n[j] for i in range(4) for j in range(i, 4)]


def quadric_value(q: list[Column], p: Vector) -> Column:
    """A quadric at a point."""
    h, at, out = (*p, F.lit(1.0)), iter(q), F.lit(0.0)
    for i in range(4):
        for j in range(i, 4):
            out = out + next(at) * h[i] * h[j] * (1.0 if i == j else 2.0)
    return out
