"""Matrices whose entries are columns, so that every row of a table may have its own transform.

A matrix is a list of rows of columns or numbers. Angles are in degrees but for quaternions, which take radians.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vector, cross, dot, minus, normalize, plus, scaled

Matrix = list[list]


def translation(t: Vector) -> Matrix:
    n = len(t)
    return [[1.0 if i == j else 0.0 for j in range(n)] + [t[i]] for i in range(n)] + [[0.0] * n + [1.0]]


def scaling(s: Vector) -> Matrix:
    """By a factor an axis; three (or two) equal factors scale uniformly."""
    n = len(s)
    return [[s[i] if i == j else 0.0 for j in range(n + 1)] for i in range(n)] + [[0.0] * n + [1.0]]


def rotation_2d(centre: Vector, degrees: Column) -> Matrix:
    """Counter-clockwise around a point of the plane."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    x, y = centre
    return [[c, -s, x - c * x + s * y], [s, c, y - s * x - c * y], [0.0, 0.0, 1.0]]


def rotation(axis: Vector, degrees: Column) -> Matrix:
    """Right-handed around an axis of any length through the origin; a zero axis scales by the cosine."""
    u = normalize(axis)
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    skew = [[F.lit(0.0), -u[2], u[1]], [u[2], F.lit(0.0), -u[0]], [-u[1], u[0], F.lit(0.0)]]
    rows = [[u[i] * u[j] * (1 - c) + skew[i][j] * s + (c if i == j else F.lit(0.0)) for j in range(3)] + [0.0] for i in range(3)]
    return [*rows, [0.0, 0.0, 0.0, 1.0]]


def rotation_about(k: str, degrees: Column) -> Matrix:
    """Around the x, y or z axis, clockwise as seen against the axis: the opposite sense of `rotation`."""
    return rotation(tuple(F.lit(1.0 if k == a else 0.0) for a in "xyz"), -degrees)


def between_boxes(lo0: Vector, hi0: Vector, lo1: Vector, hi1: Vector, uniform: bool = False) -> Matrix:
    """Scales by the ratio of the boxes' sides (with `uniform` by the mean ratio), then moves by the difference of the lower
    corners. It takes one box onto the other if the first one's lower corner is the origin. Null for a side of zero."""
    ratios = tuple(F.try_divide(b - a, d - c) for a, b, c, d in zip(lo1, hi1, lo0, hi0, strict=True))
    if uniform:
        ratios = (reduce(add, ratios) / len(ratios),) * len(ratios)
    return multiplied(translation(minus(lo1, lo0)), scaling(ratios))


def multiplied(a: Matrix, b: Matrix) -> Matrix:
    return [[reduce(add, (_column(a[i][k]) * b[k][j] for k in range(len(b)))) for j in range(len(b[0]))] for i in range(len(a))]


def applied(m: Matrix, p: Vector) -> Vector:
    """An affine matrix to a point."""
    return tuple(reduce(add, (q * e for e, q in zip(row, p))) + row[-1] for row in m[: len(p)])


def determinant(m: Matrix) -> Column:
    if len(m) == 1:
        return _column(m[0][0])
    return reduce(add, ((_column(m[0][j]) if j % 2 == 0 else -_column(m[0][j])) * determinant(_without(m, 0, j)) for j in range(len(m))))


def inverse(m: Matrix) -> Matrix:
    """By cofactors; null entries for a singular matrix."""
    d, n = determinant(m), range(len(m))
    return [[F.try_divide(determinant(_without(m, j, i)) * (-1.0 if (i + j) % 2 else 1.0), d) for j in n] for i in n]


def quaternion(axis: Vector, radians: Column) -> Vector:
    """(x, y, z, w) of a turn around a unit axis."""
    return (*scaled(axis, F.sin(radians / 2)), F.cos(radians / 2))


def turned(p: Vector, q: Vector) -> Vector:
    """A vector turned by a unit quaternion."""
    twice = scaled(cross(q[:3], p), 2)
    return plus(plus(p, scaled(twice, q[3])), cross(q[:3], twice))


def quarter_turn(p: Vector, axis: Vector) -> Vector:
    """A vector turned counter-clockwise by a right angle around a unit axis."""
    return plus(cross(axis, p), scaled(axis, dot(axis, p)))


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _without(m: Matrix, i: int, j: int) -> Matrix:
    return [[e for c, e in enumerate(row) if c != j] for r, row in enumerate(m) if r != i]
