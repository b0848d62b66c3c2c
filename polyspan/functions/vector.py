"""Vector algebra over tuples of columns; everything stays inside Spark's expressions.

A vector is a tuple of columns of two or three components. Division by a zero length gives zero vectors.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def vec(prefix: str, axes: str = "xyz") -> Vector:
    """The vector of the columns prefix + axis."""
    return tuple(F.col(prefix + k) for k in axes)


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scaled(a: Vector, k) -> Vector:
    return tuple(p * k for p in a)


def times(a: Vector, b: Vector) -> Vector:
    """Componentwise product."""
    return tuple(p * q for p, q in zip(a, b, strict=True))


def least(a: Vector, b: Vector) -> Vector:
    return tuple(F.least(p, q) for p, q in zip(a, b, strict=True))


def greatest(a: Vector, b: Vector) -> Vector:
    return tuple(F.greatest(p, q) for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, times(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def sqrnorm(a: Vector) -> Column:
    return dot(a, a)


def norm(a: Vector) -> Column:
    return F.sqrt(sqrnorm(a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def normalize(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.when(n > 0, p / n).otherwise(F.lit(0.0)) for p in a)


def perp(a: Vector) -> Vector:
    """A 2D vector turned by a quarter counter-clockwise."""
    return (-a[1], a[0])


def all_finite(a: Vector) -> Column:
    return reduce(lambda p, q: p & q, (~F.isnan(p) & (F.abs(p) != float("inf")) for p in a))


def affine(matrix: list[list[float]], p: Vector) -> Vector:
    """matrix (rows of 4) applied to a point, without a divide."""
    return tuple(reduce(add, (F.lit(float(m)) * q for m, q in zip(row, p))) + float(row[3]) for row in matrix[:3])


def projective(matrix: list[list[float]], p: Vector) -> Vector:
    w = reduce(add, (F.lit(float(m)) * q for m, q in zip(matrix[3], p))) + float(matrix[3][3])
    return tuple(F.try_divide(q, w) for q in affine(matrix, p))


def linear(matrix: list[list[float]], p: Vector) -> Vector:
    """Rotation and scale only."""
    return affine([[*row[:3], 0.0] for row in matrix[:3]], p)


def angle(a: Vector, b: Vector) -> Column:
    """Between two directions, 0 to pi; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))).otherwise(F.lit(0.0))
