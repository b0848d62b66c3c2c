"""Evolution of curves by their normal speed: each step is a window over the curve, cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import curves
from .lineage import cut


def shrink(curve: DataFrame, tau: float, steps: int, closed: bool = True) -> DataFrame:
    """Curvature flow by explicit steps of size tau: p + tau (2 / (l0 + l1)) ((next - p) / l1 - (p - previous) / l0).
    Ends of open curves stay. Stable for tau below a quarter of the squared shortest edge."""
    out = curve.select("curve_id", "seq", "x", "y")
    for _ in range(steps):
        c = curves.neighbours(out, closed)
        p, q, r = V.vec("p", "xy"), (F.col("x"), F.col("y")), V.vec("n", "xy")
        l0, l1 = V.distance(q, p), V.distance(r, q)
        move = [(2 / (l0 + l1)) * (F.try_divide(c2 - c1, l1) - F.try_divide(c1 - c0, l0)) for c0, c1, c2 in zip(p, q, r, strict=True)]
        ok = (l0 > 0) & (l1 > 0)
        out = cut(c.select("curve_id", "seq", *((F.col(k) + F.when(ok, tau * m).otherwise(0.0)).alias(k) for k, m in zip("xy", move, strict=True))))
    return out


def value_log(states: list[DataFrame], column: str) -> DataFrame:
    """(step, curve_id, seq, value): a column of successive states as one table."""
    logs = [s.select(F.lit(i).alias("step"), "curve_id", "seq", F.col(column).alias("value")) for i, s in enumerate(states)]
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out
