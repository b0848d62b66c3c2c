"""Planar hulls of clouds of any size: each task keeps only hull corners of what it has seen, and the hull of those is
the hull of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the convex hull's corners, counter-clockwise from the leftmost (monotone chain); of equal points the
    first."""
    order = np.lexsort((y, x))
    keep = np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])
    order = order[keep]
    if len(order) < 3:
        return order

    def chain(places) -> list[int]:
        out: list[int] = []
        for i in places:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return np.array(chain(order.tolist()) + chain(order[::-1].tolist()))


def convex_hulls(points: DataFrame, by: str = "cloud_id") -> DataFrame:
    """(by, seq, pid, x, y): hull corners of each cloud, in order."""
    schema = points.select(by, "pid", "x", "y").schema

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.sort_values("pid").groupby(by, sort=False):
                yield own.iloc[hull_order(own["x"].to_numpy(), own["y"].to_numpy())]

    def final(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pid", ignore_index=True)
        corners = own.iloc[hull_order(own["x"].to_numpy(), own["y"].to_numpy())]
        return corners.assign(seq=np.arange(len(corners)))[[by, "seq", "pid", "x", "y"]]

    corners = points.select(by, "pid", "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).mapInPandas(partial, schema)
    kind = schema[by].dataType.simpleString()
    return corners.groupBy(by).applyInPandas(final, f"{by} {kind}, seq long, pid {schema['pid'].dataType.simpleString()}, x double, y double")


def principal_axes(points: DataFrame, by: str = "cloud_id") -> DataFrame:
    """(by, e1, e2, e3): standard deviations along the principal axes, largest first. Spark sums the covariance, a task
    solves a 3 by 3 problem a cloud."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = points.groupBy(by).agg(*(F.covar_pop(a, b).alias(a + b) for a, b in pairs))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = f[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            e = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0))[:, ::-1]
            yield pd.DataFrame({by: f[by], "e1": e[:, 0], "e2": e[:, 1], "e3": e[:, 2]})

    return sums.mapInPandas(solve, f"{by} {sums.schema[by].dataType.simpleString()}, e1 double, e2 double, e3 double")
