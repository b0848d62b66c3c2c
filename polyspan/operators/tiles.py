"""Relaxations and components over 3D grids in tiles.

A grid (ix, iy, iz) is packed into tiles of SIDE nodes a side, one row each. A tile is worked on in one task by array
operations, and only the layers of nodes at its sides go to other tiles: rounds grow with the number of tiles that a front
has to cross, not with nodes. Nodes that are not in the grid are walls; grids of any shape and empty ones will do.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import fixpoint, refine
from .lineage import cut

SIDE = 32
#: What no frozen node reaches keeps this value.
FAR = 1e9
_TILE = ["tx", "ty", "tz"]
_ROWS = "tx long, ty long, tz long, kind string, side int, blob binary"
_ABSENT, _FIXED, _FREE = 0, 1, 2


def _tiled(nodes: DataFrame, side: int) -> DataFrame:
    """Nodes with the tile that they lie in and their place in it."""
    at = [F.floor(F.col("i" + k) / side).cast("long").alias("t" + k) for k in "xyz"]
    place = [F.pmod("i" + k, F.lit(side)).cast("long") for k in "xyz"]
    return nodes.select(*at, ((place[0] * side + place[1]) * side + place[2]).alias("place"), *(c for c in nodes.columns if c not in ("ix", "iy", "iz")))


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip([*_TILE, "kind", "side", "blob"], columns, kinds)})


def _state(blob: bytes, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and kinds of a tile's nodes, and the layers beside its six sides."""
    raw, n = zlib.decompress(blob), side**3
    values = np.frombuffer(raw, np.float64, n + 6 * side * side)
    return values[:n].reshape((side,) * 3).copy(), np.frombuffer(raw, np.uint8, n, 8 * len(values)).reshape((side,) * 3), values[n:].reshape(6, side, side).copy()


def _layer(side_number: int) -> tuple:
    """The nodes at a side: 2 k is where axis k is least, 2 k + 1 where it is greatest."""
    return tuple((0, -1)[side_number % 2] if k == side_number // 2 else slice(None) for k in range(3))


def _sweep(value: np.ndarray, kind: np.ndarray, beside: np.ndarray, cell: float, eps: float) -> None:
    """Gauss-Seidel in eight orders until no value falls by more than `eps`; `value` is changed in place. In any of the
    orders a node comes after those of the diagonal plane before its own, and none of its own plane touches it: a plane at a
    time is the same as a node at a time."""
    n = value.shape[0]
    wide = np.full((n + 2,) * 3, FAR)
    inner = (slice(1, -1),) * 3
    wide[inner] = value
    for s in range(6):
        wide[tuple((0, -1)[s % 2] if k == s // 2 else slice(1, -1) for k in range(3))] = beside[s]
    flat, m = wide.ravel(), n + 2
    free = np.argwhere(kind == _FREE)
    if not len(free):
        return
    place = ((free[:, 0] + 1) * m + free[:, 1] + 1) * m + free[:, 2] + 1
    orders = []
    for sy, sz in itertools.product((1, -1), repeat=2):
        depth = free[:, 0] + sy * free[:, 1] + sz * free[:, 2]
        by = np.argsort(depth, kind="stable")
        planes = np.split(place[by], np.flatnonzero(np.diff(depth[by])) + 1)
        orders += [planes, planes[::-1]]
    while True:
        fallen = 0.0
        for planes in orders:
            for p in planes:
                a, b, c = (np.minimum(flat[p - d], flat[p + d]) for d in (m * m, m, 1))
                low, high = np.minimum(a, b), np.maximum(a, b)
                a, b, c = np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)
                d = a + cell
                two = (a + b + np.sqrt(np.maximum(0.0, 2 * cell * cell - (a - b) ** 2))) / 2
                d = np.where(d > b, two, d)
                s = a + b + c
                three = (s + np.sqrt(np.maximum(0.0, s * s - 3 * (a * a + b * b + c * c - cell * cell)))) / 3
                d = np.minimum(np.where(d > c, three, d), flat[p])
                fallen = max(fallen, float((flat[p] - d).max()))
                flat[p] = d
        if fallen <= eps:
            break
    value[...] = flat.reshape(wide.shape)[inner]


def _round(side: int, cell: float, eps: float, first: bool):
    """A tile that has news from beside it, or any in the first round, is swept; layers that fell are told to the tile there."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, sides, blobs = (rows.column(c).to_pylist() for c in ("kind", "side", "blob"))
        if "state" not in kinds:
            return _rows([])
        at = [rows.column(c)[0].as_py() for c in _TILE]
        blob = blobs[kinds.index("state")]
        news = [(s, b) for kind, s, b in zip(kinds, sides, blobs) if kind == "layer"]
        if not news and not first:
            return _rows([(*at, "state", -1, blob)])
        value, kind, beside = _state(blob, side)
        before = np.full_like(value, FAR) if first else value.copy()
        for s, b in news:
            beside[s] = np.frombuffer(zlib.decompress(b), np.float64).reshape(side, side)
        _sweep(value, kind, beside, cell, eps)
        out = [(*at, "state", -1, _squeezed(value, beside, kind))]
        for s in range(6):
            if (before[_layer(s)] - value[_layer(s)] > eps).any():
                to = [t + (s % 2 * 2 - 1) * (k == s // 2) for k, t in enumerate(at)]
                out.append((*to, "layer", s ^ 1, _squeezed(np.ascontiguousarray(value[_layer(s)]))))
        return _rows(out)

    return run


def _packed(side: int):
    def run(rows: pa.Table) -> pa.Table:
        value, kind = np.full(side**3, FAR), np.zeros(side**3, np.uint8)
        place, given = (rows.column(c).to_numpy() for c in ("place", "value"))
        fixed = ~np.isnan(given)
        value[place[fixed]] = given[fixed]
        kind[place] = np.where(fixed, _FIXED, _FREE)
        return _rows([(*(rows.column(c)[0].as_py() for c in _TILE), "state", -1, _squeezed(value, np.full(6 * side * side, FAR), kind))])

    return run


def _unpacked(side: int):
    def run(batches):
        for batch in batches:
            for *at, blob in zip(*(batch.column(c).to_pylist() for c in (*_TILE, "blob"))):
                value, kind, _ = _state(blob, side)
                place = np.argwhere(kind != _ABSENT)
                yield pa.RecordBatch.from_pydict({**{"i" + k: place[:, j] + side * at[j] for j, k in enumerate("xyz")}, "value": value[kind != _ABSENT]})

    return run


def eikonal3(grid: DataFrame, frozen: DataFrame, cell: float = 1.0, eps: float = 1e-9, side: int = SIDE) -> DataFrame:
    """(ix, iy, iz, value): first-order upwind distances from frozen nodes (ix, iy, iz, value) over a 3D grid of nodes (ix, iy,
    iz), each once. Frozen nodes keep their values; nodes that none reaches have FAR. Tiles are swept until no value falls by
    more than `eps`. Of a node frozen twice the least value counts."""
    held = frozen.groupBy("ix", "iy", "iz").agg(F.min("value").cast("double").alias("value"))
    nodes = grid.select("ix", "iy", "iz").join(held, ["ix", "iy", "iz"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    state, first = cut(_tiled(nodes, side).groupBy(*_TILE).applyInArrow(_packed(side), _ROWS)), True
    while True:
        state = cut(state.groupBy(*_TILE).applyInArrow(_round(side, cell, eps, first), _ROWS))
        if state.where("kind = 'layer'").isEmpty():
            return state.where("kind = 'state'").mapInArrow(_unpacked(side), "ix long, iy long, iz long, value double")
        first = False


def _joined(edges: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n things' components."""
    up, (a, b) = np.arange(n), edges
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(up, b, a)
        while (up != (x := up[up])).any():
            up = x
    return up


def _components(side: int):
    """Numbers of the components within a tile of free nodes, and the layers of them at its sides."""

    def run(rows: pa.Table) -> pa.Table:
        at = [rows.column(c)[0].as_py() for c in _TILE]
        if max(map(abs, at)) >= 1 << 15:
            raise ValueError("the grid has more than 65536 tiles along an axis")
        free = np.zeros(side**3, bool)
        free[rows.column("place").to_numpy()] = True
        number = np.full(side**3, -1)
        number[free] = np.arange(free.sum())
        cube = number.reshape((side,) * 3)
        pairs = [(np.delete(cube, -1, k).ravel(), np.delete(cube, 0, k).ravel()) for k in range(3)]
        edges = np.concatenate([np.stack([a, b])[:, (a >= 0) & (b >= 0)] for a, b in pairs], 1)
        base = (at[0] << 48) + ((at[1] + (1 << 15)) << 32) + ((at[2] + (1 << 15)) << 16)
        number[free] = base + _joined(edges, int(free.sum()))
        number[~free] = np.iinfo(np.int64).min
        out = [(*at, "nodes", -1, _squeezed(number))]
        for s in range(6):
            # A border is named by the tile above it; side 0 to 2 by its axis.
            to = [t + (s % 2) * (k == s // 2) for k, t in enumerate(at)]
            out.append((*to, "layer", s // 2, _squeezed(np.ascontiguousarray(_cube(number, side)[_layer(s)]))))
        return _rows(out)

    return run


def _cube(values: np.ndarray, side: int) -> np.ndarray:
    return values.reshape((side,) * 3)


def _met(rows: pa.Table) -> pa.Table:
    """Components that touch across a border."""
    layers = [np.frombuffer(zlib.decompress(b), np.int64) for b in rows.column("blob").to_pylist()]
    none = np.iinfo(np.int64).min
    if len(layers) < 2:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    a, b = layers
    both = (a != none) & (b != none)
    u, v = np.unique(np.stack([a[both], b[both]]), axis=1)
    return pa.table({"u": u, "v": v})


def _numbered(side: int):
    def run(batches):
        for batch in batches:
            for *at, blob in zip(*(batch.column(c).to_pylist() for c in (*_TILE, "blob"))):
                number = _cube(np.frombuffer(zlib.decompress(blob), np.int64), side)
                place = np.argwhere(number != np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_pydict({**{"i" + k: place[:, j] + side * at[j] for j, k in enumerate("xyz")}, "node": number[tuple(place.T)]})

    return run


def free_components(free: DataFrame, side: int = SIDE) -> DataFrame:
    """(ix, iy, iz, label): connected parts, over faces, of a set of nodes: parts within tiles first, whose meetings at the
    tiles' borders are then joined."""
    rows = cut(_tiled(free.select("ix", "iy", "iz").distinct(), side).groupBy(*_TILE).applyInArrow(_components(side), _ROWS))
    nodes = cut(rows.where("kind = 'nodes'").mapInArrow(_numbered(side), "ix long, iy long, iz long, node long"))
    meetings = rows.where("kind = 'layer'").groupBy(*_TILE, "side").applyInArrow(_met, "u long, v long")
    labels = fixpoint.labels(nodes.select("node").distinct(), meetings)
    return nodes.join(labels, "node").select("ix", "iy", "iz", "label")


def flood_signs(grid: DataFrame, frozen: DataFrame, side: int = SIDE) -> DataFrame:
    """(ix, iy, iz, sign): 1 for the nodes that a flood over faces reaches from the first node that is not frozen (least iz, then iy, then
    ix), -1 for all others; frozen nodes stop the flood and have -1."""
    free = grid.select("ix", "iy", "iz").join(frozen.select("ix", "iy", "iz"), ["ix", "iy", "iz"], "left_anti")
    parts = cut(free_components(free, side))
    first = parts.agg(F.min(F.struct("iz", "iy", "ix", "label")).alias("m")).first().m
    outside = parts.where(F.col("label") == (first.label if first else 0)).select("ix", "iy", "iz", F.lit(1).alias("sign"))
    return grid.select("ix", "iy", "iz").join(outside, ["ix", "iy", "iz"], "left").withColumn("sign", F.coalesce("sign", F.lit(-1)))


def box_nodes(spark, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """All nodes (ix, iy, iz) of a closed box."""
    n = [h - a + 1 for a, h in zip(low, high)]
    k = F.col("id")
    return spark.range(n[0] * n[1] * n[2]).select((k % n[0] + low[0]).alias("ix"), (F.floor(k / n[0]) % n[1] + low[1]).alias("iy"), (F.floor(k / (n[0] * n[1])) + low[2]).alias("iz"))


def mesh_field(triangles: DataFrame, cell: float, margin: float, signed: bool = True, band: float | None = None, side: int = SIDE) -> DataFrame:
    """(ix, iy, iz, value): the distance to a mesh (fid, ax .. cz) at all nodes of its box widened by `margin`: exact within
    `band` (one cell unless given), from there on by the eikonal sweep; with `signed` negative where no flood from
    outside comes, the nodes nearest to the surface (half a cell or less) included. An open mesh does not stop the flood."""
    band = cell if band is None else band
    lo, hi = G.bounds(V.vec("a"), V.vec("b"), V.vec("c"))
    ends = triangles.agg(*(F.min(x).alias("lo" + k) for k, x in zip("xyz", lo)), *(F.max(x).alias("hi" + k) for k, x in zip("xyz", hi))).first()
    if ends.lox is None:
        return triangles.sparkSession.createDataFrame([], "ix long, iy long, iz long, value double")
    box = [tuple(int(np.floor((ends[e + k] + d) / cell)) for k in "xyz") for e, d in (("lo", -margin), ("hi", margin + cell))]
    nodes = box_nodes(triangles.sparkSession, *box)
    near = cut(refine.mesh_field(triangles, cell, band))
    value = eikonal3(nodes, near, cell, side=side)
    if not signed:
        return value
    # A step over a face crosses the surface within half a cell of one of its ends.
    wall = near.where(F.col("value") <= cell / 2)
    signs = flood_signs(nodes, wall, side)
    return value.join(signs, ["ix", "iy", "iz"]).select("ix", "iy", "iz", (F.col("value") * F.col("sign")).alias("value"))
