"""Tiled sweeps and floods against a numpy sweep and a plain flood."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.operators import mesh, refine, surface, tiles


def plain_sweep(present, fixed, cell):
    """Node by node in eight orders until nothing changes."""
    value = {p: fixed.get(p, tiles.FAR) for p in present}
    axes = [sorted({p[k] for p in present}) for k in range(3)]
    changed = True
    while changed:
        changed = False
        for signs in np.ndindex(2, 2, 2):
            for x in axes[0][:: 1 - 2 * signs[0]]:
                for y in axes[1][:: 1 - 2 * signs[1]]:
                    for z in axes[2][:: 1 - 2 * signs[2]]:
                        p = (x, y, z)
                        if p not in value or p in fixed:
                            continue
                        a, b, c = sorted(min(value.get(tuple(v + s * (j == k) for j, v in enumerate(p)), tiles.FAR) for s in (-1, 1)) for k in range(3))
                        d = a + cell
                        if d > b:
                            d = (a + b + math.sqrt(max(0, 2 * cell**2 - (a - b) ** 2))) / 2
                        if d > c:
                            s = a + b + c
                            d = (s + math.sqrt(max(0, s * s - 3 * (a * a + b * b + c * c - cell**2)))) / 3
                        if d < value[p] - 1e-10:
                            value[p], changed = d, True
    return value


@pytest.mark.parametrize("side,low", [(4, -3), (32, 0)])
def test_sweep(spark, side, low):
    rng = np.random.default_rng(side)
    present = [tuple(int(v) + low for v in p) for p in np.ndindex(9, 7, 11) if rng.random() > 0.15]
    fixed = {present[int(k)]: float(rng.random()) for k in rng.integers(0, len(present), 4)}
    grid = spark.createDataFrame(present, "ix long, iy long, iz long")
    frozen = spark.createDataFrame([(*p, v) for p, v in fixed.items()], "ix long, iy long, iz long, value double")
    got = {(r.ix, r.iy, r.iz): r.value for r in tiles.eikonal3(grid, frozen, 0.5, side=side).collect()}
    expected = plain_sweep(present, fixed, 0.5)
    assert set(got) == set(expected) and all(abs(got[p] - v) < 1e-6 for p, v in expected.items())


def test_no_nodes_and_no_frozen(spark):
    grid = tiles.box_nodes(spark, (0, 0, 0), (2, 2, 2))
    frozen = spark.createDataFrame([], "ix long, iy long, iz long, value double")
    assert {r.value for r in tiles.eikonal3(grid, frozen).collect()} == {tiles.FAR}
    assert tiles.eikonal3(grid.limit(0), frozen).count() == 0
    assert tiles.flood_signs(grid.limit(0), frozen).count() == 0


@pytest.mark.parametrize("side", [3, 32])
def test_flood(spark, side):
    rng = np.random.default_rng(11)
    box = [tuple(int(v) - 5 for v in p) for p in np.ndindex(10, 8, 9)]
    frozen = {p for p in box if rng.random() < 0.6}
    free = set(box) - frozen
    first = min(free, key=lambda p: p[::-1])
    reached, todo = {first}, [first]
    while todo:
        p = todo.pop()
        for k in range(3):
            for s in (-1, 1):
                q = tuple(v + s * (j == k) for j, v in enumerate(p))
                if q in free and q not in reached:
                    reached.add(q)
                    todo.append(q)
    grid = spark.createDataFrame(box, "ix long, iy long, iz long")
    got = {(r.ix, r.iy, r.iz): r.sign for r in tiles.flood_signs(grid, spark.createDataFrame(list(frozen), "ix long, iy long, iz long"), side).collect()}
    assert got == {p: 1 if p in reached else -1 for p in box} and 1 < len(reached) < len(free)


def _tetrahedron(spark, faces):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 0.0, 1.0)], "mesh_id long, vid long, x double, y double, z double")
    return mesh.placed(spark.createDataFrame([(0, i, *f) for i, f in enumerate(faces)], "mesh_id long, fid long, v0 long, v1 long, v2 long"), v)


def test_field_of_a_tetrahedron(spark):
    """Nodes of a box widened by one: inside negative; first-order distances are too large by up to a cell and a half."""
    got = {(r.ix, r.iy, r.iz): r.value for r in tiles.mesh_field(_tetrahedron(spark, [(0, 1, 3), (1, 0, 2), (0, 3, 2), (1, 2, 3)]), 0.1, 1.0, side=16).collect()}
    assert got[2, 2, 2] < 0 < got[-5, 2, 2]
    assert got[-9, -9, -9] == pytest.approx(math.sqrt(3), abs=0.1) and got[-9, 2, 2] == pytest.approx(0.9, abs=0.1)
    whole = {(r.ix, r.iy, r.iz): r.value for r in tiles.mesh_field(_tetrahedron(spark, [(0, 1, 3), (0, 3, 2), (1, 2, 3)]), 0.1, 1.0).collect()}
    assert whole[2, 2, 2] > 0


def test_signs_of_a_closed_mesh_are_those_of_rays(spark):
    centre = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 2.0)], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centre, "octahedron")
    t = mesh.placed(f, v)
    rays = refine.signed_mesh_field(t, 0.25, 0.6)
    both = tiles.mesh_field(t, 0.25, 0.8, side=8).withColumnRenamed("value", "flood").join(rays, ["ix", "iy", "iz"]).where(F.abs("value") > 0.125)
    rows = both.collect()
    assert len(rows) > 500 and all((r.flood < 0) == (r.value < 0) for r in rows)
