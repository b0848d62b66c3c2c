"""Creased normals, the Laplacian over Voronoi areas and samples with normals on known shapes."""

import math

import pytest

from polyspan.operators import normals

CUBE = [(x, y, z) for z in (0.0, 1.0) for y in (0.0, 1.0) for x in (0.0, 1.0)]
SIDES = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]


@pytest.fixture(scope="module")
def cube(spark):
    v = [(m, i, *p) for m in (0, 1) for i, p in enumerate(CUBE)] + [(1, 99, 5.0, 5.0, 5.0)]
    f = [(m, 2 * k + h, *t) for m in (0, 1) for k, (a, b, c, d) in enumerate(SIDES) for h, t in enumerate(((a, b, c), (a, c, d)))]
    return spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, v0 long, v1 long, v2 long")


@pytest.mark.parametrize("crease", [0.0, 1.0])
def test_sharp_corners(cube, crease):
    v, f = cube
    rows = normals.corner_normals(f, v, crease).collect()
    assert len(rows) == 72
    for r in rows:
        side = [CUBE[i] for i in SIDES[r.fid // 2]]
        out = [sum(p[k] for p in side) / 2 - 1 for k in range(3)]  # from the middle of the cube to that of the side, doubled
        assert math.dist((r.nx, r.ny, r.nz), out) < 1e-12


@pytest.mark.parametrize("crease", [2.0, 4.0])
def test_round_corners(cube, crease):
    v, f = cube
    rows = normals.corner_normals(f, v, crease).collect()
    assert len(rows) == 72
    for r in rows:  # three right angles a vertex
        out = [(2 * c - 1) / 3**0.5 for c in CUBE[r.vid]]
        assert math.dist((r.nx, r.ny, r.nz), out) < 1e-12


def test_flat_triangles_and_none(spark, cube):
    v, f = cube
    flat = spark.createDataFrame([(0, 50, 0, 1, 1)], f.schema)
    rows = {(r.fid, r.vid): (r.nx, r.ny, r.nz) for r in normals.corner_normals(f.where("mesh_id = 0").unionByName(flat), v, 1.0).collect()}
    assert rows[50, 0] == rows[50, 1] == (0.0, 0.0, 0.0) and rows[0, 0] == (0.0, 0.0, -1.0)
    assert normals.corner_normals(f.limit(0), v, 1.0).count() == 0
    assert normals.laplace_voronoi(f.limit(0), v).count() == 0


def test_laplace_of_a_cube(cube):
    v, f = cube
    for r in normals.laplace_voronoi(f, v).collect():
        # diagonals have weight 0, each edge two cotangents of 45 degrees; three quarters of a side a vertex
        out = [2 * (1 - 2 * c) / (2 * 0.75) for c in CUBE[r.vid]]
        assert math.dist((r.lx, r.ly, r.lz), out) < 1e-9


def test_oriented_sample(cube):
    v, f = cube
    rows = normals.oriented_sample(f, v, 17, seed=1).collect()
    assert {(r.mesh_id, r.vid) for r in rows} == {(m, i) for m in (0, 1) for i in range(8)} | {(1, 99)}
    for r in rows:
        out = [0.0] * 3 if r.vid == 99 else [(2 * c - 1) / 3**0.5 for c in CUBE[r.vid]]
        assert math.dist((r.nx, r.ny, r.nz), out) < 1e-12
    some = normals.oriented_sample(f, v, 5, seed=1).collect()
    assert len(some) == 5 and {tuple(r) for r in some} <= {tuple(r) for r in rows}
