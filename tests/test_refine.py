"""Refinement, mesh distance fields, streamlines, cloud normals, curve and image files against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.operators import mesh, refine, surface
from polyspan.operators.lineage import cut
from polyspan.sources import sinks, text_meshes

CUBE = [(float(x), float(y), float(z)) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
SIDES = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]


def _cube(spark):
    v = spark.createDataFrame([(0, i, *p) for i, p in enumerate(CUBE)], "mesh_id long, vid long, x double, y double, z double")
    return v, spark.createDataFrame([(0, i, f) for i, f in enumerate(SIDES)], "mesh_id long, fid long, vids array<long>")


def test_catmull_clark_of_a_cube(spark):
    v, f = _cube(spark)
    new, quads = refine.catmull_clark(v, f)
    rows = {r.vid: (r.x, r.y, r.z) for r in new.collect()}
    assert len(rows) == 8 + 12 + 6 and quads.count() == 24
    # a corner of three faces: (mean of faces + twice the mean of edge middles) / 3
    assert rows[0] == pytest.approx((2 / 9,) * 3)
    assert {k for q in quads.collect() for k in q.vids} == set(rows)
    again, more = refine.catmull_clark(cut(new), cut(quads))
    assert again.count() == 26 + 48 + 24 and more.count() == 96


def test_catmull_clark_rim(spark):
    v = spark.createDataFrame([(0, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (5, 5)])], "mesh_id long, vid long, x double, y double, z double")
    new, quads = refine.catmull_clark(v, spark.createDataFrame([(0, 0, [0, 1, 2, 3])], "mesh_id long, fid long, vids array<long>"))
    rows = {r.vid: (r.x, r.y) for r in new.collect()}
    assert rows[0] == (0.125, 0.125) and rows[4] == (5.0, 5.0) and quads.count() == 4
    none, nothing = refine.catmull_clark(v.limit(0), spark.createDataFrame([], "mesh_id long, fid long, vids array<long>"))
    assert none.count() == 0 and nothing.count() == 0


def test_signed_field_of_an_octahedron(spark):
    centre = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 2.0)], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centre, "octahedron")
    got = {(r.ix, r.iy, r.iz): r.value for r in refine.signed_mesh_field(mesh.placed(f, v), 0.5, 0.8).collect()}
    checked = 0
    for i in np.ndindex(11, 11, 11):
        node = tuple(int(k) - 5 for k in i)
        q = np.abs(np.array(node) * 0.5 - (0.1, 0.2, 0.3))
        side = (q.sum() - 2.0) / math.sqrt(3)  # beyond the plane of the octant's face
        foot = q - side / math.sqrt(3)
        if (foot >= 0).all() and abs(side) <= 0.8:  # the nearest point lies within that face
            assert got[node] == pytest.approx(side, abs=1e-9)
            checked += 1
        elif node in got:
            assert (got[node] < 0) == bool(side < 0)
    assert checked > 100


@pytest.mark.parametrize("order,error", [(4, 1e-6), (1, 0.02)])
def test_streamlines_in_a_whirl(spark, order, error):
    grid = spark.createDataFrame([(i, j, -float(j), float(i)) for i in range(-3, 4) for j in range(-3, 4)], "ix long, iy long, gx double, gy double")
    seeds = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.9, 2.9)], "pid long, x double, y double")
    got = {(r.pid, r.step): (r.x, r.y) for r in refine.streamlines(grid, seeds, 0.1, 3, order=order).collect()}
    assert got[0, 3] == pytest.approx((math.cos(0.3), math.sin(0.3)), abs=error)
    assert (1, 0) in got and (1, 3) not in got


def test_normals_by_neighbours(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(60, 3)) * (1.0, 0.7, 0.2)
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "pid long, x double, y double, z double")
    for r in refine.cloud_normals(points, 7, 0.3).collect():
        near = np.argsort(((p - p[r.pid]) ** 2).sum(axis=1))[:8]
        values, axes = np.linalg.eigh(np.cov(p[near].T))
        if values[1] > 1.05 * values[0]:
            assert abs(np.dot(axes[:, 0], (r.nx, r.ny, r.nz))) == pytest.approx(1, abs=1e-6) and r.nz > 0
    line = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "pid long, x double, y double, z double")
    assert all(r.nx is None for r in refine.cloud_normals(line, 2, 1.0).collect())


@pytest.mark.parametrize("closed", [False, True])
def test_curve_files(spark, tmp_path, closed):
    rows = [(7, s, float(s), s / 3) for s in (2, 5, 9)] + [(3, 1, 0.5, -1.0)]
    curves = spark.createDataFrame(rows, "curve_id long, seq long, x double, y double")
    sinks.write_lines(sinks.curve_ply_lines(curves, closed), str(tmp_path / "ply"))
    v, e = text_meshes.read_ply(spark, str(tmp_path / "ply/*/*.txt"), True, "edge")
    assert sorted((r.vid, r.x, r.y) for r in v.collect()) == [(0, 0.5, -1.0), (1, 2.0, 2 / 3), (2, 5.0, 5 / 3), (3, 9.0, 3.0)]
    assert sorted(tuple(r.vids) for r in e.collect()) == [(1, 2), (2, 3), *([(3, 1)] if closed else [])]
    sinks.write_lines(sinks.polyline_obj_lines(curves, closed), str(tmp_path / "obj"))
    v, lines = text_meshes.read_polylines(spark, str(tmp_path / "obj/*/*.txt"), True)
    assert v.count() == 4 and sorted(tuple(r.vids) for r in lines.collect()) == ([(0, 0), (1, 2, 3, 1)] if closed else [(0,), (1, 2, 3)])


def test_image_data(spark, tmp_path):
    nodes = [(i, j, k, i + 10.0 * j + 100 * k) for i in range(3) for j in range(2) for k in range(4)]
    grid = spark.createDataFrame(nodes, "ix long, iy long, iz long, value double")
    sinks.write_lines(sinks.vti_lines(grid.where("value <> 111")), str(tmp_path / "vti"))
    got = text_meshes.read_vti(spark, str(tmp_path / "vti/*/*.txt"), True)
    assert sorted(tuple(r) for r in got.where(~F.isnan("value")).select("ix", "iy", "iz", "value").collect()) == sorted(n for n in nodes if n[3] != 111) and got.count() == 24
    (tmp_path / "a.vti").write_text('<VTKFile type="ImageData">\n<ImageData WholeExtent="0 1 0 1 0 0">\n<DataArray>\n1 2 3\n4\n</DataArray>\n</ImageData></VTKFile>\n')
    assert sorted(tuple(r) for r in text_meshes.read_vti(spark, str(tmp_path / "a.vti")).select("iz", "iy", "ix", "value").collect()) == [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 0, 3.0), (0, 1, 1, 4.0)]
