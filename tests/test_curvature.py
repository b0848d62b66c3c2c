"""Curvatures, saliency, noise, ring densities and discs in polygons against plain versions and known shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.operators import curvature, density, mesh, noise, surface
from polyspan.operators.lineage import cut


def flat_mesh(spark, point, nu, nv):
    """A grid of triangles over (u, v) places; point gives (x, y, z)."""
    v = [(0, j * nu + i, *map(float, point(i, j))) for j in range(nv) for i in range(nu)]
    f = []
    for j in range(nv - 1):
        for i in range(nu - 1):
            a = j * nu + i
            f += [(0, 2 * a, a, a + 1, a + nu + 1), (0, 2 * a + 1, a, a + nu + 1, a + nu)]
    return spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, v0 long, v1 long, v2 long")


def sphere(spark, r, steps):
    centre = spark.createDataFrame([(0, 0.0, 0.0, 0.0, float(r))], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centre, "octahedron")
    for _ in range(steps):
        v, f = map(cut, mesh.subdivide(v, f))
    length = F.sqrt(sum((F.col(k) * F.col(k) for k in "xyz"), F.lit(0.0)))
    return cut(v.select("mesh_id", "vid", *((F.col(k) * r / length).alias(k) for k in "xyz"))), f


@pytest.mark.parametrize("rings", [1, 2])
def test_cylinder(spark, rings):
    v, f = flat_mesh(spark, lambda i, j: (2 * math.cos(i * 0.1), 2 * math.sin(i * 0.1), j * 0.2), 30, 8)
    rows = {r.vid: r for r in curvature.tensor(f, v, rings).collect()}
    inner = [rows[j * 30 + i] for j in range(2, 6) for i in range(2, 28)]
    assert all(abs(r.kmax - 0.5) < 0.02 and abs(r.kmin) < 1e-6 for r in inner) and len(rows) == 240


def test_sphere_and_its_smoothing(spark):
    v, f = sphere(spark, 2, 3)
    for k in (curvature.tensor(f, v, 2), curvature.analyze(f, v), curvature.smoothed(curvature.tensor(f, v), f, v, 2)):
        got = k.agg(F.avg((F.col("kmin") + F.col("kmax")) / 2)).first()[0]
        assert got == pytest.approx(0.5, rel=0.05)
    even = v.select("mesh_id", "vid", F.lit(1.5).alias("kmin"), F.lit(2.5).alias("kmax"))
    assert {(round(r.kmin, 9), round(r.kmax, 9)) for r in curvature.smoothed(even, f, v, 3).collect()} == {(1.5, 2.5)}
    assert curvature.smoothed(even.withColumn("kmin", F.col("vid") * 1.0), f, v, 1, features=v).join(even, "vid").count() == v.count()
    assert curvature.saliency(even, f, v).agg(F.max("saliency")).first()[0] < 1e-12


def test_flat_empty_and_loose_vertices(spark):
    v, f = flat_mesh(spark, lambda i, j: (i, j, 0), 4, 4)
    v = v.unionByName(spark.createDataFrame([(0, 99, 5.0, 5.0, 5.0)], v.schema))
    for k in (curvature.tensor(f, v), curvature.analyze(f, v)):
        assert {(abs(round(r.kmin, 9)), abs(round(r.kmax, 9))) for r in k.collect()} == {(0.0, 0.0)} and k.count() == 17
    assert curvature.tensor(f.limit(0), v).count() == 17
    assert {r.saliency for r in curvature.saliency(curvature.tensor(f, v), f, v, normalized=True).collect()} == {0.0}
    with pytest.raises(ValueError):
        curvature.tensor(f, v, 3)


def test_feature_edges_of_chosen_vertices(spark):
    v, f = flat_mesh(spark, lambda i, j: (i, j, 0), 4, 4)
    k = v.select("mesh_id", "vid", F.when(F.col("vid") == 5, 1.0).otherwise(2.0).alias("kmin"), F.lit(8.5).alias("kmax"))
    marked = curvature.imbalanced(k, 5.0)
    assert [r.vid for r in marked.collect()] == [5]
    got = {(r.e0, r.e1) for r in curvature.feature_edges(marked, f).collect()}
    assert got == {(r.e0, r.e1) for r in mesh.edges(f).collect() if 5 in (r.e0, r.e1)}


def plain_noise(x, y, z, seed=0):
    cell = [math.floor(v) for v in (x, y, z)]
    part = [v - c for v, c in zip((x, y, z), cell)]
    axes = [(0, 1), (0, 2), (1, 2)]
    total = 0.0
    for corner in np.ndindex(2, 2, 2):
        h = seed
        for c, d in zip(cell, corner):
            h = (h + c + d) % 289
            h = (34 * h + 1) * h % 289
        g, weight, value = h % 12, 1.0, 0.0
        for sign, a in zip((g % 2 == 1, g % 4 >= 2), axes[g // 4]):
            value += (-1 if sign else 1) * (part[a] - corner[a])
        for t, d in zip(part, corner):
            e = 6 * t**5 - 15 * t**4 + 10 * t**3
            weight *= e if d else 1 - e
        total += weight * value
    return total


def test_noise_of_every_kind(spark):
    rnd = random.Random(3)
    at = [(i, rnd.uniform(-400, 400), rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(200)] + [(200, 3.0, -4.0, 5.0), (201, None, 1.0, 1.0)]
    points = spark.createDataFrame(at, "pid long, x double, y double, z double")
    xyz = [F.col(k) for k in "xyz"]
    got = {r.pid: r for r in noise.gradient_noise(points, "n", *xyz, seed=5).collect()}
    assert got[200].n == 0.0 and got[201].n is None
    assert all(got[i].n == pytest.approx(plain_noise(x, y, z, 5), abs=1e-9) for i, x, y, z in at[:200]) and max(abs(got[i].n) for i in range(200)) <= 1.5
    for kind in ("plain", "fbm", "turbulence", "ridge"):
        rows = {r.pid: r.n for r in noise.octaves(points, "n", *xyz, 3, 0.4, 2.1, kind).collect()}
        for i, x, y, z in at[:40]:
            want, last = 0.0, 1.0
            for o in range(3):
                value = plain_noise(*(v * 2.1**o for v in (x, y, z)), 0 if kind == "plain" else o)
                if kind == "ridge":
                    value = (1 - abs(value)) ** 2
                    want, last = want + value * last * 0.5 * 0.4**o, value
                else:
                    want += (abs(value) if kind == "turbulence" else value) * 0.4**o
            assert rows[i] == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        noise.octaves(points, "n", *xyz, 2, kind="other")


def test_ring_areas(spark):
    hexagon = [(math.cos(a * math.pi / 3), math.sin(a * math.pi / 3), 0.0) for a in (0, 3, 1, 5, 2, 4)]
    rings = {1: hexagon, 2: hexagon[:2], 3: [(1.0, 0, 0), (2.0, 0, 0), (-3.0, 0, 0)], 4: [(0.0, 0, 0), (0.0, 0, 0), (0.0, 0, 0)], 5: [(1.0, 0, 0), (2.0, 0, 0), (0, 1.0, 1.0), (-1.0, 0, 0)]}
    rows = [(k, [tuple(map(float, p)) for p in r]) for k, r in rings.items()]
    got = {r.k: r.area for r in density.ring_areas(spark.createDataFrame(rows, "k long, ring array<struct<x:double,y:double,z:double>>"), ["k"]).collect()}
    assert got[1] == pytest.approx(3 * 3**0.5 / 2) and got[2] == got[3] == got[4] == 0.0
    assert got[5] == pytest.approx(2 * 2**0.5 / 2 + 2**0.5 / 2)


def test_densities_of_few_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)], "pid long, x double, y double, z double")
    rows = {r.pid: r for r in density.ring_densities(points, 9, 1.0).collect()}
    assert all(r.n_found == 2 and r.area == 0.0 and r.density == 2 / 1e10 for r in rows.values())
    assert density.ring_densities(points.where("pid = 1"), 9, 1.0).first().density == 0.0
    assert density.softmax_sample(density.ring_densities(points, 9, 1.0), 5).count() == 3


def inside(poly, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            odd = not odd
    return odd


def test_discs_in_polygons(spark):
    star = [((2 if i % 2 else 5) * math.cos(i * math.pi / 5) + 3, (2 if i % 2 else 5) * math.sin(i * math.pi / 5)) for i in range(10)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(g, i, float(x), float(y)) for g, p in ((1, star), (2, square)) for i, (x, y) in enumerate(p)]
    corners = spark.createDataFrame(rows, "polygon_id long, seq long, x double, y double")
    got = sorted(tuple(r) for r in density.discs_in_polygons(corners, 0.5).collect())
    assert got == sorted(tuple(r) for r in density.discs_in_polygons(corners.repartition(5), 0.5).collect())
    for g, poly in ((1, star), (2, square)):
        own = np.array([(x, y) for k, _, x, y in got if k == g])
        assert len(own) > 20 and all(inside(poly, x, y) for x, y in own)
        d = np.hypot(*(own[:, None] - own[None]).transpose(2, 0, 1)) + 9 * np.eye(len(own))
        assert d.min() > 0.5
        # random places of the polygon are mostly near a taken one
        rnd = np.random.default_rng(1)
        at = [p for p in rnd.uniform(-3, 9, (3000, 2)) if inside(poly, *p)]
        near = [np.hypot(*(own - p).T).min() <= 0.5 for p in at]
        assert np.mean(near) > 0.9
    assert density.discs_in_polygons(corners.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        density.discs_in_polygons(corners, 0.5, attempts=0)
