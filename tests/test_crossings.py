"""Intersection lines and polylines, rays in any direction and distances between surfaces against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.operators import mesh, shapes, surface

NAMES = [p + k for p in "abc" for k in "xyz"]


def table(spark, triangles):
    return spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate(triangles)], "fid long, " + ", ".join(f"{n} double" for n in NAMES))


def plain_segment(s, t):
    """Both ends of what two triangles in general position have in common: edges of one through the other."""
    ends = []
    for x, y in ((s, t), (t, s)):
        n = np.cross(y[1] - y[0], y[2] - y[0])
        for i in range(3):
            p, q = x[i], x[(i + 1) % 3]
            hp, hq = n @ (p - y[0]), n @ (q - y[0])
            if hp * hq < 0:
                m = p + (q - p) * hp / (hp - hq)
                if all(n @ np.cross(y[(j + 1) % 3] - y[j], m - y[j]) >= 0 for j in range(3)):
                    ends.append(m)
    return ends


def test_segments_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    tri = rng.random((120, 1, 3)) * 3 + rng.random((120, 3, 3))
    got = {(r.a, r.b): np.array(r[2:]) for r in surface.intersection_segments(table(spark, tri), 0.8).collect()}
    expected = {(i, j): e for i in range(120) for j in range(i + 1, 120) if len(e := plain_segment(tri[i], tri[j])) == 2}
    assert set(got) == set(expected) and len(got) > 20
    for k, (p, q) in expected.items():
        d = np.cross(np.cross(*(tri[k[0]][i] - tri[k[0]][0] for i in (1, 2))), np.cross(*(tri[k[1]][i] - tri[k[1]][0] for i in (1, 2))))
        p, q = (p, q) if d @ p <= d @ q else (q, p)
        assert np.allclose(got[k], [*p, *q], atol=1e-9)


def test_coplanar_touching_and_empty(spark):
    flat = lambda *p: [(x, y, 1.0) for x, y in p]
    tri = [flat((0, 0), (2, 0), (0, 2)), flat((1, 1), (3, 1), (3, 3)), flat((0.2, 0.2), (0.5, 0.2), (0.2, 0.5)), flat((1.5, 1.5), (1.6, 3), (0, 3)), [(0, 0, 0), (2, 0, 0), (1, 0, 1)], flat((5, 5), (5, 5), (5, 5))]
    t = table(spark, tri)
    assert {tuple(r) for r in surface.coplanar_pairs(t, 1.0).collect()} == {(0, 1), (0, 2), (1, 3)}
    lines = {(r.a, r.b): r[2:] for r in surface.intersection_segments(t, 1.0).collect()}
    assert {k: v for k, v in lines.items() if k == (0, 4)} == {(0, 4): (1.0, 0.0, 1.0, 1.0, 0.0, 1.0)}
    assert all(4 in k for k in lines)
    assert surface.intersection_segments(t.limit(0), 1.0).count() == 0 and surface.coplanar_pairs(t.limit(0), 1.0).count() == 0
    assert surface.chained(surface.intersection_segments(t.limit(0), 1.0), 1e-6).count() == 0


def test_two_spheres_cross_in_one_closed_line(spark):
    """Unit spheres 1.2 apart: a circle of radius 0.8 across the middle."""
    centres = spark.createDataFrame([(0, 0.03, 0.01, 0.02, 1.0), (1, 1.23, 0.01, 0.02, 1.0)], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centres, "octahedron")
    for _ in range(2):
        v, f = mesh.subdivide(v, f)
        v = surface.projected(v, centres)
    n = f.agg(F.max("fid")).first()[0] + 1
    t = mesh.placed(f, v).select((F.col("mesh_id") * n + F.col("fid")).alias("fid"), *NAMES)
    got = surface.chained(surface.intersection_segments(t, 0.2).where((F.col("a") < n) & (F.col("b") >= n)), 1e-7).orderBy("line_id", "seq").collect()
    assert len({r.line_id for r in got}) == 1 and all(r.closed for r in got) and len(got) > 20
    assert [r.seq for r in got] == list(range(len(got))) and tuple(got[0])[2:5] == tuple(got[-1])[2:5]
    p = np.array([(r.x, r.y, r.z) for r in got])
    assert np.allclose(p[:, 0], 0.63, atol=0.05) and np.allclose(np.hypot(p[:, 1] - 0.01, p[:, 2] - 0.02), 0.8, atol=0.1)
    length = np.linalg.norm(np.diff(p, axis=0), axis=1).sum()
    assert length == pytest.approx(2 * math.pi * 0.8, rel=0.08)


def test_chains_end_at_knots(spark):
    at = {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (3, 0), "e": (2, 1), "f": (2, 2), "g": (9, 9), "h": (9, 8), "i": (8, 8)}
    rows = [(*map(float, at[p]), 0.0, *map(float, at[q]), 0.0) for p, q in ("ab", "cb", "cd", "ce", "fe", "gh", "hi", "ig", "ba", "aa")]
    got = surface.chained(spark.createDataFrame(rows, "px double, py double, pz double, qx double, qy double, qz double"), 1e-3).orderBy("line_id", "seq").collect()
    name = {v: k for k, v in at.items()}
    lines = {}
    for r in got:
        lines.setdefault((r.line_id, r.closed), []).append(name[int(r.x), int(r.y)])
    found = sorted(("".join(p), c) for (_, c), p in lines.items())
    assert [(min(p, p[::-1]) if not c else "".join(sorted(set(p))), c) for p, c in found] == sorted([("abc", False), ("cd", False), ("cef", False), ("ghi", True)])


@pytest.mark.parametrize("cell", [0.3, 1.7])
def test_rays_against_all_triangles(spark, cell):
    rng = np.random.default_rng(5)
    tri = rng.random((150, 1, 3)) * 4 - 2 + rng.random((150, 3, 3))
    o, d = rng.random((90, 3)) * 6 - 3, rng.standard_normal((90, 3))
    d[:6] = [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -2, 0)]
    d[6] = (1, 1, 0)
    rays = spark.createDataFrame([(i, *map(float, o[i]), *map(float, d[i])) for i in range(90)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.rid: (r.n_hits, r.fid, r.t) for r in surface.ray_hits(rays, table(spark, tri), cell).collect()}
    hits = 0
    for i in range(90):
        met = []
        for j, (a, b, c) in enumerate(tri):
            m = np.array([b - a, c - a, -d[i]]).T
            u, v, t = np.linalg.solve(m, o[i] - a)
            if u >= 0 and v >= 0 and u + v <= 1 and t >= 0:
                met.append((t, j))
        hits += len(met)
        assert got[i][0] == len(met)
        if met:
            assert got[i][1] == min(met)[1] and got[i][2] == pytest.approx(min(met)[0], abs=1e-9)
    assert hits > 8
    assert surface.ray_hits(rays, table(spark, tri).limit(0), cell).where("n_hits = 0 and t is null").count() == 90


def test_no_ray_slips_through_shared_edges(spark):
    """Rays from inside a closed mesh through its corners, edges and along cell borders all meet it."""
    centre = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0)], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centre, "octahedron")
    v, f = mesh.subdivide(v, f)
    t = mesh.placed(f, v)
    goals = [tuple(np.array(g, float) / 4) for g in np.ndindex(9, 9, 9)]
    rows = [(i, 0.0, 0.0, 0.0, *(float(x - 1) for x in g)) for i, g in enumerate(goals) if any(x != 1 for x in g)]
    got = surface.ray_hits(spark.createDataFrame(rows, "rid long, ox double, oy double, oz double, dx double, dy double, dz double"), t, 1.0)
    assert got.where("n_hits = 0").count() == 0 and got.count() == len(rows)


def test_distance_of_surfaces(spark):
    """A sheet above a ridge: the farthest point lies inside a triangle, no corner shows it."""
    low = [[(0, 0, 0), (4, 0, 0), (0, 4, 0)], [(4, 0, 0), (4, 4, 0), (0, 4, 0)]]
    high = [[(-1, -1, 0.5), (5, -1, 0.5), (-1, 5, 3.5)], [(5, -1, 0.5), (5, 5, 3.5), (-1, 5, 3.5)]]
    a, b = table(spark, low), table(spark, high)
    for left, right, tri, goal in ((a, b, low, high), (b, a, high, low)):
        found = surface.surface_distance(left, right, 2.0, 0.2).first()
        w = np.array([(i, j, 60 - i - j) for i in range(61) for j in range(61 - i)]) / 60
        points = np.concatenate([w @ np.array(t, float) for t in tri])
        rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "pid long, x double, y double, z double")
        sampled = shapes.nearest_triangle(rows, right, 1.0).agg(F.max("d")).first()[0]
        assert found.upper - found.lower <= 0.2 + 1e-12 and found.lower - 0.15 <= sampled <= found.upper + 1e-9
    assert surface.surface_distance(a.limit(0), b, 1.0, 0.1).first().lower is None
