"""Results at sizes and places where a plainer plan lost or doubled work: limits, ties at the border, plans without large shuffles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from polyspan.operators import columns, fixpoint, joins, refine, sampling, segments, shapes, surface, triangle_pairs
from polyspan.sources import sinks, text_meshes

CORNERS = ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")


def triangles(spark, t):
    return spark.createDataFrame([(i, *map(float, np.ravel(x))) for i, x in enumerate(t)], f"fid long, {CORNERS}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


def test_hops_up_to_a_limit(spark):
    path = spark.createDataFrame([(k, k + 1, 1.0) for k in range(45)], "u long, v long, length double")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.distance for r in fixpoint.hop_distances(path, start, 30.0).collect()} == {k: float(k) for k in range(31)}
    assert fixpoint.hop_distances(path, start).count() == 46


def plain_distance(p, a, b, c):
    """In the order of operations of the query's SQL."""
    minus = lambda x, y: [i - j for i, j in zip(x, y)]
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    u, v, q = minus(b, a), minus(c, a), minus(p, a)
    d00, d01, d11, d20, d21 = dot(u, u), dot(u, v), dot(v, v), dot(q, u), dot(q, v)
    g, h = (d11 * d20 - d01 * d21) / (d00 * d11 - d01 * d01), (d00 * d21 - d01 * d20) / (d00 * d11 - d01 * d01)
    if 1 - g - h >= 0 and g >= 0 and h >= 0:
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return abs(dot(q, n)) / math.sqrt(dot(n, n))

    def side(s, e):
        w = minus(e, s)
        t = max(0.0, min(1.0, dot(minus(p, s), w) / dot(w, w)))
        r = [x - (i + t * j) for x, i, j in zip(p, s, w)]
        return math.sqrt(dot(r, r))

    return min(side(a, b), side(b, c), side(c, a))


def test_field_at_the_edge_of_its_band(spark):
    """Peaks whose height is the band below a node: the last digit decides, so it must be the SQL's."""
    rng = np.random.default_rng(7)
    tri = []
    for i in range(60):
        low = rng.integers(80_000, 200_000, 2) / 10_000
        corners = [(4.0 * i, 0.0, 24 - 1.37 if i % 2 else 22.63), (4.0 * i + 1, 0.0, low[0]), (4.0 * i + 1, 1.0, low[1])]
        tri.append(corners[i % 3 :] + corners[: i % 3])
    got = {(r.ix, r.iy, r.iz): r.value for r in refine.mesh_field(triangles(spark, tri), 1.0, 1.37).collect()}
    plain = {}
    for t in tri:
        lo, hi = np.min(t, axis=0), np.max(t, axis=0)
        spans = [range(math.ceil(a - 1.37), math.floor(b + 1.37) + 1) for a, b in zip(lo, hi)]
        for node in ((x, y, z) for x in spans[0] for y in spans[1] for z in spans[2]):
            d = plain_distance(tuple(map(float, node)), *t)
            if d <= 1.37:
                plain[node] = min(d, plain.get(node, 9.0))
    assert got == plain


def test_field_is_summed_where_its_tiles_lie(spark):
    """The only shuffle is that of triangles by tile; a triangle over several tiles gives each node once."""
    t = triangles(spark, [[(-70, -3, 0.5), (150, -2, 0.25), (10, 80, 3)], [(1, 2, 60), (2, 2, 70), (1, 3, 66)]])
    field = refine.mesh_field(t, 1.0, 1.2)
    assert exchanges(field) == 1 and "Exchange hashpartitioning(tx" in plan(field)
    nodes = [tuple(r) for r in field.select("ix", "iy", "iz").collect()]
    assert len(nodes) == len(set(nodes)) > 10_000


def test_triangles_that_all_meet(spark):
    """Several blocks in one place: no pair twice, none lost, none sent between tasks."""
    rng = np.random.default_rng(11)
    t = rng.normal(0, 1, (2300, 3, 3))
    t[::2] *= 0.05
    t[0] = np.nan
    df = triangles(spark, t)
    got = surface.intersecting_triangles(df, 0.25)
    assert "Join" not in plan(got).split("FlatMapGroups")[0]
    got = {(r.a, r.b) for r in got.collect()}
    i, j = np.triu_indices(300, 1)
    s = t[np.arange(0, 2300, 2300 // 300)[:300]]
    ids = np.arange(0, 2300, 2300 // 300)[:300]
    hit = triangle_pairs.crossing(s[i], s[j])
    assert {(int(a), int(b)) for a, b in zip(ids[i[hit]], ids[j[hit]])} == {(a, b) for a, b in got if a in set(ids) and b in set(ids)}
    lines = surface.intersection_segments(df.where("fid % 2 = 1 and fid < 300"), 1.0)
    assert {(r.a, r.b) for r in lines.collect()} == {(a, b) for a, b in got if a % 2 and b % 2 and b < 300}


def test_rays_and_points_over_blocks(spark):
    rng = np.random.default_rng(12)
    t = rng.random((1500, 1, 3)) * 20 + rng.normal(0, 0.4, (1500, 3, 3))
    o, d = rng.random((1100, 3)) * 20, rng.normal(0, 1, (1100, 3))
    df = triangles(spark, t)
    rays = spark.createDataFrame([(i, *map(float, (*o[i], *d[i]))) for i in range(1100)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.rid: (r.n_hits, r.fid) for r in surface.ray_hits(rays, df, 0.25).collect()}
    points = rays.select(F.col("rid").alias("pid"), *(F.col("o" + k).alias(k) for k in "xyz"))
    near = {r.pid: (r.fid, r.d) for r in shapes.nearest_triangle(points, df, 0.2).collect()}
    assert len(got) == len(near) == 1100
    for i in range(0, 1100, 9):
        way = triangle_pairs.ray_parameters(np.repeat(o[i : i + 1], 1500, 0), np.repeat(d[i : i + 1], 1500, 0), t)
        n = int((~np.isnan(way)).sum())
        assert got[i] == (n, int(np.nanargmin(way)) if n else None)
        far = triangle_pairs.distances(np.repeat(o[i : i + 1], 1500, 0), t)
        assert near[i] == (int(far.argmin()), far.min())


@pytest.mark.parametrize("kind", ["stl", "vtk"])
def test_one_mesh_in_many_files(spark, tmp_path, kind):
    n = 12
    v = spark.range(n * n).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("vid"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), (F.col("id") * 0.37).alias("z"))
    faces = [(0, i, [a, a + 1, a + n + 1]) for i, a in enumerate(x for x in range(n * n - n) if x % n < n - 1)]
    f = spark.createDataFrame(faces, "mesh_id long, fid long, vids array<long>")
    sinks.write_mesh(v, f, str(tmp_path / kind), kind, True)
    assert len(list((tmp_path / kind).glob("*/*.txt"))) > 1
    got_v, got_f = text_meshes.read_mesh(spark, str(tmp_path / kind) + "/*/*.txt", kind, True)
    assert "binaryFile" not in plan(got_v) + plan(got_f)
    at = {r.vid: (r.x, r.y, r.z) for r in got_v.collect()}
    assert sorted(at) == list(range(len(at)))
    place = lambda a: (float(a % n), float(a // n), a * 0.37)
    assert {r.fid: [at[k] for k in r.vids] for r in got_f.collect()} == {i: [place(k) for k in vids] for _, i, vids in faces}
    order = [k for _, _, vids in faces for k in vids] if kind == "stl" else range(n * n)
    assert [at[k] for k in range(len(at))] == [place(k) for k in dict.fromkeys(order)]


def test_segments_of_given_pairs(spark):
    rng = np.random.default_rng(13)
    df = triangles(spark, rng.normal(0, 1, (40, 3, 3)))
    lines = {tuple(r) for r in surface.intersection_segments(df, 1.0).collect()}
    corners = [p + k for p in "abc" for k in "xyz"]
    one, two = (df.select(F.col("fid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in corners)) for s in "ab")
    pairs = one.join(two, (F.col("a") < F.col("b")) & (F.col("b") % 3 == 0))
    got = [tuple(r) for r in surface.segments_of_pairs(pairs).collect()]
    assert len(got) == len(set(got)) > 20 and set(got) == {r for r in lines if r[1] % 3 == 0}


def test_discs_in_steps(spark, monkeypatch):
    """The result is that of taking points one by one in the order of their hash, however few a step decides."""
    rng = np.random.default_rng(14)
    at = rng.normal(0, 1, (400, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "pid long, x double, y double, z double")
    monkeypatch.setattr(sampling, "FIRST", 40)
    got = {r.pid for r in sampling.poisson_disc(points, 0.9).collect()}
    order = [r.pid for r in points.orderBy(sampling.unit_hash(F.col("pid")), "pid").collect()]
    plain = []
    for i in order:
        if all(((at[i] - at[j]) ** 2).sum() > 0.81 for j in plain):
            plain.append(i)
    assert got == set(plain)


def test_exploded_points_are_not_sent_to_the_driver(spark):
    few = spark.range(2).select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("pid"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"))
    assert "SortMergeJoin" in plan(joins.radius_join(few, few, 0.1))


def test_pairs_of_segments_and_boxes_come_once(spark):
    """Without a distinct over all pairs; boxes that one sample of segments misses are met by another."""
    rng = np.random.default_rng(15)
    low = rng.random((70, 2)) * 60 - 30
    high = low + rng.random((70, 2)) * 25
    ends = rng.integers(-40, 40, (500, 4)).astype(float)
    ends[::5, 2] = ends[::5, 0]
    ends[::7, 3] = ends[::7, 1]
    boxes = spark.createDataFrame([(i, *map(float, (low[i, 0], high[i, 0], low[i, 1], high[i, 1]))) for i in range(70)], "bid long, lox double, hix double, loy double, hiy double")
    lines = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "sid long, ax double, ay double, bx double, by_ double")
    plain = set()
    for b in range(70):
        for i, (ax, ay, bx, by) in enumerate(ends):
            over = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (low[b, 0], high[b, 0]) for y in (low[b, 1], high[b, 1])]
            if max(ax, bx) >= low[b, 0] and min(ax, bx) <= high[b, 0] and max(ay, by) >= low[b, 1] and min(ay, by) <= high[b, 1] and min(over) <= 0 <= max(over):
                plain.add((b, i))
    found = segments.segments_in_boxes(boxes, lines, 4.0)
    assert "HashAggregate(keys=[bid" not in plan(found)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain
    few = lines.where("sid % 50 = 0")
    assert sorted(r.bid for r in segments.boxes_hit(boxes, few, 4.0, 256).collect()) == sorted({b for b, i in plain if i % 50 == 0})


def test_lines_see_few_columns(spark, monkeypatch):
    """One high column far off lets no line go on to columns that cannot count."""
    rng = np.random.default_rng(16)
    at = np.concatenate([rng.random((700, 3)) * (12, 12, 0.5), [(11.9, 11.9, 1.0)]])
    df = spark.createDataFrame([tuple(map(float, p)) for p in at], "x double, y double, weight double")
    seen, front = [], columns._front
    monkeypatch.setattr(columns, "_front", lambda near, by: (seen.append(near.count()), front(near, by))[1])
    got = {(r.ix, r.iy, r.iz): r.value for r in columns.support_field(spark, df, (0.0,) * 3, (12.0,) * 3, 1.0, 0.4).collect()}
    assert sum(seen) < 169 * 120
    base = 0.3 * 12
    for node in np.ndindex(13, 13, 13):
        off = np.maximum(np.maximum(base - node[2], node[2] - base - at[:, 2] * (12 - base)), 0)
        plain = np.sqrt((at[:, 0] - node[0]) ** 2 + (at[:, 1] - node[1]) ** 2 + off**2).min() - 0.025 * 12
        assert abs(got[node] - plain) < 1e-9


def test_long_segments_are_not_cut_into_cells(spark, monkeypatch):
    rng = np.random.default_rng(17)
    ends, at = rng.normal(0, 50, (900, 4)), np.concatenate([rng.normal(0, 10, (200, 2)), [(900.0, -700.0)]])
    ends[5, 2:] = ends[5, :2]
    lines = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "sid long, ax double, ay double, bx double, by_ double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "pid long, x double, y double")
    monkeypatch.setattr(segments, "passed_cells", None)
    got = {r.pid: (r.sid, r.d) for r in segments.nearest_segment(points, lines, 4.0).collect()}
    a, d = ends[:, :2], ends[:, 2:] - ends[:, :2]
    assert sorted(got) == list(range(201))
    for i, p in enumerate(at):
        size = (d * d).sum(axis=1)
        t = np.clip(((p - a) * d).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
        far = np.hypot(*(p - a - t[:, None] * d).T)
        assert got[i][0] == far.argmin() and abs(got[i][1] - far.min()) < 1e-9
    assert segments.nearest_segment(points, lines.limit(0), 4.0).count() == 0
