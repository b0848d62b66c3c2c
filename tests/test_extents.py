"""Farthest pairs, support columns, segments of the plane and polygon fields against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.operators import columns, fixpoint, pairs, segments

from .test_tiles import plain_sweep

POINT = "cloud_id long, pid long, x double, y double, z double"


def plain_farthest(rows):
    best = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        for i, p in enumerate(own):
            for q in own[i + 1 :]:
                key = (-math.dist(p[2:], q[2:]), min(p[1], q[1]), max(p[1], q[1]))
                best[c] = min(best.get(c, key), key)
    return {c: (a, b, -d) for c, (d, a, b) in best.items()}


def clouds():
    rng = np.random.default_rng(3)
    rows = [(1, i, *map(float, rng.normal(size=3))) for i in range(300)]
    rows += [(2, 1000 + i, *map(float, v / np.linalg.norm(v))) for i, v in enumerate(rng.normal(size=(400, 3)))]  # no point is inner
    rows += [(3, 2000 + i, 0.5, 0.5, 0.5) for i in range(30)]  # one place
    rows += [(4, 3000 + i, float(i % 2), 0.0, 0.0) for i in range(200)]  # two places, many ties
    rows += [(5, 4000, 1.0, 2.0, 3.0)]  # a single row
    rows += [(6, 5000 + i, float(i % 3), float(i // 3 % 3), float(i // 9)) for i in range(27)]  # equal diagonals
    rows += [(7, 6000, 0.0, 0.0, 0.0), (7, 6001, 1e9, 0.0, 0.0), (7, 6002, 1e9, 1e-3, 0.0)]  # an outlier
    return rows


@pytest.mark.parametrize("enough", [100_000, 10])
def test_farthest_pairs(spark, monkeypatch, enough):
    rows = clouds()
    whole = pairs.narrowed
    monkeypatch.setattr(pairs, "narrowed", lambda *a: whole(*a, enough=enough))
    more = [(1, 1, None, 9.0, 9.0), (1, 2, float("nan"), 99.0, 99.0), (8, 3, None, None, None)]
    points = spark.createDataFrame(rows, POINT).unionByName(spark.createDataFrame(more, POINT)).withColumn("n", F.lit("extra")).withColumn("d", F.lit(0))
    got = {r.cloud_id: (r.pid, r.other, r.d) for r in pairs.farthest_pairs(points, "cloud_id").collect()}
    expected = plain_farthest(rows)
    expected[3] = (2000, 2029, 0.0)
    assert set(got) == set(expected) == {1, 2, 3, 4, 6, 7}
    for c, (a, b, d) in expected.items():
        assert got[c][:2] == (a, b) and abs(got[c][2] - d) < 1e-9


def test_few_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, *map(float, p)) for i, p in enumerate(rng.normal(size=(20_000, 3)))]
    _, kept, met = pairs.narrowed(spark.createDataFrame(rows, POINT), "cloud_id", enough=1000)
    assert kept.count() < 500 and met.count() < 2000  # of 200 million pairs


def test_farthest_of_all_and_of_none(spark):
    rows = clouds()
    p = spark.createDataFrame(rows, POINT)
    (got,) = pairs.farthest_pairs(p).collect()
    assert abs(got.d - plain_farthest([(0, *r[1:]) for r in rows])[0][2]) < 1e-6
    assert pairs.farthest_pairs(p.limit(0), "cloud_id").count() == 0
    assert pairs.farthest_pairs(p.limit(0)).count() == 0


def plain_support(rows, low, high, cell, level):
    sides = [b - a for a, b in zip(low, high)]
    r, base = 0.025 * max(sides[:2]), low[2] + (level - 0.1) * sides[2]
    kept = [(x, y, w * (high[2] - base)) for x, y, w in rows if None not in (x, y, w) and low[0] <= x <= high[0] and low[1] <= y <= high[1] and 0 <= w <= 1]
    out = {}
    for i in np.ndindex(*(math.floor(s / cell + 1e-9) + 1 for s in sides)):
        px, py, pz = (a + k * cell for a, k in zip(low, i))
        out[i] = min((math.dist((px, py, max(base - pz, pz - base - h, 0)), (x, y, 0)) - r for x, y, h in kept), default=columns.NONE)
    return out


@pytest.mark.parametrize("count,level", [(60, 0.4), (3, 0.0), (0, 1.0)])
def test_support_field(spark, count, level):
    rnd = random.Random(count)
    low, high = (-1.0, 2.0, 0.5), (5.0, 6.5, 4.0)
    rows = [(rnd.uniform(-1.5, 5.5), rnd.uniform(1.5, 7), rnd.uniform(-0.1, 1.1)) for _ in range(count)]
    rows += rows[:2] + [(None, 3.0, 0.5), (0.0, 3.0, None), (100.0, 3.0, 0.5), (0.0, 3.0, 1.5)]
    df = spark.createDataFrame(rows, "x double, y double, weight double").withColumn("pid", F.lit("extra"))
    got = {(r.ix, r.iy, r.iz): r.value for r in columns.support_field(spark, df, low, high, 0.5, level, reach=1).collect()}
    expected = plain_support(rows, low, high, 0.5, level)
    assert set(got) == set(expected) and all(abs(got[i] - v) < 1e-9 for i, v in expected.items())


def test_support_field_arguments(spark):
    df = spark.createDataFrame([], "x double, y double, weight double")
    with pytest.raises(ValueError):
        columns.support_field(spark, df, (0, 0, 0), (1, 1, 0.1), 0.5, 0.5)
    with pytest.raises(ValueError):
        columns.support_field(spark, df, (0, 0, 0), (1, 1, 1), 0.5, 1.5)


SEGMENT = "sid long, ax double, ay double, bx double, by_ double"


def plain_foot(p, s):
    a, b = np.array(s[1:3]), np.array(s[3:5])
    n = float((b - a) @ (b - a))
    t = min(1.0, max(0.0, float((np.array(p) - a) @ (b - a)) / n)) if n else 0.0
    f = a + t * (b - a)
    return math.dist(p, f), s[0], *map(float, f)


@pytest.mark.parametrize("cell", [0.3, 5.0])
def test_nearest_segment(spark, cell):
    rnd = random.Random(2)
    lines = [(i, x, y, x + rnd.uniform(-3, 3), y + rnd.uniform(-3, 3)) for i in range(80) for x, y in [(rnd.uniform(-9, 9), rnd.uniform(-9, 9))]]
    lines += [(100, 1.0, 1.0, 1.0, 1.0), (101, -4.0, -8.0, -4.0, 8.0), (102, -8.0, 2.0, 8.0, 2.0), (103, -8.0, 2.0, 8.0, 2.0)]
    points = [(i, rnd.uniform(-12, 12), rnd.uniform(-12, 12)) for i in range(150)] + [(500, 0.0, 2.0), (501, -4.0, 2.0), (502, 90.0, 90.0)]
    s = spark.createDataFrame([*lines, (104, None, 1.0, 1.0, 1.0)], SEGMENT)
    p = spark.createDataFrame([*points, (503, None, 1.0)], "pid long, x double, y double").withColumn("d", F.lit("extra"))
    got = {r.pid: (r.d, r.sid, r.fx, r.fy) for r in segments.nearest_segment(p, s, cell).collect()}
    assert set(got) == {q[0] for q in points}
    for q in points:
        d, sid, fx, fy = min(plain_foot(q[1:], line) for line in lines)
        assert abs(got[q[0]][0] - d) < 1e-9 and got[q[0]][1] == sid and math.dist(got[q[0]][2:], (fx, fy)) < 1e-9
    assert segments.nearest_segment(p, s.limit(0), 1.0).count() == 0
    assert segments.nearest_segment(p.limit(0), s, 1.0).count() == 0


def test_long_segments_lie_in_few_cells(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 900.0), (2, 0.5, -500.0, 0.5, 500.0)], SEGMENT)
    n = {r.sid: r["count"] for r in segments.passed_cells(s, 1.0).groupBy("sid").count().collect()}
    assert n[1] < 2200 and n[2] < 1010


def clipped(box, s):
    """Whether a part of the segment is left after clipping to the box."""
    t0, t1 = 0.0, 1.0
    for a, b, low, high in ((s[1], s[3], box[1], box[2]), (s[2], s[4], box[3], box[4])):
        if a == b:
            if not low <= a <= high:
                return False
            continue
        u, v = sorted(((low - a) / (b - a), (high - a) / (b - a)))
        t0, t1 = max(t0, u), min(t1, v)
    return t0 <= t1


def test_segments_in_boxes(spark):
    rnd = random.Random(4)
    lines = [(i, x, y, x + rnd.uniform(-4, 4), y + rnd.uniform(-4, 4)) for i in range(60) for x, y in [(rnd.uniform(-9, 9), rnd.uniform(-9, 9))]]
    boxes = [(i, x, x + rnd.uniform(0, 3), y, y + rnd.uniform(0, 3)) for i in range(60) for x, y in [(rnd.uniform(-9, 9), rnd.uniform(-9, 9))]]
    s = spark.createDataFrame(lines, SEGMENT)
    b = spark.createDataFrame(boxes, "bid long, lox double, hix double, loy double, hiy double")
    expected = {(q[0], line[0]) for q in boxes for line in lines if clipped(q, line)}
    got = [tuple(r) for r in segments.segments_in_boxes(b, s, 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {r.bid for r in segments.boxes_hit(b, s, 2.0).collect()} == {q for q, _ in expected}
    assert segments.boxes_hit(b, s.limit(0), 2.0).count() == 0


def test_polygon_field_of_a_circle(spark):
    n = 400
    rows = [(c, i, c * 20 + 3 * math.cos(2 * math.pi * i / n), 3 * math.sin(2 * math.pi * i / n)) for c in (0, 1) for i in range(n)] + [(2, 0, 1.0, 1.0)]
    field = segments.polygon_field(spark.createDataFrame(rows, "curve_id long, seq long, x double, y double"), 0.5, 2).collect()
    for r in field:
        x, y = r.ix * 0.5, r.iy * 0.5
        want = math.dist((x, y), (1, 1)) if r.curve_id == 2 else math.dist((x, y), (r.curve_id * 20, 0)) - 3
        assert abs(r.value - want) < 1e-3
    assert {r.curve_id for r in field} == {0, 1, 2} and any(r.value < -2.9 for r in field)


def test_planar_eikonal(spark):
    rng = np.random.default_rng(8)
    present = [(int(x), int(y), 0) for x, y in np.ndindex(14, 11) if rng.random() > 0.2]
    fixed = {present[int(k)]: float(rng.random()) for k in rng.integers(0, len(present), 3)}
    grid = spark.createDataFrame([p[:2] for p in present], "ix long, iy long")
    frozen = spark.createDataFrame([(*p[:2], v) for p, v in fixed.items()], "ix long, iy long, value double")
    got = {(r.ix, r.iy, 0): r.value for r in fixpoint.eikonal(grid, frozen, 0.5).collect()}
    expected = plain_sweep(present, fixed, 0.5)
    assert set(got) == set(expected) and all(abs(got[p] - v) < 1e-6 for p, v in expected.items())
