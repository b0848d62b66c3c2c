"""Windows over curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, flows
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6

C = f"WITH c AS ({B.CURVES})"
N = f"{C}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c WINDOW w AS (PARTITION BY curve_id ORDER BY seq))"


def _near(spark, sf_dir):
    return B.curves(spark, sf_dir)


@query("arc_lengths", f"{N}, s AS (SELECT *, coalesce(sqrt(pow(x-px, 2) + pow(y-py, 2)), 0) AS step FROM n) SELECT curve_id, seq, {sql6('step')} AS step, round(sum(step) OVER (PARTITION BY curve_id ORDER BY seq), 4) AS arc FROM s")
def arc_lengths(spark, sf_dir):
    return curves.arc_lengths(_near(spark, sf_dir)).select("curve_id", "seq", r6(F.col("step")).alias("step"), F.round("arc", 4).alias("arc"))


@query("signed_areas", f"{N}, f AS (SELECT curve_id, first(x ORDER BY seq) AS fx, first(y ORDER BY seq) AS fy FROM c GROUP BY curve_id) SELECT curve_id, round(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2, 4) AS area FROM n JOIN f USING (curve_id) GROUP BY curve_id")
def signed_areas(spark, sf_dir):
    return curves.signed_areas(_near(spark, sf_dir)).select("curve_id", F.round("area", 4).alias("area"))


_TURN = "((x-px)*(ny-py) - (y-py)*(nx-px))"


@query("curve_curvature", f"{N} SELECT curve_id, seq, {sql6(f'CASE WHEN px IS NULL OR nx IS NULL THEN NULL WHEN {_TURN} = 0 THEN 0 ELSE sign({_TURN}) * 2 * abs({_TURN}) / (sqrt(pow(x-px,2)+pow(y-py,2)) * sqrt(pow(nx-x,2)+pow(ny-y,2)) * sqrt(pow(nx-px,2)+pow(ny-py,2))) END')} AS curvature FROM n")
def curve_curvature(spark, sf_dir):
    return curves.curvatures(_near(spark, sf_dir)).select("curve_id", "seq", r6(F.col("curvature")).alias("curvature"))


_L0, _L1 = "sqrt(pow(x-px,2)+pow(y-py,2))", "sqrt(pow(nx-x,2)+pow(ny-y,2))"


@query("curve_laplacian", f"{N} SELECT curve_id, seq, " + ", ".join(f"round(CASE WHEN px IS NULL OR nx IS NULL OR {_L0} = 0 OR {_L1} = 0 THEN 0 ELSE (2 / ({_L0} + {_L1})) * ((n{k} - {k}) / {_L1} - ({k} - p{k}) / {_L0}) END, 5) + 0.0 AS l{k}" for k in "xy") + " FROM n")
def curve_laplacian(spark, sf_dir):
    return curves.laplacians(_near(spark, sf_dir)).select("curve_id", "seq", *((F.round("l" + k, 5) + 0.0).alias("l" + k) for k in "xy"))


@query("smoothed_curves", f"{N} SELECT curve_id, seq, " + ", ".join(f"{sql6(f'CASE WHEN px IS NULL OR nx IS NULL THEN {k} ELSE {k} + 0.5 * ((p{k} + n{k}) / 2 - {k}) END')} AS {k}" for k in "xy") + " FROM n")
def smoothed_curves(spark, sf_dir):
    return curves.smoothed(_near(spark, sf_dir)).select("curve_id", "seq", *(r6(F.col(k)).alias(k) for k in "xy"))


_SEG = f"WITH c AS ({B.PORTRAITS}), n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c WINDOW w AS (PARTITION BY curve_id ORDER BY seq)), s AS (SELECT * FROM n WHERE nx IS NOT NULL)"


def _lf(a: str, b: str, p: str) -> str:
    return f"(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"


_A, _B, _C, _D = ("a.x", "a.y"), ("a.nx", "a.ny"), ("b.x", "b.y"), ("b.nx", "b.ny")


@query("self_crossings", f"{_SEG} SELECT a.curve_id, a.seq AS a, b.seq AS b FROM s a JOIN s b ON a.curve_id = b.curve_id AND b.seq > a.seq + 1 WHERE {_lf(_A, _B, _C)} * {_lf(_A, _B, _D)} < 0 AND {_lf(_C, _D, _A)} * {_lf(_C, _D, _B)} < 0")
def self_crossings(spark, sf_dir):
    return curves.self_crossings(B.portraits(spark, sf_dir), 50.0)


@query("resampled_curves", f"{N}, a AS (SELECT *, sum(coalesce(sqrt(pow(x-px, 2) + pow(y-py, 2)), 0)) OVER (PARTITION BY curve_id ORDER BY seq) AS arc FROM n), g AS (SELECT *, lead(arc) OVER (PARTITION BY curve_id ORDER BY seq) AS arc1 FROM a) SELECT curve_id, k, round(x + (k * 100.0 - arc) / (arc1 - arc) * (nx - x), 4) AS x, round(y + (k * 100.0 - arc) / (arc1 - arc) * (ny - y), 4) AS y FROM (SELECT *, unnest(range(CAST(ceil(arc / 100) AS BIGINT), CAST(ceil(arc1 / 100) AS BIGINT))) AS k FROM g WHERE arc1 > arc)")
def resampled_curves(spark, sf_dir):
    return curves.resampled(_near(spark, sf_dir), 100.0).select("curve_id", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))




@query("points_in_polygon", f"""WITH p AS ({B.CLOUD}), v AS (SELECT * FROM (VALUES (0.0, -2.0, 2.0, 0.0), (2.0, 0.0, 0.5, 0.4), (0.5, 0.4, 0.0, 2.0), (0.0, 2.0, -1.5, 0.1), (-1.5, 0.1, 0.0, -2.0)) t(ax, ay, bx, by))
SELECT pid, (SELECT count(*) FROM v WHERE (ay > y) <> (by > y) AND x < (bx - ax) * (y - ay) / (by - ay) + ax) % 2 = 1 AS inside FROM p""")
def points_in_polygon(spark, sf_dir):
    pen = spark.createDataFrame([(i, *p) for i, p in enumerate([(0.0, -2.0), (2.0, 0.0), (0.5, 0.4), (0.0, 2.0), (-1.5, 0.1)])], "seq long, x double, y double")
    return curves.points_inside(B.cloud(spark, sf_dir).select("pid", "x", "y"), pen).select("pid", "inside")


def _flow(source: str, to: str) -> str:
    near = f"n_{to} AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {source} WINDOW w AS (PARTITION BY curve_id ORDER BY seq))"
    move = lambda k: f"{k} + CASE WHEN px IS NULL OR nx IS NULL OR {_L0} = 0 OR {_L1} = 0 THEN 0 ELSE 0.001 * (2 / ({_L0} + {_L1})) * ((n{k} - {k}) / {_L1} - ({k} - p{k}) / {_L0}) END AS {k}"
    return f"{near}, {to} AS (SELECT curve_id, seq, {move('x')}, {move('y')} FROM n_{to})"


@query("curve_flow", f"WITH c AS ({B.CURVES}), {_flow('c', 's1')}, {_flow('s1', 's2')} SELECT curve_id, seq, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM s2")
def curve_flow(spark, sf_dir):
    out = flows.shrink(_near(spark, sf_dir), 0.001, 2, closed=False)
    return out.select("curve_id", "seq", *((F.round(k, 4) + 0.0).alias(k) for k in "xy"))
