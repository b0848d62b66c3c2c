"""Queries of noise, terrain, ring densities and discs within polygons."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from ..operators import density, hulls, joins, noise
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6


def _noise_sql(rows: str, x: str, y: str, z: str, seed: int) -> str:
    """The rows of a query with the column noise, eight corners in eight columns."""
    perm = lambda h: f"((({noise.FACTOR} * ({h}) + 1) * ({h})) % {noise.PERIOD})"
    wrap = lambda h: f"((({h}) % {noise.PERIOD} + {noise.PERIOD}) % {noise.PERIOD})"
    base = f"SELECT *, CAST(floor({x}) AS BIGINT) AS cx, CAST(floor({y}) AS BIGINT) AS cy, CAST(floor({z}) AS BIGINT) AS cz, {x} - floor({x}) AS fx, {y} - floor({y}) AS fy, {z} - floor({z}) AS fz FROM ({rows})"
    before = [("", str(seed % noise.PERIOD))]
    for k in "xyz":
        names = [(c + d, f"h{k}{c}{d}") for c, _ in before for d in "01"]
        base = "SELECT *, " + ", ".join(f"{wrap(f'{h} + c{k} + {d}')} AS r{k}{c}{d}" for c, h in before for d in "01") + f" FROM ({base})"
        base = "SELECT *, " + ", ".join(f"{perm(f'r{k}{c}')} AS {n}" for c, n in names) + f" FROM ({base})"
        before = names
    slopes = []
    for c, h in before:
        way = [f"(f{k} - {d})" for k, d in zip("xyz", c, strict=True)]
        g = f"({h} % 12)"
        p, q = f"(CASE WHEN {g} >= 8 THEN {way[1]} ELSE {way[0]} END)", f"(CASE WHEN {g} < 4 THEN {way[1]} ELSE {way[2]} END)"
        slopes.append(f"(CASE WHEN {g} % 2 = 1 THEN -{p} ELSE {p} END + CASE WHEN {g} % 4 >= 2 THEN -{q} ELSE {q} END) AS s{c}")
    base = f"SELECT *, {', '.join(slopes)}, " + ", ".join(f"f{k}*f{k}*f{k} * (f{k} * (f{k} * 6 - 15) + 10) AS w{k}" for k in "xyz") + f" FROM ({base})"
    weight = lambda c: " * ".join(f"w{k}" if d == "1" else f"(1 - w{k})" for k, d in zip("xyz", c, strict=True))
    return f"SELECT * EXCLUDE (wx, wy, wz), {' + '.join(f's{c} * {weight(c)}' for c in map(''.join, itertools.product('01', repeat=3)))} AS noise FROM ({base})"


_OCTAVES = 4


def _elevation_sql() -> str:
    rows = f"SELECT pid, line, x, y, CAST(0 AS DOUBLE) AS total FROM ({B.BIG_CLOUD})"
    for i in range(_OCTAVES):
        rows = f"SELECT pid, line, x, y, total + noise * {0.5**i} AS total FROM ({_noise_sql(rows, f'(x / 7.0 * {2.0**i})', f'(y / 7.0 * {2.0**i})', '0.0', 3)})"
    return f"SELECT pid, line, {sql6('100 + 400 * (total * 0.5 + 0.5)')} AS z FROM ({rows})"


@query("terrain_elevation", _elevation_sql())
def terrain_elevation(spark, sf_dir):
    """Heights of the terrain at every point of `lineitem`."""
    return noise.elevated(B.big_cloud(spark, sf_dir), 7.0, _OCTAVES, 0.5, 2.0, 100.0, 500.0, seed=3).select("pid", "line", r6(F.col("z")).alias("z"))


@query("gradient_noise", f"SELECT pid, {sql6('noise')} AS noise FROM ({_noise_sql(f'SELECT pid, x, y, z FROM ({B.CLOUD})', 'x', 'y', 'z', 0)})")
def gradient_noise(spark, sf_dir):
    """Noise in three dimensions at every point of the clouds."""
    return noise.gradient_noise(B.cloud(spark, sf_dir), "noise", *(F.col(k) for k in "xyz")).select("pid", r6(F.col("noise")).alias("noise"))


_K = 9
_WAYS = f"WITH p AS ({B.CLOUD}), nn AS (SELECT * FROM (SELECT a.cloud_id, a.pid, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, row_number() OVER (PARTITION BY a.cloud_id, a.pid ORDER BY sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)), b.pid) AS r FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND a.pid <> b.pid) WHERE r <= {_K})"
_RING_SQL = (
    f"{_WAYS}, f1 AS (SELECT cloud_id, pid, x AS ax, y AS ay, z AS az FROM nn WHERE r = 1), "
    "cr AS (SELECT cloud_id, pid, r, ay*z - az*y AS cx, az*x - ax*z AS cy, ax*y - ay*x AS cz FROM nn JOIN f1 USING (cloud_id, pid)), "
    f"pl AS (SELECT cloud_id, pid, arg_min({{'x': cx, 'y': cy, 'z': cz}}, r) AS n FROM cr WHERE sqrt(cx*cx + cy*cy + cz*cz) > {density.FLAT} GROUP BY 1, 2), "
    "nu AS (SELECT cloud_id, pid, n.x / l AS nx, n.y / l AS ny, n.z / l AS nz FROM (SELECT *, sqrt(n.x*n.x + n.y*n.y + n.z*n.z) AS l FROM pl)), "
    "t0 AS (SELECT *, ax*nx + ay*ny + az*nz AS h FROM nu JOIN f1 USING (cloud_id, pid)), "
    "tu AS (SELECT *, (ax - h*nx) / l AS tx, (ay - h*ny) / l AS ty, (az - h*nz) / l AS tz FROM (SELECT *, sqrt(pow(ax - h*nx, 2) + pow(ay - h*ny, 2) + pow(az - h*nz, 2)) AS l FROM t0)), "
    "an AS (SELECT cloud_id, pid, x, y, z, atan2((ny*tz - nz*ty)*x + (nz*tx - nx*tz)*y + (nx*ty - ny*tx)*z, tx*x + ty*y + tz*z) AS a FROM nn JOIN tu USING (cloud_id, pid)), "
    "nx_ AS (SELECT *, lead({'x': x, 'y': y, 'z': z}, 1) OVER w AS v, first({'x': x, 'y': y, 'z': z}) OVER w AS u FROM an WINDOW w AS (PARTITION BY cloud_id, pid ORDER BY a, x, y, z)), "
    "st AS (SELECT cloud_id, pid, x, y, z, coalesce(v, u) AS q FROM nx_), "
    "ra AS (SELECT cloud_id, pid, count(*) AS n, sum(sqrt(pow(y*q.z - z*q.y, 2) + pow(z*q.x - x*q.z, 2) + pow(x*q.y - y*q.x, 2)) / 2) AS area FROM st GROUP BY 1, 2), "
    f"dn AS (SELECT p.cloud_id, p.pid, coalesce(c, 0) AS c, CASE WHEN coalesce(n, 0) > 2 THEN area ELSE 0.0 END AS area FROM p LEFT JOIN (SELECT cloud_id, pid, count(*) AS c FROM nn GROUP BY 1, 2) USING (cloud_id, pid) LEFT JOIN ra USING (cloud_id, pid)) "
)


def _densities(spark, sf_dir):
    c = B.cloud(spark, sf_dir)
    return density.ring_densities(c, _K, joins.suggested_cell(c, 80), by=["cloud_id"])


@query("ring_densities", f"{_RING_SQL} SELECT cloud_id, pid, c AS n_found, {sql6('area')} AS area, {sql6(f'c / CASE WHEN area < {density.FLAT} THEN {density.NO_AREA} ELSE area END')} AS density FROM dn")
def ring_densities(spark, sf_dir):
    """The ring of the nine nearest of its cloud around every point."""
    return _densities(spark, sf_dir).select("cloud_id", "pid", F.col("n_found").cast("long").alias("n_found"), r6(F.col("area")).alias("area"), r6(F.col("density")).alias("density"))


@query("softmax_sample", f"{_RING_SQL}, d AS (SELECT pid, c / CASE WHEN area < {density.FLAT} THEN {density.NO_AREA} ELSE area END AS density FROM dn) SELECT pid FROM d ORDER BY ln(greatest(CAST(('0x' || md5(pid || ':7')[1:13]) AS BIGINT) / {float(1 << 52)}, 1e-300)) / (0.5 * greatest(1e-300, least(1e300, exp(2.0 * (density - (SELECT avg(density) FROM d)))))) DESC, pid LIMIT 50")
def softmax_sample(spark, sf_dir):
    """Fifty points, those of dense places likelier."""
    return density.softmax_sample(_densities(spark, sf_dir), 50, beta=2.0, gamma=0.5, seed=7).select("pid")


@query("discs_in_polygons")
def discs_in_polygons(spark, sf_dir):
    """Points spread over the planar hull of each cloud, nearer to each other the more points there are."""
    c = B.cloud(spark, sf_dir)
    n = max(1, c.count())
    found = density.discs_in_polygons(hulls.convex_hulls(c), joins.extent(c, axes="xy") / math.sqrt(n / 4), by="cloud_id")
    return found.select("cloud_id", "pid", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))
