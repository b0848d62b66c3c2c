"""Queries of principal curvatures and what derives from them. The twins share no step with the operators: they sum over
half edges and solve the same cubic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curvature, mesh
from ..operators.lineage import cut
from . import bindings as B
from .mesh_queries import _CORNERS, _UNIT, W
from .registry import query
from .shape_queries import _voronoi_parts
from .surface_queries import _COT


def r5(x):
    return F.round(x, 5) + F.lit(0.0)


def sql5(x: str) -> str:
    return f"round({x}, 5) + 0.0"


_SIX = [(i, j) for i in range(3) for j in range(i, 3)]
_SPOKES = "sp AS (SELECT e0 AS vid, e1 AS o, n_faces FROM edges UNION ALL SELECT e1, e0, n_faces FROM edges)"
_RIM = "rim AS (SELECT DISTINCT vid FROM sp WHERE n_faces = 1)"
_AREAS = f"ar AS (SELECT vid, sum(area) AS area FROM ({_voronoi_parts()}) GROUP BY vid)"
_NEAR = "cwo AS (SELECT e0 AS vid, e1 AS o, w FROM cw UNION ALL SELECT e1, e0, w FROM cw)"


def _tensor_sql(rings: int) -> str:
    """Ends with the table k0 (vid, kmin, kmax)."""
    xyz = "xyz"
    bends = (
        "hn AS (SELECT s, e, nx, ny, nz FROM half JOIN nrm USING (fid)), "
        "pr AS (SELECT a.s, a.e, a.nx AS lx, a.ny AS ly, a.nz AS lz, b.nx AS rx, b.ny AS ry, b.nz AS rz, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM hn a JOIN hn b ON a.s = b.e AND a.e = b.s JOIN verts p ON p.vid = a.s JOIN verts q ON q.vid = a.e), "
        "pl AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM pr), "
        "pb AS (SELECT s, e, len, dx / len AS ux, dy / len AS uy, dz / len AS uz, atan2((ly*rz - lz*ry) * dx / len + (lz*rx - lx*rz) * dy / len + (lx*ry - ly*rx) * dz / len, lx*rx + ly*ry + lz*rz) AS beta FROM pl)"
    )
    one = "t1 AS (SELECT s AS vid, " + ", ".join(f"sum(beta * len / 2 * u{xyz[i]} * u{xyz[j]}) AS t{i}{j}" for i, j in _SIX) + " FROM pb GROUP BY s)"
    own = "ta AS (SELECT ar.vid, area, " + ", ".join(f"coalesce(t{i}{j}, 0) AS t{i}{j}" for i, j in _SIX) + " FROM ar LEFT JOIN t1 USING (vid))"
    sums = ", ".join(f"sum(t{i}{j}) AS t{i}{j}" for i, j in _SIX)
    whole = f"tw AS (SELECT vid, sum(area) AS area, {sums} FROM (SELECT * FROM ta UNION ALL SELECT sp.vid, {', '.join(['area', *(f't{i}{j}' for i, j in _SIX)])} FROM sp JOIN ta ON ta.vid = sp.o) GROUP BY vid)" if rings == 2 else "tw AS (SELECT * FROM ta)"
    m = "tm AS (SELECT vid, " + ", ".join(f"t{i}{j} / area AS m{i}{j}" for i, j in _SIX) + ", (t00 + t11 + t22) / area / 3 AS q FROM tw)"
    p = "tp AS (SELECT *, sqrt((pow(m00-q, 2) + pow(m11-q, 2) + pow(m22-q, 2) + 2 * (m01*m01 + m02*m02 + m12*m12)) / 6) AS p, (m00-q) * ((m11-q) * (m22-q) - m12*m12) - m01 * (m01 * (m22-q) - m12*m02) + m02 * (m01*m12 - (m11-q)*m02) AS det FROM tm)"
    e = "te AS (SELECT vid, q, p, CASE WHEN p = 0 THEN acos(0) / 3 ELSE acos(greatest(-1.0, least(1.0, det / (2*p*p*p)))) / 3 END AS f FROM tp)"
    v = "tv AS (SELECT vid, [q + 2*p*cos(f), 3*q - (q + 2*p*cos(f)) - (q + 2*p*cos(f + 2*pi()/3)), q + 2*p*cos(f + 2*pi()/3)] AS v FROM te)"
    # the place of the smallest size; of equal ones the last
    at = "tz AS (SELECT vid, v, CASE WHEN abs(v[1]) < abs(v[2]) AND abs(v[1]) < abs(v[3]) THEN 1 WHEN abs(v[2]) <= abs(v[1]) AND abs(v[2]) < abs(v[3]) THEN 2 ELSE 3 END AS n FROM tv)"
    k = "k0 AS (SELECT vid, CASE WHEN n = 3 THEN v[2] ELSE v[3] END AS kmin, CASE WHEN n = 1 THEN v[2] ELSE v[1] END AS kmax FROM tz)"
    return ", ".join([_SPOKES, _AREAS, bends, one, own, whole, m, p, e, v, at, k])


_SMOOTH = f"{_COT}, {_NEAR}, k1 AS (SELECT vid, coalesce(a, kmin) AS kmin, coalesce(b, kmax) AS kmax FROM k0 LEFT JOIN (SELECT c.vid, CASE WHEN sum(greatest(w, 0)) > 0 THEN sum(greatest(w, 0) * kmin) / sum(greatest(w, 0)) END AS a, CASE WHEN sum(greatest(w, 0)) > 0 THEN sum(greatest(w, 0) * kmax) / sum(greatest(w, 0)) END AS b FROM cwo c JOIN k0 ON k0.vid = c.o GROUP BY c.vid) USING (vid))"
_K1 = f"{W}, {_UNIT}, {_tensor_sql(1)}, {_SMOOTH}"
_SADDLE = "((kmin < 0 AND kmax > 0) OR (kmin > 0 AND kmax < 0))"
_LENGTHS = "ln AS (SELECT sp.vid, o, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) AS len FROM sp JOIN verts a ON a.vid = sp.vid JOIN verts b ON b.vid = o)"


def _mesh(spark, sf_dir):
    v, f = B.heightfield(spark, sf_dir)
    return cut(v), cut(f)


def _smoothed(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return v, f, cut(curvature.smoothed(curvature.tensor(f, v), f, v))


def _rounded(df):
    return df.select("vid", r5(F.col("kmin")).alias("kmin"), r5(F.col("kmax")).alias("kmax"))


@query("curvature_tensor", f"{W}, {_UNIT}, {_tensor_sql(1)} SELECT vid, {sql5('kmin')} AS kmin, {sql5('kmax')} AS kmax FROM k0")
def curvature_tensor(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(curvature.tensor(f, v))


@query("curvature_tensor_two_rings", f"{W}, {_UNIT}, {_tensor_sql(2)} SELECT vid, {sql5('kmin')} AS kmin, {sql5('kmax')} AS kmax FROM k0")
def curvature_tensor_two_rings(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(curvature.tensor(f, v, rings=2))


@query("smoothed_curvatures", f"{_K1} SELECT vid, {sql5('kmin')} AS kmin, {sql5('kmax')} AS kmax FROM k1")
def smoothed_curvatures(spark, sf_dir):
    return _rounded(_smoothed(spark, sf_dir)[2])


@query(
    "principal_curvatures",
    f"{W}, {_UNIT}, {_CORNERS}, {_SPOKES}, {_RIM}, {_AREAS}, {_COT}, {_NEAR}, "
    "lp AS (SELECT c.vid, sum(w * (q.x - p.x)) AS lx, sum(w * (q.y - p.y)) AS ly, sum(w * (q.z - p.z)) AS lz FROM cwo c JOIN verts p ON p.vid = c.vid JOIN verts q ON q.vid = c.o GROUP BY c.vid), "
    "tn AS (SELECT vid, sum(w) AS turn FROM crn GROUP BY vid), "
    "mg AS (SELECT vid, sqrt(lx*lx + ly*ly + lz*lz) / (4 * area) AS mean, (2 * pi() - turn) / area AS gauss FROM lp JOIN tn USING (vid) JOIN ar USING (vid) WHERE vid NOT IN (SELECT vid FROM rim)), "
    "ki AS (SELECT vid, mean - sqrt(greatest(0, mean*mean - gauss)) AS kmin, mean + sqrt(greatest(0, mean*mean - gauss)) AS kmax FROM mg), "
    "kb AS (SELECT c.vid, sum(w * kmin) / sum(w) AS kmin, sum(w * kmax) / sum(w) AS kmax FROM cwo c JOIN ki ON ki.vid = c.o WHERE c.vid IN (SELECT vid FROM rim) GROUP BY c.vid) "
    f"SELECT vid, {sql5('coalesce(kmin, 0)')} AS kmin, {sql5('coalesce(kmax, 0)')} AS kmax FROM verts LEFT JOIN (SELECT * FROM ki UNION ALL SELECT * FROM kb) USING (vid)",
)
def principal_curvatures(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(curvature.analyze(f, v))


@query("imbalanced_curvature_edges", f"{_K1}, ft AS (SELECT vid FROM k1 WHERE NOT {_SADDLE} AND abs(kmax) > 4 * abs(kmin)) SELECT e0, e1 FROM edges WHERE n_faces > 1 AND (e0 IN (SELECT vid FROM ft) OR e1 IN (SELECT vid FROM ft))")
def imbalanced_curvature_edges(spark, sf_dir):
    """Inner edges at vertices that bend over four times as much one way as the other."""
    _, f, k = _smoothed(spark, sf_dir)
    return curvature.feature_edges(curvature.imbalanced(k, 4.0), f).select("e0", "e1")


@query("high_curvature_vertices", f"{_K1}, {_LENGTHS}, vl AS (SELECT vid, count(*) AS valence, avg(len) AS len FROM ln GROUP BY vid) SELECT vid FROM k1 JOIN vl USING (vid) WHERE valence < 7 AND NOT ({_SADDLE} AND abs(kmax) < 2 * abs(kmin)) AND (kmin + kmax) * 2 * len < 0.5")
def high_curvature_vertices(spark, sf_dir):
    v, f, k = _smoothed(spark, sf_dir)
    return curvature.highly_curved(k, f, v, 0.5, 2.0).select("vid")


@query("convex_dominant_saddles", f"{_K1} SELECT vid, CASE WHEN {_SADDLE} AND abs(kmax) < 2 * abs(kmin) THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS value FROM k1")
def convex_dominant_saddles(spark, sf_dir):
    _, _, k = _smoothed(spark, sf_dir)
    return k.select("vid", F.when(curvature.convex_dominant_saddle(2.0), 1.0).otherwise(-1.0).alias("value"))


def _levels() -> str:
    level = lambda s: f"sum(exp(-len*len / (2 * pow({s} * width, 2))) * k) / sum(exp(-len*len / (2 * pow({s} * width, 2))))"
    return " + ".join(f"abs({level(s)} - {level(2 * s)})" for s in curvature.SCALES)


@query("mesh_saliency", f"{_K1}, {_LENGTHS}, wd AS (SELECT avg(len) AS width FROM ln), sl AS (SELECT ln.vid, {_levels()} AS s FROM ln JOIN (SELECT vid, (kmin + kmax) / 2 AS k FROM k1) c ON c.vid = ln.o, wd GROUP BY ln.vid) SELECT vid, {sql5('pow(coalesce(s, 0) / (SELECT max(s) FROM sl), 2)')} AS saliency FROM verts LEFT JOIN sl USING (vid)")
def mesh_saliency(spark, sf_dir):
    v, f, k = _smoothed(spark, sf_dir)
    return curvature.saliency(k, f, v, normalized=True).select("vid", r5(F.col("saliency")).alias("saliency"))
