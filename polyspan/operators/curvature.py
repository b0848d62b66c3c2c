"""Principal curvatures of triangle meshes (mesh_id, vid, kmin, kmax) and what derives from them: smoothing, feature
vertices and edges, saliency.

Everything is a grouping by vertex or edge, so one huge mesh is spread as well; the eigenvalues are expressions. Faces
must agree in orientation; an edge with one face, or with two that run through it alike, bends nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V
from . import mesh, shapes, surface
from .lineage import cut

_SIX = [(i, j) for i in range(3) for j in range(i, 3)]


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Edges (mesh_id, e0, e1) as (mesh_id, vid, to), once in each direction."""
    one = lambda a, b: edges.select("mesh_id", F.col(a).alias("vid"), F.col(b).alias("to"), *columns)
    return one("e0", "e1").unionByName(one("e1", "e0"))


def symmetric_eigenvalues(m: dict[tuple[int, int], Column]) -> tuple[Column, Column, Column]:
    """The eigenvalues of a symmetric 3 by 3 matrix, largest first, by the trigonometric solution of its cubic."""
    middle = (m[0, 0] + m[1, 1] + m[2, 2]) / 3
    d = [m[i, i] - middle for i in range(3)]
    off = m[0, 1] * m[0, 1] + m[0, 2] * m[0, 2] + m[1, 2] * m[1, 2]
    p = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6)
    det = d[0] * (d[1] * d[2] - m[1, 2] * m[1, 2]) - m[0, 1] * (m[0, 1] * d[2] - m[1, 2] * m[0, 2]) + m[0, 2] * (m[0, 1] * m[1, 2] - d[1] * m[0, 2])
    phi = F.acos(G.clamp(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0)), -1.0, 1.0)) / 3
    first, last = middle + 2 * p * F.cos(phi), middle + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return first, 3 * middle - first - last, last


def _bends(placed: DataFrame) -> DataFrame:
    """(mesh_id, e0, e1, t00 .. t22) of faces with corners: half of each inner edge times its signed angle and the square of
    its direction."""
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    at = placed.select("*", *(p.alias("n" + k) for k, p in zip("xyz", n, strict=True)))
    turns = []
    for k, (p, q) in enumerate(("ab", "bc", "ca")):
        s, e = F.col(f"v{k}"), F.col(f"v{(k + 1) % 3}")
        along = V.minus(V.vec(q), V.vec(p))
        turns.append(F.struct(F.least(s, e).alias("e0"), F.greatest(s, e).alias("e1"), (s < e).alias("up"), *(F.when(s < e, x).otherwise(-x).alias("d" + i) for i, x in zip("xyz", along, strict=True))))
    rows = at.select("mesh_id", "nx", "ny", "nz", F.explode(F.array(*turns)).alias("t")).select("mesh_id", "nx", "ny", "nz", "t.*")
    side = lambda up: [F.max(F.when(F.col("up") == up, F.col("n" + k))).alias(("l" if up else "r") + k) for k in "xyz"]
    held = rows.groupBy("mesh_id", "e0", "e1").agg(F.count("*").alias("n"), *side(True), *side(False), *(F.max("d" + k).alias("d" + k) for k in "xyz"))
    held = held.where(F.col("n") == 2).where("lx is not null and rx is not null")
    left, right, d = V.vec("l"), V.vec("r"), V.vec("d")
    unit = V.normalize(d)
    beta = F.atan2(V.dot(V.cross(left, right), unit), V.dot(left, right))
    return held.select("mesh_id", "e0", "e1", *((beta * V.norm(d) / 2 * unit[i] * unit[j]).alias(f"t{i}{j}") for i, j in _SIX))


def tensor(faces: DataFrame, vertices: DataFrame, rings: int = 1) -> DataFrame:
    """Curvatures from the tensor that the bends of the edges at a vertex (`rings` 2: and at its neighbours) add up to, over
    the Voronoi areas there. Of the eigenvalues that of the smallest size belongs to the normal. Vertices of no face have
    curvatures of zero, as have those without area."""
    if rings not in (1, 2):
        raise ValueError("rings is 1 or 2")
    parts, placed = [f"t{i}{j}" for i, j in _SIX], cut(mesh.placed(faces, vertices))
    bent = both_ways(_bends(placed), *parts).groupBy("mesh_id", "vid").agg(*(F.sum(p).alias(p) for p in parts))
    sums = shapes.voronoi_areas(placed).join(bent, ["mesh_id", "vid"], "left").select("mesh_id", "vid", "area", *(F.coalesce(p, F.lit(0.0)).alias(p) for p in parts))
    if rings == 2:
        near = both_ways(mesh.edges(faces)).join(sums, ["mesh_id", "vid"]).select("mesh_id", F.col("to").alias("vid"), "area", *parts)
        sums = sums.unionByName(near).groupBy("mesh_id", "vid").agg(*(F.sum(p).alias(p) for p in ("area", *parts)))
    m = {ij: F.coalesce(F.try_divide(p, "area"), F.lit(0.0)) for ij, p in zip(_SIX, parts, strict=True)}
    e = sums.select("mesh_id", "vid", *(x.alias(f"e{i}") for i, x in enumerate(symmetric_eigenvalues(m))))
    size = [F.abs(f"e{i}") for i in range(3)]
    first, middle = (size[0] < size[1]) & (size[0] < size[2]), (size[1] <= size[0]) & (size[1] < size[2])
    own = e.select("mesh_id", "vid", F.when(first | middle, F.col("e2")).otherwise(F.col("e1")).alias("kmin"), F.when(first, F.col("e1")).otherwise(F.col("e0")).alias("kmax"))
    return _for_all(vertices, own)


def _for_all(vertices: DataFrame, own: DataFrame) -> DataFrame:
    return vertices.select("mesh_id", "vid").join(own, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in ("kmin", "kmax")))


def analyze(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Curvatures of inner vertices from the cotangent Laplacian and the angle defect over the Voronoi area: mean -+
    sqrt(max(0, mean^2 - gauss)); at the border the mean of the inner neighbours, weighted by cotangents, else zero."""
    w = both_ways(surface.cotan_weights(faces, vertices), "w")
    at = vertices.select("mesh_id", "vid", *(F.col(k).alias("p" + k) for k in "xyz"))
    to = vertices.select("mesh_id", F.col("vid").alias("to"), *(F.col(k).alias("q" + k) for k in "xyz"))
    bent = w.join(at, ["mesh_id", "vid"]).join(to, ["mesh_id", "to"]).groupBy("mesh_id", "vid").agg(*(F.sum(F.col("w") * (F.col("q" + k) - F.col("p" + k))).alias("l" + k) for k in "xyz"))
    placed = cut(mesh.placed(faces, vertices))
    angles = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), x.alias("w")) for k, x in enumerate(G.corner_angles(V.vec("a"), V.vec("b"), V.vec("c")))])
    turned = placed.select("mesh_id", F.explode(angles).alias("c")).groupBy("mesh_id", "c.vid").agg(F.sum("c.w").alias("turn"))
    rim = mesh.boundary_vertices(faces)
    inner = shapes.voronoi_areas(placed).join(bent, ["mesh_id", "vid"]).join(turned, ["mesh_id", "vid"]).join(rim, ["mesh_id", "vid"], "left_anti")
    mean = F.coalesce(F.try_divide(V.norm(V.vec("l")), 4 * F.col("area")), F.lit(0.0))
    gauss = F.coalesce(F.try_divide(2 * math.pi - F.col("turn"), F.col("area")), F.lit(0.0))
    known = inner.select("mesh_id", "vid", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), mean * mean - gauss)).alias("s"))
    known = known.select("mesh_id", "vid", (F.col("mean") - F.col("s")).alias("kmin"), (F.col("mean") + F.col("s")).alias("kmax"))
    edge = w.join(rim, ["mesh_id", "vid"]).join(known.withColumnRenamed("vid", "to"), ["mesh_id", "to"])
    border = edge.groupBy("mesh_id", "vid").agg(*(F.try_divide(F.sum(F.col("w") * F.col(k)), F.sum("w")).alias(k) for k in ("kmin", "kmax")))
    return _for_all(vertices, known.unionByName(border))


def smoothed(curvatures: DataFrame, faces: DataFrame, vertices: DataFrame, steps: int = 1, features: DataFrame | None = None) -> DataFrame:
    """Curvatures replaced `steps` times by the neighbours' mean, weighted by cotangents (negative ones count as 0), all
    vertices at once. Feature vertices (mesh_id, vid) stay and are no neighbours."""
    w = both_ways(surface.cotan_weights(faces, vertices), "w").select("mesh_id", "vid", "to", F.greatest("w", F.lit(0.0)).alias("w"))
    if features is not None:
        for name in ("vid", "to"):
            w = w.join(features.select("mesh_id", F.col("vid").alias(name)), ["mesh_id", name], "left_anti")
    for _ in range(steps):
        sums = w.join(curvatures.withColumnRenamed("vid", "to"), ["mesh_id", "to"]).groupBy("mesh_id", "vid").agg(*(F.try_divide(F.sum(F.col("w") * F.col(k)), F.sum("w")).alias("_" + k) for k in ("kmin", "kmax")))
        curvatures = curvatures.join(sums, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.coalesce("_" + k, k).alias(k) for k in ("kmin", "kmax")))
    return curvatures


def is_saddle() -> Column:
    return ((F.col("kmin") < 0) & (F.col("kmax") > 0)) | ((F.col("kmin") > 0) & (F.col("kmax") < 0))


def convex_dominant_saddle(factor: float) -> Column:
    return is_saddle() & (F.abs("kmax") < factor * F.abs("kmin"))


def imbalanced(curvatures: DataFrame, factor: float) -> DataFrame:
    """(mesh_id, vid) that are no saddles and bend over `factor` times as much along kmax as along kmin."""
    return curvatures.where(~is_saddle() & (F.abs("kmax") > factor * F.abs("kmin"))).select("mesh_id", "vid")


def highly_curved(curvatures: DataFrame, faces: DataFrame, vertices: DataFrame, angle: float, factor: float) -> DataFrame:
    """(mesh_id, vid) with fewer than 7 neighbours, no convex-dominant saddles, whose kmin + kmax times twice the mean
    length of their edges stays below `angle`."""
    e = both_ways(mesh.edge_lengths(faces, vertices), "length").groupBy("mesh_id", "vid").agg(F.count("*").alias("valence"), F.avg("length").alias("length"))
    bend = (F.col("kmin") + F.col("kmax")) * 2 * F.col("length")
    return curvatures.join(e, ["mesh_id", "vid"]).where((F.col("valence") < 7) & ~convex_dominant_saddle(factor) & (bend < angle)).select("mesh_id", "vid")


def feature_edges(features: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, e0, e1): inner edges with a feature vertex (mesh_id, vid) at either end."""
    inner = mesh.edges(faces).where("n_faces > 1").select("mesh_id", "e0", "e1")
    ends = both_ways(inner).join(features, ["mesh_id", "vid"], "left_semi")
    return ends.select("mesh_id", F.least("vid", "to").alias("e0"), F.greatest("vid", "to").alias("e1")).distinct()


#: The widths, in mean edge lengths.
SCALES = (0.5, 1.0, 1.5, 2.0, 2.5)


def saliency(curvatures: DataFrame, faces: DataFrame, vertices: DataFrame, width: float | None = None, normalized: bool = False) -> DataFrame:
    """(mesh_id, vid, saliency): over five scales of `width` (by default the mesh's mean edge length) the differences between
    the neighbours' mean curvatures weighted by a Gaussian and by one twice as wide. One grouping sums all scales.
    Neighbours that are too far to weigh anything count as mean 0. `normalized` squares the share of the mesh's largest;
    vertices without neighbours have 0."""
    lengths = mesh.edge_lengths(faces, vertices)
    mean = lengths.groupBy("mesh_id").agg((F.avg("length") if width is None else F.lit(float(width))).alias("width"))
    near = both_ways(lengths, "length").join(curvatures.select("mesh_id", F.col("vid").alias("to"), ((F.col("kmin") + F.col("kmax")) / 2).alias("k")), ["mesh_id", "to"]).join(mean, "mesh_id")
    widths = sorted({s * f for s in SCALES for f in (1, 2)})
    weight = {s: F.exp(-F.col("length") * F.col("length") / (2 * F.pow(s * F.col("width"), F.lit(2.0)))) for s in widths}
    sums = near.groupBy("mesh_id", "vid").agg(*(x.alias(f"{n}{i}") for i, s in enumerate(widths) for n, x in (("k", F.sum(weight[s] * F.col("k"))), ("w", F.sum(weight[s])))))
    level = {s: F.coalesce(F.try_divide(f"k{i}", f"w{i}"), F.lit(0.0)) for i, s in enumerate(widths)}
    own = sums.select("mesh_id", "vid", sum((F.abs(level[s] - level[2 * s]) for s in SCALES), F.lit(0.0)).alias("saliency"))
    out = vertices.select("mesh_id", "vid").join(own, ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce("saliency", F.lit(0.0)).alias("saliency"))
    if not normalized:
        return out
    most = out.groupBy("mesh_id").agg(F.max("saliency").alias("most"))
    return out.join(most, "mesh_id").select("mesh_id", "vid", F.coalesce(F.pow(F.try_divide("saliency", "most"), F.lit(2.0)), F.lit(0.0)).alias("saliency"))
