"""Meshes as tables: vertices (mesh_id, vid, x, y, z) and triangle faces (mesh_id, fid, v0, v1, v2), counter-clockwise.

Topology is derived by exploding corners and grouping by vertex pairs; nothing walks halfedges. All shuffles are on
(mesh_id, vertex) or (mesh_id, edge), which spread within a mesh, so one huge mesh is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vector as V


def corners(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, k, vid, vid_next, vid_prev): a row for each corner of each face."""
    turn = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("vid"), F.col(f"v{(k + 1) % 3}").alias("vid_next"), F.col(f"v{(k + 2) % 3}").alias("vid_prev")) for k in range(3)])
    return faces.select("mesh_id", "fid", F.explode(turn).alias("c")).select("mesh_id", "fid", "c.*")


def fan(polygons: DataFrame) -> DataFrame:
    """Triangles of polygons (mesh_id, fid, vids): a fan around each first corner; fid_new counts within the polygon."""
    n = F.size("vids")
    parts = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.struct(k.alias("part"), F.col("vids")[0].alias("v0"), F.element_at("vids", k + 1).alias("v1"), F.element_at("vids", k + 2).alias("v2")))
    return polygons.where(n >= 3).select("mesh_id", "fid", F.explode(parts).alias("t")).select("mesh_id", "fid", "t.*")


def placed(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the positions of their corners: ax .. cz."""
    out = faces
    for k, p in enumerate("abc"):
        at = vertices.select("mesh_id", F.col("vid").alias(f"v{k}"), *(F.col(i).alias(p + i) for i in "xyz"))
        out = out.join(at, ["mesh_id", f"v{k}"])
    return out


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, e0, e1, n_faces, fids): undirected edges with their faces."""
    c = corners(faces)
    return c.groupBy("mesh_id", F.least("vid", "vid_next").alias("e0"), F.greatest("vid", "vid_next").alias("e1")).agg(F.count("*").alias("n_faces"), F.array_sort(F.collect_list("fid")).alias("fids"))


def valence(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, valence): the number of neighbours."""
    e = edges(faces)
    ends = e.select("mesh_id", F.explode(F.array("e0", "e1")).alias("vid"))
    return ends.groupBy("mesh_id", "vid").agg(F.count("*").alias("valence"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    e = edges(faces).where("n_faces = 1")
    return e.select("mesh_id", F.explode(F.array("e0", "e1")).alias("vid")).distinct()


def unreferenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(corners(faces).select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_anti")


def counts(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, n_vertices, n_edges, n_faces, n_boundary, euler); vertices of no face don't count."""
    e = edges(faces).groupBy("mesh_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_faces") == 1).alias("n_boundary"))
    v = corners(faces).groupBy("mesh_id").agg(F.count_distinct("vid").alias("n_vertices"), F.count_distinct("fid").alias("n_faces"))
    return v.join(e, "mesh_id").withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, area, volume, cx, cy, cz): volume by signed tetrahedra; the centroid is area-weighted."""
    t = placed(faces, vertices)
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    area = G.triangle_area(a, b, c)
    mean = G.face_centroid(a, b, c)
    sums = t.groupBy("mesh_id").agg(F.sum(area).alias("area"), F.abs(F.sum(V.dot(V.cross(a, b), c)) / 6).alias("volume"), *(F.sum(area * m).alias(f"s{k}") for k, m in zip("xyz", mean, strict=True)))
    return sums.select("mesh_id", "area", "volume", *(F.try_divide(f"s{k}", "area").alias(f"c{k}") for k in "xyz"))


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    t = placed(faces, vertices)
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    return t.select("mesh_id", "fid", *(p.alias(f"n{k}") for k, p in zip("xyz", n, strict=True)))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sums of incident face normals weighted by the corner angles, normalised."""
    t = placed(faces, vertices)
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    weights = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), w.alias("w")) for k, w in enumerate(G.corner_angles(a, b, c))])
    parts = t.select("mesh_id", *(p.alias(f"n{k}") for k, p in zip("xyz", n, strict=True)), F.explode(weights).alias("c"))
    sums = parts.groupBy("mesh_id", F.col("c.vid").alias("vid")).agg(*(F.sum(F.col("c.w") * F.col(f"n{k}")).alias(f"n{k}") for k in "xyz"))
    unit = V.normalize(V.vec("n"))
    return sums.select("mesh_id", "vid", *(p.alias(f"n{k}") for k, p in zip("xyz", unit, strict=True)))


def dihedral_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, e0, e1, angle): between the normals of both faces of inner edges."""
    n = face_normals(faces, vertices)
    inner = edges(faces).where("n_faces = 2").select("mesh_id", "e0", "e1", F.col("fids")[0].alias("f0"), F.col("fids")[1].alias("f1"))
    for k in (0, 1):
        inner = inner.join(n.select("mesh_id", F.col("fid").alias(f"f{k}"), *(F.col(f"n{i}").alias(f"n{k}{i}") for i in "xyz")), ["mesh_id", f"f{k}"])
    return inner.select("mesh_id", "e0", "e1", V.angle(V.vec("n0"), V.vec("n1")).alias("angle"))


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    e = edges(faces)
    for k in (0, 1):
        e = e.join(vertices.select("mesh_id", F.col("vid").alias(f"e{k}"), *(F.col(i).alias(f"p{k}{i}") for i in "xyz")), ["mesh_id", f"e{k}"])
    return e.select("mesh_id", "e0", "e1", "n_faces", V.distance(V.vec("p0"), V.vec("p1")).alias("length"))


def face_to_vertex(faces: DataFrame, value: DataFrame, column: str = "value") -> DataFrame:
    """(mesh_id, vid, value): the mean over incident faces of a face column (mesh_id, fid, value)."""
    return corners(faces).join(value.select("mesh_id", "fid", column), ["mesh_id", "fid"]).groupBy("mesh_id", "vid").agg(F.avg(column).alias(column))


def barycentric_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, area): a third of the incident areas."""
    t = placed(faces, vertices)
    area = t.select("mesh_id", "fid", G.triangle_area(V.vec("a"), V.vec("b"), V.vec("c")).alias("value"))
    return corners(faces).join(area, ["mesh_id", "fid"]).groupBy("mesh_id", "vid").agg((F.sum("value") / 3).alias("area"))


def angle_defects(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, gauss): (2 pi - sum of corner angles) / barycentric area, at inner vertices."""
    t = placed(faces, vertices)
    angles = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), w.alias("w")) for k, w in enumerate(G.corner_angles(V.vec("a"), V.vec("b"), V.vec("c")))])
    area = G.triangle_area(V.vec("a"), V.vec("b"), V.vec("c"))
    sums = t.select("mesh_id", area.alias("area"), F.explode(angles).alias("c")).groupBy("mesh_id", F.col("c.vid").alias("vid")).agg(F.sum("c.w").alias("w"), (F.sum("area") / 3).alias("area"))
    inner = sums.join(boundary_vertices(faces), ["mesh_id", "vid"], "left_anti")
    return inner.select("mesh_id", "vid", F.try_divide(2 * F.lit(3.141592653589793) - F.col("w"), F.col("area")).alias("gauss"))


def umbrella(faces: DataFrame, vertices: DataFrame, step: float = 1.0) -> DataFrame:
    """Vertices moved by `step` towards the mean of their neighbours; boundary vertices stay."""
    e = edges(faces)
    both = e.select("mesh_id", F.col("e0").alias("vid"), F.col("e1").alias("to")).unionByName(e.select("mesh_id", F.col("e1").alias("vid"), F.col("e0").alias("to")))
    near = vertices.select("mesh_id", F.col("vid").alias("to"), *(F.col(k).alias("q" + k) for k in "xyz"))
    means = both.join(near, ["mesh_id", "to"]).groupBy("mesh_id", "vid").agg(*(F.avg("q" + k).alias("m" + k) for k in "xyz")).join(boundary_vertices(faces), ["mesh_id", "vid"], "left_anti")
    out = vertices.join(means, ["mesh_id", "vid"], "left")
    return out.select("mesh_id", "vid", *(F.when(F.col("m" + k).isNull(), F.col(k)).otherwise(F.col(k) + step * (F.col("m" + k) - F.col(k))).alias(k) for k in "xyz"))


def edge_number(p, q):
    """A negative number for an edge: a 62-bit hash of its ends, so that no pass over the data is needed and any number of
    steps may follow each other. `checked_numbers` finds clashes."""
    return -F.xxhash64(F.least(p, q), F.greatest(p, q)).bitwiseAND(F.lit((1 << 62) - 1)) - 1


def checked_numbers(vertices: DataFrame) -> DataFrame:
    """The vertices; raises if two of a mesh have one number."""
    clash = vertices.groupBy("mesh_id", "vid").count().where("count > 1").limit(1).count()
    if clash:
        raise ValueError("two vertices of a mesh have one number")
    return vertices


def subdivide(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of midpoint subdivision: each edge gets a vertex, each face becomes four. New vertices are numbered by
    their edge (`edge_number`); a clash of numbers raises."""
    number = edge_number
    e = edges(faces)
    for k in (0, 1):
        e = e.join(vertices.select("mesh_id", F.col("vid").alias(f"e{k}"), *(F.col(i).alias(f"p{k}{i}") for i in "xyz")), ["mesh_id", f"e{k}"])
    middle = e.select("mesh_id", number(F.col("e0"), F.col("e1")).alias("vid"), *(((F.col(f"p0{i}") + F.col(f"p1{i}")) / 2).alias(i) for i in "xyz"))
    a, b, c = (F.col(f"v{k}") for k in range(3))
    ab, bc, ca = number(a, b), number(b, c), number(c, a)
    four = F.array(*[F.struct((F.col("fid") * 4 + i).alias("fid"), p.alias("v0"), q.alias("v1"), r.alias("v2")) for i, (p, q, r) in enumerate(((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)))])
    return checked_numbers(vertices.select("mesh_id", "vid", "x", "y", "z").unionByName(middle)), faces.select("mesh_id", F.explode(four).alias("f")).select("mesh_id", "f.*")


def weld(vertices: DataFrame, faces: DataFrame, cell: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Vertices that share a grid cell become the one with the smallest id; degenerate faces go."""
    key = [F.floor(F.col(k) / cell).alias("c" + k) for k in "xyz"]
    cells = vertices.select("mesh_id", "vid", *key)
    firsts = cells.groupBy("mesh_id", "cx", "cy", "cz").agg(F.min("vid").alias("to"))
    renamed = cells.join(firsts, ["mesh_id", "cx", "cy", "cz"]).select("mesh_id", "vid", "to")
    out = faces
    for k in range(3):
        out = out.join(renamed.select("mesh_id", F.col("vid").alias(f"v{k}"), F.col("to").alias(f"t{k}")), ["mesh_id", f"v{k}"]).drop(f"v{k}").withColumnRenamed(f"t{k}", f"v{k}")
    out = out.where("v0 <> v1 and v1 <> v2 and v2 <> v0").select("mesh_id", "fid", "v0", "v1", "v2")
    return vertices.join(renamed.where("vid = to").select("mesh_id", "vid"), ["mesh_id", "vid"], "left_semi"), out


def flipped(faces: DataFrame) -> DataFrame:
    """Faces with the opposite orientation."""
    return faces.select("mesh_id", "fid", "v0", F.col("v2").alias("v1"), F.col("v1").alias("v2"))


def face_kinds(polygons: DataFrame) -> DataFrame:
    """(mesh_id, is_triangle_mesh, is_quad_mesh) of polygons (mesh_id, fid, vids)."""
    n = F.size("vids")
    return polygons.groupBy("mesh_id").agg(F.bool_and(n == 3).alias("is_triangle_mesh"), F.bool_and(n == 4).alias("is_quad_mesh"))


def manifold_vertices(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, manifold): at most one gap, that is at most one boundary edge that leaves the vertex."""
    rim = edges(faces).where("n_faces = 1").select("mesh_id", F.explode(F.array("e0", "e1")).alias("vid")).withColumn("rim", F.lit(1))
    used = corners(faces).select("mesh_id", "vid", F.lit(0).alias("rim"))
    return used.unionByName(rim).groupBy("mesh_id", "vid").agg((F.sum("rim") <= 2).alias("manifold"))


def vertex_metric(faces: DataFrame, value: DataFrame, most: float = 1e12) -> DataFrame:
    """(mesh_id, vid, value): the mean over incident faces of a metric (mesh_id, fid, value); values over `most`, infinite
    ones and NaN add nothing to the sum but count in the divisor."""
    good = ~F.isnan("value") & (F.abs("value") <= most)
    held = corners(faces).join(value, ["mesh_id", "fid"])
    return held.groupBy("mesh_id", "vid").agg((F.sum(F.when(good, F.col("value")).otherwise(0.0)) / F.count("*")).alias("value"))


def vertex_signs(faces: DataFrame, flags: DataFrame) -> DataFrame:
    """(mesh_id, vid, value): the mean over incident faces of +1 for a true and -1 for another flag (mesh_id, fid, flag)."""
    return face_to_vertex(faces, flags.select("mesh_id", "fid", F.when(F.col("flag"), 1.0).otherwise(-1.0).alias("value")))


def vertex_quadrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, q0 .. q9): the sums of the quadrics of the incident faces' planes."""
    at = placed(faces, vertices)
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.normalize(V.cross(V.minus(b, a), V.minus(c, a)))
    rows = at.select("mesh_id", "fid", *(q.alias(f"q{i}") for i, q in enumerate(G.plane_quadric(n, a))), F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return rows.groupBy("mesh_id", "vid").agg(*(F.sum(f"q{i}").alias(f"q{i}") for i in range(10)))


def covolume_stats(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, least, most, mean) of the barycentric areas of the vertices."""
    return barycentric_areas(faces, vertices).groupBy("mesh_id").agg(F.min("area").alias("least"), F.max("area").alias("most"), F.avg("area").alias("mean"))


def dual(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vid, x, y, z) at the faces' centroids, numbered as these, and polygons (mesh_id, fid, vids), one for
    each inner vertex of the mesh, numbered as that: its faces counter-clockwise from the smallest. Vertices where several
    fans meet give none. A ring is as long as the vertex has faces."""
    at = placed(faces, vertices)
    middle = G.face_centroid(V.vec("a"), V.vec("b"), V.vec("c"))
    centroids = at.select("mesh_id", F.col("fid").alias("vid"), *(m.alias(k) for k, m in zip("xyz", middle, strict=True)))
    # Of two faces in a row around a vertex the second leaves along the edge on which the first comes back.
    spoke = F.struct("fid", "vid_next", "vid_prev")
    rings = corners(faces).groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_list(spoke)).alias("s"))
    rings = rings.withColumn("after", F.map_from_entries(F.transform(F.array_distinct(F.transform("s", lambda e: e["vid_next"])), lambda v: F.struct(v, F.filter("s", lambda e: e["vid_next"] == v)[0]))))
    step = lambda ring, _: F.concat(ring, F.array(F.try_element_at("after", F.element_at(ring, -1)["vid_prev"])))
    walked = F.aggregate(F.col("s"), F.array(F.col("s")[0]), step)
    rings = rings.withColumn("ring", walked)
    whole = (F.element_at("ring", -1) == F.col("ring")[0]) & (F.size(F.array_distinct("ring")) == F.size("s"))
    polygons = rings.where(whole).select("mesh_id", F.col("vid").alias("fid"), F.transform(F.slice("ring", F.lit(1), F.size("s")), lambda e: e["fid"]).alias("vids"))
    return centroids, polygons
