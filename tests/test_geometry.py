"""Known values and plain versions of the geometry operators."""

import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from polyspan.functions import geometry as G
from polyspan.functions import vector as V
from polyspan.operators import curves, fields, fixpoint, grids, joins, mesh, sampling
from polyspan.sources import sinks, text_meshes

TETRA = ([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])


@pytest.fixture(scope="module")
def tetra(spark):
    v = spark.createDataFrame([(0, *p) for p in TETRA[0]], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, i, *t) for i, t in enumerate(TETRA[1])], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    return v, f


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(300)]
    rows += [(1000 + i, 0.5, 0.5, 0.5) for i in range(40)]  # a crowded cell
    return spark.createDataFrame(rows, "pid long, x double, y double, z double"), rows


def one(spark, **values):
    return spark.createDataFrame([tuple(map(float, values.values()))], " double, ".join(values) + " double")


def test_known_values(spark):
    row = one(spark, ax=0, ay=0, az=0, bx=1, by=0, bz=0, cx=0, cy=1, cz=0, px=0.5, py=0.5, pz=1)
    a, b, c, p = (V.vec(k) for k in "abcp")
    down = (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    r = row.select(G.triangle_area(a, b, c).alias("area"), G.triangle_distance(p, a, b, c).alias("d"), G.min_angle(a, b, c).alias("least"), G.max_angle(a, b, c).alias("most"), G.ray_hits_triangle((F.lit(0.2), F.lit(0.2), F.lit(3.0)), down, a, b, c).alias("hit"), G.radius_ratio(a, b, c).alias("ratio"), G.radius_ratio(a, a, a).alias("flat")).first()
    assert r.area == 0.5 and abs(r.d - 1) < 1e-12 and abs(r.least - math.pi / 4) < 1e-12 and abs(r.most - math.pi / 2) < 1e-12
    assert abs(r.hit - 3) < 1e-12 and abs(r.ratio - 2 * (math.sqrt(2) - 1)) < 1e-9 and r.flat == 0


def test_degenerate_vectors(spark):
    row = one(spark, ax=0, ay=0, az=0, bx=1, by=0, bz=0)
    r = row.select(*V.normalize(V.vec("a")), V.angle(V.vec("a"), V.vec("b")), G.segment_distance(V.vec("b"), V.vec("a"), V.vec("a"))).first()
    assert tuple(r) == (0, 0, 0, 0, 1)


def test_tetrahedron(tetra):
    v, f = tetra
    c = mesh.counts(v, f).first()
    assert (c.n_vertices, c.n_edges, c.n_faces, c.n_boundary, c.euler) == (4, 6, 4, 0, 2)
    m = mesh.measures(f, v).first()
    assert abs(m.volume - 1 / 6) < 1e-12 and abs(m.area - (1.5 + math.sqrt(3) / 2)) < 1e-12
    v2, f2 = mesh.subdivide(v, f)
    assert mesh.counts(v2, f2).first().euler == 2 and f2.count() == 16 and v2.count() == 10
    assert abs(mesh.measures(f2, v2).first().volume - 1 / 6) < 1e-12
    total = mesh.angle_defects(f, v).join(mesh.barycentric_areas(f, v), ["mesh_id", "vid"]).agg(F.sum(F.col("gauss") * F.col("area"))).first()[0]
    assert abs(total - 4 * math.pi) < 1e-9  # Gauss-Bonnet


def test_radius_and_knn(cloud):
    points, rows = cloud
    for r in (0.1, 0.3):
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if math.dist(a[1:], b[1:]) <= r}
        assert {(x.pid, x.other) for x in joins.radius_join(points, points, r).where("pid < other").collect()} == want
    near = joins.knn_join(points, points, 3, 0.1)
    got = {(x.pid, x["rank"]): x.other for x in near.collect()}
    for a in rows:
        best = sorted((math.dist(a[1:], b[1:]), b[0]) for b in rows if b[0] != a[0])[:3]
        assert [got[a[0], k + 1] for k in range(3)] == [i for _, i in best]


def test_knn_of_few_points(spark):
    few = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert {(r.pid, r.other) for r in joins.knn_join(few, few, 3, 1.0).collect()} == {(0, 1), (1, 0)}
    assert joins.knn_join(few.where("false"), few, 3, 1.0).count() == 0


def test_salting_keeps_all_pairs(cloud):
    points, rows = cloud
    keys = ["cx", "cy", "cz"]
    q, p = joins.salted(joins.around(points, 0.2), joins.celled(points, 0.2), keys, most=7)
    assert q.join(p.withColumnRenamed("pid", "other").drop("x", "y", "z"), [*keys, "_salt"]).count() == joins.around(points, 0.2).join(joins.celled(points, 0.2).select(*keys), keys).count()


def test_clusters_and_poisson(cloud, spark, tmp_path):
    points, rows = cloud
    up = {r[0]: r[0] for r in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in itertools.combinations(rows, 2):
        if math.dist(a[1:], b[1:]) < 0.09:
            x, y = sorted((find(a[0]), find(b[0])))
            up[y] = x
    assert {r.pid: r.cluster for r in fixpoint.radius_clusters(points, 0.09).collect()} == {i: find(i) for i in up}
    kept = [tuple(r) for r in sampling.poisson_disc(points, 0.2).collect()]
    assert all(math.dist(a[1:], b[1:]) > 0.2 for a, b in itertools.combinations(kept, 2))
    assert all(any(math.dist(a[1:], b[1:]) <= 0.2 for b in kept) for a in rows)


def test_weighted_sample_prefers_weights(cloud):
    points, _ = cloud
    chosen = sampling.weighted(points.withColumn("w", F.when(F.col("pid") < 150, 50.0).otherwise(1.0)), "w", 100)
    assert chosen.where("pid < 150").count() > 75


def test_curves(spark):
    n = 32
    circle = [(0, k, math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    df = spark.createDataFrame(circle, "curve_id long, seq long, x double, y double")
    assert abs(curves.signed_areas(df).first().area - n / 2 * math.sin(2 * math.pi / n)) < 1e-12
    inner = [r.curvature for r in curves.curvatures(df).collect() if r.curvature is not None]
    assert len(inner) == n - 2 and all(abs(k - 1) < 1e-9 for k in inner)
    assert curves.self_crossings(df, 0.3).count() == 0
    eight = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 0.5, 1.0), (0, 3, 0.6, -1.0)], df.schema)
    assert [tuple(r) for r in curves.self_crossings(eight, 0.3).collect()] == [(0, 0, 2)]
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 2.0, 2.0)], "pid long, x double, y double")
    assert {r.pid: r.inside for r in curves.points_inside(pts, df.select("seq", "x", "y")).collect()} == {0: True, 1: False}


def test_grid_samples(spark):
    grid = spark.createDataFrame([(i, j, float(i + j)) for i in range(3) for j in range(3)], "ix long, iy long, value double")
    at = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5), (2, 0.5, 1.5), (3, 1.5, 1.5)], "pid long, x double, y double")
    assert {r.pid: r["sample"] for r in grids.bilinear(grid, at).collect()} == {0: 1.0, 1: 2.0, 2: 2.0, 3: 3.0}
    assert {(r.gx, r.gy) for r in grids.gradient(grid).collect()} == {(1.0, 1.0)}
    assert [r.laplacian for r in grids.laplacian(grid).collect()] == [0.0]
    assert [(r.ix, r.iy) for r in grids.local_maxima(grid).collect()] == [(2, 2)]


def test_histogram_lines(spark):
    values = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.0,), (None,)], "v double")
    bins = fields.histogram(values, "v", 2, 0.0, 1.0)
    assert {(r.bin, r.n) for r in bins.collect()} == {(0, 2), (1, 2)}
    assert sorted(r.line for r in sinks.histogram_lines(bins, 2, 0.0, 1.0).collect()) == ["(-inf.. 0.5) : 2", "[0.5.. +inf) : 2"]


def test_obj_references(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nv 0 1 0\nf 1/1/1 2//1 3\nv 0 0 1\nf -1 -3 -4\n")
    v, f = text_meshes.read_mesh(spark, str(tmp_path / "a.obj"))
    assert v.count() == 4 and {tuple(r.vids) for r in f.collect()} == {(0, 1, 2), (3, 1, 0)}


def test_binary_files():
    raw = [[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(1, 0, 0), (0, 1, 0), (0, 0, 1)]]
    stl = b"\0" * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 0, *(c for p in t for c in p), 0) for t in raw)
    points, faces = text_meshes.parse_stl(stl)
    assert len(points) == 4 and faces == [[0, 1, 2], [1, 2, 3]]
    for order, kind in (("<", "binary_little_endian"), (">", "binary_big_endian")):
        head = f"ply\nformat {kind} 1.0\nelement vertex 3\nproperty float x\nproperty double y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
        body = b"".join(struct.pack(order + "fdf", i, 2 * i, 3) for i in range(3)) + struct.pack(order + "B3i", 3, 0, 1, 2)
        points, faces = text_meshes.parse_ply(head + body)
        assert points.tolist() == [[0, 0, 3], [1, 2, 3], [2, 4, 3]] and faces == [[0, 1, 2]]


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _strip(n):
    return [(float(i), i % 2 + 0.5, 0.0) for i in range(n)], [(i, i + 1, i + 2) for i in range(n - 2)]


@pytest.mark.parametrize("kind", ["obj", "relative_obj", "off", "off_inline", "ply", "xyz"])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, kind):
    points, faces = _strip(600)
    xyz = [" ".join(map(str, p)) for p in points]
    corners = [f"3 {a} {b} {c}" for a, b, c in faces]
    lines = {
        "obj": ["# c", *("v " + x for x in xyz), *(f"f {a + 1} {b + 1} {c + 1}" for a, b, c in faces)],
        "relative_obj": [x for i, p in enumerate(xyz) for x in (f"v {p}", *(["f -3 -2 -1"] if i > 1 else []))],
        "off": ["OFF", "# c", f"{len(xyz)} {len(faces)} 0", "", *(x + " # p" for x in xyz), *corners],
        "off_inline": [f"OFF {len(xyz)} {len(faces)} 0", *xyz, *corners],
        "ply": ["ply", "format ascii 1.0", "comment c", f"element face {len(faces)}", "property uchar q", "property list uchar int vertex_indices", f"element vertex {len(xyz)}", "property float nx", "property float x", "property float y", "property float z", "end_header", *("9 " + c for c in corners), *("7 " + x for x in xyz)],
        "xyz": xyz,
    }[kind]
    path = tmp_path / f"a.{kind}"
    path.write_text("\n".join(lines) + "\n")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
    if kind == "xyz":
        assert sorted((r.pid, r.x, r.y, r.z) for r in text_meshes.read_points(spark, str(path)).collect()) == [(i, *p) for i, p in enumerate(points)]
        return
    v, f = text_meshes.read_mesh(spark, str(path), kind.split("_")[-1] if kind != "off_inline" else "off")
    assert sorted((r.vid, r.x, r.y, r.z) for r in v.collect()) == [(i, *p) for i, p in enumerate(points)]
    assert sorted((r.fid, tuple(r.vids)) for r in f.collect()) == list(enumerate(faces))


def test_text_and_binary_by_their_header(spark, tmp_path):
    (tmp_path / "a.off").write_bytes(b"OFF BINARY\n" + struct.pack("<3I9f4I", 3, 1, 0, *range(9), 3, 0, 1, 2))
    v, f = text_meshes.read_mesh(spark, str(tmp_path / "a.off"))
    assert sorted((r.vid, r.x, r.y, r.z) for r in v.collect()) == [(0, 0, 1, 2), (1, 3, 4, 5), (2, 6, 7, 8)] and [r.vids for r in f.collect()] == [[0, 1, 2]]
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + struct.pack("<3f", 1, 2, 3))
    v, f = text_meshes.read_mesh(spark, str(tmp_path / "b.ply"))
    assert [(r.x, r.y, r.z) for r in v.collect()] == [(1, 2, 3)] and f.count() == 0
    (tmp_path / "c.off").write_text("OFF\n0 0 0\n")
    v, f = text_meshes.read_mesh(spark, str(tmp_path / "c.off"))
    assert v.count() == 0 and f.count() == 0


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        text_meshes.read_mesh(spark, "/x/a.blend")


def test_shrinking_circle(spark):
    from polyspan.operators import flows

    n, tau, steps = 32, 0.005, 10
    circle = [(0, k, math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    out = flows.shrink(spark.createDataFrame(circle, "curve_id long, seq long, x double, y double"), tau, steps)
    radius = math.sqrt(1 - 2 * tau * steps)
    assert all(abs(math.hypot(r.x, r.y) - radius) < 2e-3 for r in out.collect())


def test_no_answer_is_cut_short(spark):
    """Far points, long paths and chains: rounds end when everything is found."""
    from polyspan.operators import fixpoint, joins, sampling

    far = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 5000.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert {(r.pid, r.other, r.d) for r in joins.knn_join(far, far, 1, 1.0).collect()} == {(0, 1, 5000.0), (1, 0, 5000.0)}
    ids = [(7 * k) % 300 for k in range(300)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    nodes = spark.createDataFrame([(k,) for k in range(301)], "node long")
    assert {(r.node, r.label) for r in fixpoint.labels(nodes, edges).collect()} == {(k, 0) for k in range(300)} | {(300, 300)}
    path = spark.createDataFrame([(k, k + 1, 1.0) for k in range(12)], "u long, v long, length double")
    assert {r.node: r.distance for r in fixpoint.hop_distances(path, nodes.where("node = 0")).collect()} == {k: float(k) for k in range(13)}
    row = spark.createDataFrame([(k, k / 10, 0.0, 0.0) for k in range(40)], "pid long, x double, y double, z double")
    taken = [r.pid for r in sampling.poisson_disc(row, 0.25).collect()]
    assert all(abs(a - b) >= 3 for a in taken for b in taken if a != b) and all(any(abs(k - a) <= 2 for a in taken) for k in range(40))


def test_repeated_subdivision(spark):
    from polyspan.operators import mesh, surface

    centres = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], "mesh_id long, x double, y double, z double, r double")
    v, f = surface.solids(centres, "octahedron")
    for _ in range(3):
        v, f = mesh.subdivide(v, f)
    row = mesh.counts(v, f).first()
    assert (row.n_vertices, row.n_faces, row.n_boundary, row.euler) == (258, 512, 0, 2)


def test_nearest_triangles_and_surface(spark):
    """Against all pairs in numpy; a sphere's isosurface closes and has the sphere's area."""
    import numpy as np

    from polyspan.operators import shapes

    rng = np.random.default_rng(4)
    t, p = rng.normal(0, 1, (60, 3, 3)), rng.normal(0, 3, (40, 3))
    names = [c + k for c in "abc" for k in "xyz"]
    tris = spark.createDataFrame([(i, *map(float, x.ravel())) for i, x in enumerate(t)], "fid long, " + ", ".join(f"{n} double" for n in names))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    got = {r.pid: (r.fid, r.d) for r in shapes.nearest_triangle(points, tris, 0.3).collect()}
    u, v = np.meshgrid(np.linspace(0, 1, 60), np.linspace(0, 1, 60))
    keep = u + v <= 1 + 1e-9
    w = np.stack([1 - u[keep] - v[keep], u[keep], v[keep]])
    for i, x in enumerate(p):
        d = np.sqrt(((np.einsum("wk,twc->tkc", w, t) - x) ** 2).sum(axis=2)).min(axis=1)
        assert got[i][1] <= d.min() + 1e-9 and got[i][1] > d.min() - 0.1 and d[got[i][0]] < d.min() + 0.1
    n = 16
    grid = spark.createDataFrame([(a, b, c, float((a - 8) ** 2 + (b - 8) ** 2 + (c - 8) ** 2)) for a in range(n) for b in range(n) for c in range(n)], "ix long, iy long, iz long, value double")
    rows = shapes.isosurface(grid, 30.5).collect()
    area = sum(np.linalg.norm(np.cross(np.subtract((r.bx, r.by, r.bz), (r.ax, r.ay, r.az)), np.subtract((r.cx, r.cy, r.cz), (r.ax, r.ay, r.az)))) / 2 for r in rows)
    assert abs(area / (4 * np.pi * 30.5) - 1) < 0.05
    edges = {}
    for r in rows:
        c = [tuple(round(getattr(r, k + x), 9) for x in "xyz") for k in "abc"]
        for e in ((c[0], c[1]), (c[1], c[2]), (c[2], c[0])):
            edges[frozenset(e)] = edges.get(frozenset(e), 0) + 1
    assert set(edges.values()) == {2}


def test_principal_axes(spark):
    import numpy as np

    from polyspan.plans import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    for r in registry.QUERIES["principal_axes"](spark, "/root/testdata/sf0.001").collect():
        x = np.array([[float(v) * 8 for v in s.embedding[:3]] for s in rows if s.label == r.cloud_id])
        want = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(x.T, bias=True)), 0))[::-1]
        assert np.allclose([r.e1, r.e2, r.e3], want, atol=1e-5)
