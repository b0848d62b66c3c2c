"""Readers of text and binary geometry files as Spark jobs.

Formats of one element a line (OBJ, XYZ, AGI, and OFF and PLY as text) are read in as many splits as Spark cuts a file
into, so that one large file is the work of many tasks; `_lines` finds the place of every line in its file. STL and
VTK are read so from parts, with a corner, point or polygon a line; single STL and VTK files and binary ones are read whole,
a file a row, and parsed where they lie. Nothing passes the driver.

Results have the columns of the library's tables with `mesh_id` the hash of the file's path and `path`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.order import numbered


def _lines(spark: SparkSession, path: str, wanted: Column, parts: bool, **kinds: Column) -> DataFrame:
    """(path, mesh_id, line, words) of the wanted lines, and for each of `kinds` (a flag or a number a line) its sum
    over the lines before it in the file. Order within a split is Spark's reading order; what earlier splits hold is a running sum over one short
    row a split. Lines are parsed from one table, so that a lost executor cannot cut the file otherwise in between. With
    `parts`, the files of a folder are one mesh, in the order of their names, and `path` is the folder."""
    blank = F.lit(" \t\r")
    name = F.col("_metadata.file_path")
    path_, file = (F.regexp_replace(name, "/[^/]*$", ""), F.col("_metadata.file_name")) if parts else (name, F.lit(""))
    text = spark.read.text(path).select(path_.alias("path"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value", blank).alias("line"))
    kept = cut(text.withColumn("words", F.split("line", r"\s+")).where(wanted))
    before = Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept.groupBy("path", "file", "block").agg(*(F.sum(c.cast("long")).alias("_" + n) for n, c in kinds.items()))
    blocks = cut(blocks.select("path", "file", "block", *(F.coalesce(F.sum("_" + n).over(before), F.lit(0)).alias("_" + n) for n in kinds)))
    ahead = Window.partitionBy("path", "file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a split at most
    return kept.join(blocks, ["path", "file", "block"]).select("path", F.xxhash64("path").alias("mesh_id"), "line", "words", *((F.col("_" + n) + F.coalesce(F.sum(c.cast("long")).over(ahead), F.lit(0))).cast("long").alias(n) for n, c in kinds.items()))


def read_obj(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (path, mesh_id, vid, x, y, z) and faces (path, mesh_id, fid, vids) of OBJ files; ids from 0. References
    to textures and normals are dropped, negative ones count back from the vertices read so far."""
    first = F.col("words")[0]
    lines = _lines(spark, path, first.isin("v", "f"), parts, vid=first == "v", fid=first == "f")
    v = lines.where(first == "v").select("path", "mesh_id", "vid", *(F.try_element_at("words", F.lit(i + 2)).try_cast("double").alias(k) for i, k in enumerate("xyz")))
    ref = lambda w: F.split(w, "/")[0].try_cast("long")
    ids = F.transform(F.slice("words", 2, F.size("words")), lambda w: F.when(ref(w) < 0, F.col("vid") + ref(w)).otherwise(ref(w) - 1))
    return v, lines.where(first == "f").select("path", "mesh_id", "fid", ids.alias("vids"))


def read_xyz(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """points (path, cloud_id, pid, x, y, z, nx, ny, nz): three numbers a line, or six with a normal."""
    words = _lines(spark, path, F.size("words") >= 3, parts, pid=F.lit(True))
    at = lambda i: F.try_element_at("words", F.lit(i + 1)).try_cast("double")
    normal = lambda i: F.when(F.size("words") == 6, at(i))
    return words.select("path", F.col("mesh_id").alias("cloud_id"), "pid", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), normal(3).alias("nx"), normal(4).alias("ny"), normal(5).alias("nz"))


def read_agi(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """points with colour (0 to 1) and normal: exactly nine numbers a line, other lines are left out."""
    words = _lines(spark, path, F.size("words") == 9, parts, pid=F.lit(True))
    names = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")
    values = [(F.get("words", F.lit(i)).try_cast("double") / (255 if n in "rgb" else 1)).alias(n) for i, n in enumerate(names)]
    return words.select("path", F.col("mesh_id").alias("cloud_id"), "pid", *values)


def _placed_lines(lines: DataFrame, head: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of numbered lines, given by path where they start (v0, f0), how many there are (n, m), the
    places of x, y and z in a vertex line (ix, iy, iz) and that of the corner count in a face line (at); for `pairs`, that
    of the first of two corners."""
    both = lines.join(cut(head), "path")  # a row a file: Spark sends it to the lines while it is small
    of = lambda c: F.try_element_at("words", F.col(c).cast("int") + 1).try_cast("double")
    v = both.where((F.col("no") >= F.col("v0")) & (F.col("no") < F.col("v0") + F.col("n")))
    f = both.where((F.col("no") >= F.col("f0")) & (F.col("no") < F.col("f0") + F.col("m")))
    corners = F.expr("transform(slice(words, cast(at as int) + 2, greatest(0, coalesce(try_cast(get(words, cast(at as int)) as int), 0))), w -> try_cast(w as bigint))")
    if pairs:
        corners = F.expr("transform(slice(words, cast(at as int) + 1, 2), w -> try_cast(w as bigint))")
    return v.select("path", "mesh_id", (F.col("no") - F.col("v0")).alias("vid"), *(F.coalesce(of("i" + k), F.lit(0.0)).alias(k) for k in "xyz")), f.select("path", "mesh_id", (F.col("no") - F.col("f0")).alias("fid"), corners.alias("vids"))


def read_off(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of OFF files as text, comments left out; further columns of a line are left out."""
    lines = _lines(spark, path, ~F.col("line").rlike("^(#.*)?$"), parts, no=F.lit(True)).withColumn("words", F.split(F.trim(F.substring_index("line", "#", 1)), r"\s+"))
    first, second = (F.max(F.when(F.col("no") == i, F.col("words"))) for i in (0, 1))
    head = lines.where("no < 2").groupBy("path").agg(first.alias("first"), second.alias("second"))
    inline = F.size("first") > 1
    count = lambda i: F.when(inline, F.try_element_at("first", F.lit(i + 2))).otherwise(F.try_element_at("second", F.lit(i + 1))).try_cast("long")
    head = head.select("path", F.when(inline, 1).otherwise(2).cast("long").alias("v0"), count(0).alias("n"), count(1).alias("m"), *(F.lit(i).alias("i" + k) for i, k in enumerate("xyz")), F.lit(0).alias("at"))
    return _placed_lines(lines, head.withColumn("f0", F.col("v0") + F.col("n")))


def read_ply(spark: SparkSession, path: str, parts: bool = False, element: str = "face") -> tuple[DataFrame, DataFrame]:
    """vertices and faces of PLY files as text, an element a line; elements and properties come in any order, the
    corners of a face after its plain properties. With `element` edge, edges (vertex1, vertex2) instead of faces."""
    lines = _lines(spark, path, F.col("line") != "", parts, no=F.lit(True))
    word = F.col("words")
    known = cut(lines.where(word[0].isin("element", "property", "end_header")).select("path", "no", "words"))
    by_line = Window.partitionBy("path").orderBy("no")
    known = known.withColumn("element", F.last(F.when(word[0] == "element", word[1]), ignorenulls=True).over(by_line))
    ends = known.where(word[0] == "end_header").groupBy("path").agg((F.min("no") + 1).alias("body"))
    earlier = by_line.rowsBetween(Window.unboundedPreceding, -1)
    elements = known.where(word[0] == "element").select("path", "element", word[2].try_cast("long").alias("n"), F.coalesce(F.sum(word[2].try_cast("long")).over(earlier), F.lit(0)).alias("skip"))
    place = F.row_number().over(Window.partitionBy("path", "element").orderBy("no")) - 1
    properties = known.where(word[0] == "property").select("path", "element", F.element_at("words", -1).alias("name"), (word[1] == "list").alias("list"), place.alias("place"))
    of = lambda e, c: F.max(F.when(F.col("element") == e, F.col(c)))
    spans = elements.groupBy("path").agg(of("vertex", "skip").alias("v0"), of("vertex", "n").alias("n"), of(element, "skip").alias("f0"), of(element, "n").alias("m"))
    places = properties.groupBy("path").agg(*(F.max(F.when((F.col("element") == "vertex") & (F.col("name") == k), F.col("place"))).alias("i" + k) for k in "xyz"), F.min(F.when((F.col("element") == element) & (F.col("name") == "vertex1" if element == "edge" else F.col("list")), F.col("place"))).alias("at"))
    head = spans.join(ends, "path").join(places, "path").select("path", (F.col("v0") + F.col("body")).alias("v0"), "n", (F.col("f0") + F.col("body")).alias("f0"), "m", "ix", "iy", "iz", "at")
    return _placed_lines(lines, head, element == "edge")


def read_stl(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and triangles of STL files as text, a corner a line: equal corners joined in order of their first use."""
    word = F.col("words")
    lines = _lines(spark, path, word[0] == "vertex", parts, no=F.lit(True))
    at = lambda i: F.try_element_at("words", F.lit(i + 2)).try_cast("double") + F.lit(0.0)
    corners = cut(lines.select("path", "mesh_id", "no", *(at(i).alias(k) for i, k in enumerate("xyz"))))
    first = corners.groupBy("path", "mesh_id", "x", "y", "z").agg(F.min("no").alias("first"))
    ranked = cut(numbered(first, ["path", "first"], "vid"))
    base = ranked.groupBy("path").agg(F.min("vid").alias("_base"))
    v = cut(ranked.join(base, "path").withColumn("vid", F.col("vid") - F.col("_base")).select("path", "mesh_id", "vid", "x", "y", "z"))
    same = F.lit(True)
    for k in ("path", *"xyz"):
        same = same & F.col("c." + k).eqNullSafe(F.col("v." + k))
    placed = corners.alias("c").join(v.alias("v").hint("merge"), same).select("c.path", "c.mesh_id", F.floor(F.col("c.no") / 3).alias("fid"), F.struct("c.no", "v.vid").alias("at"))
    f = placed.groupBy("path", "mesh_id", "fid").agg(F.array_sort(F.collect_list("at")).alias("at")).select("path", "mesh_id", "fid", F.col("at.vid").alias("vids"))
    return v, f


def read_vtk(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of legacy VTK files as text with a point and a polygon a line, as they are written here."""
    word = F.col("words")
    lines = _lines(spark, path, F.col("line") != "", parts, no=F.lit(True))
    of = lambda name, c: F.max(F.when(F.upper(word[0]) == name, c))
    head = lines.where(F.upper(word[0]).isin("POINTS", "POLYGONS")).groupBy("path").agg(
        (of("POINTS", F.col("no")) + 1).alias("v0"), of("POINTS", word[1].try_cast("long")).alias("n"), (of("POLYGONS", F.col("no")) + 1).alias("f0"), of("POLYGONS", word[1].try_cast("long")).alias("m"))
    return _placed_lines(lines, head.select("*", *(F.lit(i).alias("i" + k) for i, k in enumerate("xyz")), F.lit(0).alias("at")))


def read_polylines(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (path, mesh_id, vid, x, y, z) and polylines (path, mesh_id, lid, vids) of OBJ files with l lines."""
    first = F.col("words")[0]
    lines = _lines(spark, path, first.isin("v", "l"), parts, vid=first == "v", lid=first == "l")
    v = lines.where(first == "v").select("path", "mesh_id", "vid", *(F.try_element_at("words", F.lit(i + 2)).try_cast("double").alias(k) for i, k in enumerate("xyz")))
    ids = F.transform(F.slice("words", 2, F.size("words")), lambda w: w.try_cast("long") - 1)
    return v, lines.where(first == "l").select("path", "mesh_id", "lid", ids.alias("vids"))


def read_vti(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """grid (path, ix, iy, iz, value) of image data with one textual array of scalars, x running fastest."""
    tag = F.col("line").startswith("<")
    extent = F.regexp_extract("line", 'WholeExtent="([^"]*)"', 1)
    lines = _lines(spark, path, (F.col("line") != "") & (~tag | (extent != "")), parts, at=F.when(tag, 0).otherwise(F.size("words")))
    size = lambda i: F.try_element_at("e", F.lit(2 * i + 2)).try_cast("long") - F.try_element_at("e", F.lit(2 * i + 1)).try_cast("long") + 1
    head = cut(lines.where(tag).select("path", F.split(extent, " ").alias("e")).select("path", size(0).alias("nx"), size(1).alias("ny")))
    values = lines.where(~tag).select("path", "at", F.posexplode("words").alias("k", "word")).select("path", (F.col("at") + F.col("k")).alias("at"), F.col("word").try_cast("double").alias("value")).join(head, "path")
    return values.select("path", F.pmod("at", "nx").alias("ix"), F.pmod(F.floor(F.col("at") / F.col("nx")), F.col("ny")).alias("iy"), F.floor(F.col("at") / (F.col("nx") * F.col("ny"))).alias("iz"), "value")


_VERTEX = "path string, mesh_id long, vid long, x double, y double, z double"
_FACE = "path string, mesh_id long, fid long, vids array<long>"
_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_off(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Positions and faces of an OFF file, as text or binary (little-endian 32-bit counts, floats and indices after the
    line OFF BINARY); further columns of a vertex line are left out."""
    if data.startswith(b"OFF BINARY"):
        at = data.index(b"\n") + 1
        n, m, _ = np.frombuffer(data, "<u4", 3, at).tolist()
        points = np.frombuffer(data, "<f4", 3 * n, at + 12).reshape(-1, 3).astype(float)
        raw, at, faces = np.frombuffer(data, "<u4", offset=at + 12 + 12 * n), 0, []
        for _ in range(m):
            size = int(raw[at])
            faces.append(raw[at + 1 : at + 1 + size].tolist())
            at += 1 + size
        return points, faces
    lines = [x for line in data.decode().splitlines() if (x := line.partition("#")[0].split())]
    if not lines or not lines[0][0].endswith("OFF"):
        raise ValueError("not an OFF file")
    head = lines[0][1:] or lines.pop(1)
    n, m = int(head[0]), int(head[1])
    points = np.array([[float(v) for v in w[:3]] for w in lines[1 : n + 1]], float).reshape(-1, 3)
    return points, [[int(v) for v in w[1 : 1 + int(w[0])]] for w in lines[n + 1 : n + 1 + m]]


def parse_stl(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Positions and triangles of an STL file, equal corners joined in order of their first use."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        raw = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)["v"].reshape(-1, 3).astype(float)
    else:
        raw = np.array([[float(v) for v in w[1:4]] for line in data.decode().splitlines() if (w := line.split()) and w[0] == "vertex"], float).reshape(-1, 3)
    if not len(raw):
        return raw, []
    _, first, place = np.unique(raw, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return raw[first[order]], rank[place.ravel()].reshape(-1, 3).tolist()


def parse_ply(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Positions and faces of a PLY file, ASCII or binary of either byte order."""
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for words in (line.split() for line in data[:end].decode().splitlines()):
        if not words:
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            elements[-1][2].append(words[1:])
    points, faces, at = np.zeros((0, 3)), [], 0
    tokens = body.decode().split() if kind == "ascii" else None
    order = ">" if kind == "binary_big_endian" else "<"
    for name, n, properties in elements:
        rows, lists = [], any(p[0] == "list" for p in properties)
        names = [p[-1] for p in properties]
        if tokens is None and not lists:
            table = np.frombuffer(body, np.dtype([(p[-1], order + _TYPES[p[0]]) for p in properties]), n, at)
            at += table.nbytes
            if name == "vertex":
                points = np.stack([table[k].astype(float) if k in names else np.zeros(n) for k in "xyz"], axis=1)
            continue
        for _ in range(n):
            row = []
            for p in properties:
                if p[0] == "list":
                    if tokens is not None:
                        size = int(tokens[at])
                        row.append([int(float(v)) for v in tokens[at + 1 : at + 1 + size]])
                        at += 1 + size
                    else:
                        counter, item = np.dtype(order + _TYPES[p[1]]), np.dtype(order + _TYPES[p[2]])
                        size = int(np.frombuffer(body, counter, 1, at)[0])
                        at += counter.itemsize
                        row.append([int(v) for v in np.frombuffer(body, item, size, at)])
                        at += item.itemsize * size
                elif tokens is not None:
                    row.append(float(tokens[at]))
                    at += 1
                else:
                    item = np.dtype(order + _TYPES[p[0]])
                    row.append(float(np.frombuffer(body, item, 1, at)[0]))
                    at += item.itemsize
            rows.append(row)
        if name == "vertex":
            points = np.array([[r[names.index(k)] if k in names else 0.0 for k in "xyz"] for r in rows], float).reshape(-1, 3)
        elif name == "face" and lists:
            place = next(i for i, p in enumerate(properties) if p[0] == "list")
            faces = [r[place] for r in rows]
    return points, faces


def parse_vtk(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Points and polygons of an ASCII legacy VTK file."""
    words = data.decode().split("\n", 4)[-1].split()
    points, faces, at = np.zeros((0, 3)), [], 0
    while at < len(words):
        if words[at].upper() == "POINTS":
            n = int(words[at + 1])
            points = np.array(words[at + 3 : at + 3 + 3 * n], float).reshape(-1, 3)
            at += 3 + 3 * n
        elif words[at].upper() == "POLYGONS":
            n, at = int(words[at + 1]), at + 3
            for _ in range(n):
                size = int(words[at])
                faces.append([int(v) for v in words[at + 1 : at + 1 + size]])
                at += 1 + size
        else:
            at += 1
    return points, faces


#: The line by which a file says that it is binary.
_BINARY = {"off": "^OFF BINARY", "ply": "^format binary"}
_PARSERS = {"off": parse_off, "stl": parse_stl, "ply": parse_ply, "vtk": parse_vtk}


def _whole(spark: SparkSession, path: str, parse, faces: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, key, data in zip(batch.column("path").to_pylist(), batch.column("mesh_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                points, polygons = parse(data)
                n = len(polygons) if faces else len(points)
                head = [pa.array([name] * n, pa.string()), pa.array([key] * n, pa.int64()), pa.array(np.arange(n))]
                if faces:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(polygons, pa.list_(pa.int64()))], ["path", "mesh_id", "fid", "vids"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, *(pa.array(points[:, i]) for i in range(3))], ["path", "mesh_id", "vid", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("mesh_id"), "content")
    return files.mapInArrow(run, _FACE if faces else _VERTEX)


def read_mesh(spark: SparkSession, path: str, kind: str | None = None, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of mesh files, by `kind` or else the lower-cased extension of the path. With `parts`, a folder of
    OBJ files, or of OFF, PLY, STL or VTK files as text, is one mesh cut into ordered files."""
    kind = kind or path.rstrip("/*").rpartition(".")[2].lower()
    if kind == "obj":
        return read_obj(spark, path, parts)
    if kind in _BINARY and (parts or spark.read.text(path).where(F.col("value").rlike(_BINARY[kind])).isEmpty()):
        return (read_off if kind == "off" else read_ply)(spark, path, parts)
    if parts and kind in ("stl", "vtk"):
        return (read_stl if kind == "stl" else read_vtk)(spark, path, parts)
    if kind not in _PARSERS or parts:
        raise ValueError(f"no reader for .{kind} files" + " in parts" * parts)
    return _whole(spark, path, _PARSERS[kind], False), _whole(spark, path, _PARSERS[kind], True)


def read_points(spark: SparkSession, path: str, kind: str | None = None, parts: bool = False) -> DataFrame:
    """points (path, cloud_id, pid, x, y, z) of any readable file."""
    kind = kind or path.rstrip("/*").rpartition(".")[2].lower()
    if kind in ("xyz", "agi"):
        return (read_xyz if kind == "xyz" else read_agi)(spark, path, parts).select("path", "cloud_id", "pid", "x", "y", "z")
    v, _ = read_mesh(spark, path, kind, parts)
    return v.select("path", F.col("mesh_id").alias("cloud_id"), F.col("vid").alias("pid"), "x", "y", "z")
