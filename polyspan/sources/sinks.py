"""Writers of meshes as ordered lines that Spark's text sink writes.

Every element becomes a line with a sort key. A mesh is one file, whose lines one task sorts, or with `parts` a folder of
files by ranges of that key, which together in the order of their names are the file. Meshes are written in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.shapes import numbered


def _number(x: Column) -> Column:
    return x.cast("double").cast("string")


def _written(lines: DataFrame, path: str, parts: bool) -> None:
    """lines (mesh_id, part, at, line) as path/mesh_id=.../part-*.txt."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "mesh_id", "part", "at") if parts else lines.repartition(n, "mesh_id")
    dealt.sortWithinPartitions("mesh_id", "part", "at").select("mesh_id", "line").write.partitionBy("mesh_id").mode("overwrite").text(path)


def _dense(vertices: DataFrame) -> DataFrame:
    """Vertices with `number`, their rank by vid within the mesh: the rank among all less the mesh's first."""
    ranked = cut(numbered(vertices, ["mesh_id", "vid"], "number"))
    firsts = cut(ranked.groupBy("mesh_id").agg(F.min("number").alias("_first")))
    return ranked.join(firsts, "mesh_id").withColumn("number", F.col("number") - F.col("_first")).drop("_first")


def _renumbered(faces: DataFrame, dense: DataFrame) -> DataFrame:
    """Faces (mesh_id, fid, numbers) with vertex numbers in corner order."""
    c = faces.select("mesh_id", "fid", F.posexplode("vids").alias("k", "vid")).join(dense.select("mesh_id", "vid", "number"), ["mesh_id", "vid"])
    return c.groupBy("mesh_id", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "number"))), lambda s: s["number"]).alias("numbers"))


def _line(part: int, at: str, text: Column):
    return [F.col("mesh_id"), F.lit(part).alias("part"), F.col(at).cast("long").alias("at"), text.alias("line")]


def _xyz() -> Column:
    return F.concat_ws(" ", *(_number(F.col(k)) for k in "xyz"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    dense = _dense(vertices)
    v = dense.select(*_line(1, "number", F.concat(F.lit("v "), _xyz())))
    f = _renumbered(faces, dense).select(*_line(2, "fid", F.concat(F.lit("f "), F.array_join(F.transform("numbers", lambda n: (n + 1).cast("string")), " "))))
    return v.unionByName(f)


def _counted(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(F.count("*").alias("n")).join(faces.groupBy("mesh_id").agg(F.count("*").alias("m"), F.sum(F.size("vids")).alias("s")), "mesh_id", "left").select("mesh_id", "n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("s", F.lit(0)).alias("s"), F.lit(0).alias("zero"))


def _polygon() -> Column:
    return F.concat_ws(" ", F.size("numbers").cast("string"), F.array_join(F.transform("numbers", lambda n: n.cast("string")), " "))


def off_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    dense = _dense(vertices)
    head = _counted(vertices, faces).select(*_line(0, "zero", F.concat_ws(" ", F.lit("OFF"), "n", "m", F.lit("0"))))
    return head.unionByName(dense.select(*_line(1, "number", _xyz()))).unionByName(_renumbered(faces, dense).select(*_line(2, "fid", _polygon())))


def ply_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    dense = _dense(vertices)
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), "n", F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement face "), "m", F.lit("\nproperty list uchar int vertex_indices\nend_header"))
    return _counted(vertices, faces).select(*_line(0, "zero", head)).unionByName(dense.select(*_line(1, "number", _xyz()))).unionByName(_renumbered(faces, dense).select(*_line(2, "fid", _polygon())))


def vtk_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    dense = _dense(vertices)
    count = _counted(vertices, faces)
    head = F.concat(F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS "), "n", F.lit(" double"))
    middle = F.concat_ws(" ", F.lit("POLYGONS"), "m", F.col("m") + F.col("s"))
    return count.select(*_line(0, "zero", head)).unionByName(dense.select(*_line(1, "number", _xyz()))).unionByName(count.select(*_line(2, "zero", middle))).unionByName(_renumbered(faces, dense).select(*_line(3, "fid", _polygon())))


def stl_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles only; normals follow from the corners."""
    from ..functions import vector as V
    from ..operators.mesh import placed

    t = placed(faces.where(F.size("vids") == 3).select("mesh_id", "fid", *(F.col("vids")[k].alias(f"v{k}") for k in range(3))), vertices)
    n = V.normalize(V.cross(V.minus(V.vec("b"), V.vec("a")), V.minus(V.vec("c"), V.vec("a"))))
    corner = lambda p: F.concat(F.lit("    vertex "), F.concat_ws(" ", *(_number(F.col(p + k)) for k in "xyz")))
    facet = F.concat_ws("\n", F.concat(F.lit("  facet normal "), F.concat_ws(" ", *map(_number, n))), F.lit("  outer loop"), corner("a"), corner("b"), corner("c"), F.lit("  endloop"), F.lit("  endfacet"))
    ends = vertices.select("mesh_id", F.lit(0).alias("zero")).distinct()
    return ends.select(*_line(0, "zero", F.lit("solid mesh"))).unionByName(t.select(*_line(1, "fid", facet))).unionByName(ends.select(*_line(2, "zero", F.lit("endsolid mesh"))))


def xyz_lines(vertices: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    return _dense(vertices).select(*_line(0, "number", _xyz()))


_WRITERS = {"obj": obj_lines, "off": off_lines, "ply": ply_lines, "vtk": vtk_lines, "stl": stl_lines, "xyz": xyz_lines}


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, kind: str, parts: bool = False) -> None:
    """Meshes (mesh_id, vid, x, y, z) and (mesh_id, fid, vids) as text files of a format, a folder a mesh: one file each, or
    with `parts` ordered files, which `text_meshes` reads with `parts` too."""
    if kind not in _WRITERS:
        raise ValueError(f"no writer for .{kind} files")
    _written(_WRITERS[kind](vertices, faces), path, parts)


def _curve_points(curves: DataFrame, closed: bool) -> DataFrame:
    """Points (curve_id, seq, x, y [, z]) as (mesh_id, number, x, y, z, to): `number` over all curves, `to` that of the
    next point of the curve, or null at its end; the first point follows the last of a closed curve."""
    at = curves if "z" in curves.columns else curves.withColumn("z", F.lit(0.0))
    ranked = cut(numbered(at.select("curve_id", "seq", "x", "y", "z"), ["curve_id", "seq"], "number"))
    ends = ranked.groupBy("curve_id").agg(F.min("number").alias("_a"), F.max("number").alias("_z"))
    after = F.when(F.col("number") < F.col("_z"), F.col("number") + 1).when(F.lit(closed) & (F.col("_z") > F.col("_a")), F.col("_a"))
    return ranked.join(ends, "curve_id").select(F.lit(0).cast("long").alias("mesh_id"), "curve_id", "number", "x", "y", "z", after.alias("to"))


def curve_ply_lines(curves: DataFrame, closed: bool = False) -> DataFrame:
    """All curves as one PLY of vertices and edges."""
    p = _curve_points(curves, closed)
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), "n", F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement edge "), "m", F.lit("\nproperty int vertex1\nproperty int vertex2\nend_header"))
    count = p.groupBy("mesh_id").agg(F.count("*").alias("n"), F.count("to").alias("m"), F.lit(0).alias("zero"))
    edges = p.where("to is not null").select(*_line(2, "number", F.concat_ws(" ", F.col("number").cast("string"), F.col("to").cast("string"))))
    return count.select(*_line(0, "zero", head)).unionByName(p.select(*_line(1, "number", _xyz()))).unionByName(edges)


def polyline_obj_lines(curves: DataFrame, closed: bool = False) -> DataFrame:
    """All curves as one OBJ, an l line a curve."""
    p = _curve_points(curves, closed)
    spans = p.groupBy("mesh_id", "curve_id").agg(F.min("number").alias("a"), F.max("number").alias("z"), F.lit(0).alias("zero"))
    ids = F.transform(F.sequence(F.col("a") + 1, F.col("z") + 1), lambda n: n.cast("string"))
    ids = F.concat(ids, F.array((F.col("a") + 1).cast("string"))) if closed else ids
    lines = spans.select(*_line(2, "a", F.concat(F.lit("l "), F.array_join(ids, " "))))
    return p.select(*_line(1, "number", F.concat(F.lit("v "), _xyz()))).unionByName(lines)


def vti_lines(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """A whole grid (ix, iy, iz, value) from node 0 on as image data, a value a line; missing nodes are nan."""
    size = grid.agg(*((F.max("i" + k) + 1).alias("n" + k) for k in "xyz")).select(F.lit(0).cast("long").alias("mesh_id"), F.lit(0).alias("zero"), "nx", "ny", "nz")
    size = cut(size.where("nx is not null"))  # one row
    span = F.concat_ws(" ", *(x for k in "xyz" for x in (F.lit("0"), (F.col("n" + k) - 1).cast("string"))))
    head = F.concat(F.lit('<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian">\n<ImageData WholeExtent="'), span, F.lit(f'" Origin="0 0 0" Spacing="{cell} {cell} {cell}">\n<Piece Extent="'), span, F.lit('">\n<PointData Scalars="value">\n<DataArray type="Float64" Name="value" format="ascii">'))
    tail = F.lit("</DataArray>\n</PointData>\n<CellData>\n</CellData>\n</Piece>\n</ImageData>\n</VTKFile>")
    nodes = size.select("mesh_id", "nx", "ny", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz").cast("long") - 1)).alias("iz")).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny").cast("long") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx").cast("long") - 1)))
    at = nodes.join(grid, ["ix", "iy", "iz"], "left").withColumn("at", (F.col("iz") * F.col("ny") + F.col("iy")) * F.col("nx") + F.col("ix"))
    value = F.coalesce(_number(F.col("value")), F.lit("nan"))
    return size.select(*_line(0, "zero", head)).unionByName(at.select(*_line(1, "at", value))).unionByName(size.select(*_line(2, "zero", tail)))


def write_lines(lines: DataFrame, path: str, parts: bool = True) -> None:
    """Lines of one of the functions above as ordered files."""
    _written(lines, path, parts)


def histogram_lines(bins: DataFrame, n_bins: int, low: float, high: float) -> DataFrame:
    """(bin, line): a histogram (bin, n) as text, its first bin open below and its last one above."""
    width = (high - low) / n_bins
    left = F.when(F.col("bin") == 0, F.lit("(-inf")).otherwise(F.concat(F.lit("["), _number(low + F.col("bin") * width)))
    right = F.when(F.col("bin") == n_bins - 1, F.lit("+inf)")).otherwise(F.concat(_number(low + (F.col("bin") + 1) * width), F.lit(")")))
    return bins.select("bin", F.concat(left, F.lit(".. "), right, F.lit(" : "), F.col("n").cast("string")).alias("line"))
