"""Meshes written to files of each format and read again, and the progressive sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks, text_meshes
from ..streaming import progressive
from . import bindings as B
from .registry import query
from .scalar_queries import r6, sql6

_CORNERS = "SELECT vid, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, (SELECT count(*) FROM faces WHERE vid IN (v0, v1, v2)) AS n_faces FROM verts"


def _written(spark, sf_dir, kind: str, parts: bool = False):
    v, f = B.heightfield(spark, sf_dir)
    path = B.shared_path(spark, kind)
    sinks.write_mesh(v, f.select("mesh_id", "fid", F.array("v0", "v1", "v2").alias("vids")), path, kind, parts)
    return path + "/*/*.txt"


_PARTS = ("obj", "off", "ply", "vtk")


def _roundtrip(kind: str):
    @query(f"{kind}_roundtrip", f"WITH {B.MESH} {_CORNERS}")
    def run(spark, sf_dir):
        v, f = text_meshes.read_mesh(spark, _written(spark, sf_dir, kind, kind in _PARTS), kind, kind in _PARTS)
        uses = f.select(F.explode("vids").alias("vid")).groupBy("vid").agg(F.count("*").alias("n_faces"))
        return v.join(uses, "vid", "left").select("vid", *((F.round(k, 4) + 0.0).alias(k) for k in "xyz"), F.coalesce("n_faces", F.lit(0)).cast("long").alias("n_faces"))

    run.__doc__ = f"The heightfield as {kind.upper()} and back: vertices with the number of their faces."
    return run


for _kind in ("obj", "off", "ply", "vtk"):
    _roundtrip(_kind)


@query("stl_roundtrip", f"WITH {B.MESH} SELECT count(*) AS n_faces, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM (SELECT (ax+bx+cx)/3 AS x, (ay+by+cy)/3 AS y FROM tris)")
def stl_roundtrip(spark, sf_dir):
    """STL keeps triangles only: their number and the sum of their centres."""
    v, f = text_meshes.read_mesh(spark, _written(spark, sf_dir, "stl", True), "stl", True)
    c = f.select("fid", F.explode("vids").alias("vid")).join(v, "vid")
    return c.agg(F.count_distinct("fid").alias("n_faces"), F.round(F.sum("x") / 3, 3).alias("x"), F.round(F.sum("y") / 3, 3).alias("y"))


@query("xyz_roundtrip", f"WITH {B.MESH} SELECT vid AS pid, {', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in 'xyz')} FROM verts")
def xyz_roundtrip(spark, sf_dir):
    p = text_meshes.read_points(spark, _written(spark, sf_dir, "xyz", True), "xyz", True)
    return p.select("pid", *((F.round(k, 4) + 0.0).alias(k) for k in "xyz"))


_U = "CAST(('0x' || substr(md5(concat_ws(':', CAST(pid AS VARCHAR), '0')), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("progressive_sample", f"WITH p AS (SELECT event_id AS pid, CAST(value AS DOUBLE) AS x FROM events) SELECT pid, {sql6('x')} AS x FROM p ORDER BY {_U}, pid LIMIT 100")
def progressive_sample(spark, sf_dir):
    """A stream of points sampled as it arrives; the last state is that of a sample of all points."""
    points = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    state = progressive.sample_stream(points.select(F.col("event_id").alias("pid"), F.col("value").cast("double").alias("x")), 100, B.shared_path(spark, "progressive"))
    return state.select("pid", r6(F.col("x")).alias("x"))


@query("tumbling_boxes", f"SELECT CAST(user_id AS BIGINT) AS user_id, epoch_us(time_bucket(INTERVAL 1 day, ts)) // 1000000 AS day, count(*) AS n, {sql6('min(CAST(value AS DOUBLE))')} AS low, {sql6('max(CAST(value AS DOUBLE))')} AS high FROM events GROUP BY 1, 2")
def tumbling_boxes(spark, sf_dir):
    """Value ranges by user and day over a stream with a watermark, read back when the stream has ended."""
    events = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    found = progressive.window_ranges(events.select(F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")), "1 day", "40 days", B.shared_path(spark, "windows"))
    return found.select(F.col("key").alias("user_id"), F.unix_seconds("start").alias("day"), "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))
