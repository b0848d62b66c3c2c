"""The given tables read as geometry: clouds, curves, grids and meshes; and the same as SQL for DuckDB."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points (cloud_id, pid, x, y, z) of `embeddings`, one cloud a label."""
    at = lambda i: F.col("embedding")[i].cast("double") * 8
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("pid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


CLOUD = "SELECT CAST(label AS BIGINT) AS cloud_id, vec_id AS pid, CAST(embedding[1] AS DOUBLE) * 8 AS x, CAST(embedding[2] AS DOUBLE) * 8 AS y, CAST(embedding[3] AS DOUBLE) * 8 AS z FROM embeddings"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangle a row of `embeddings`: corners a, b, c from its first nine values."""
    at = lambda i: F.col("embedding")[i].cast("double")
    names = [p + k for p in "abc" for k in "xyz"]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), *(at(i).alias(n) for i, n in enumerate(names)), *(at(9 + i).alias(n) for i, n in enumerate(("px", "py", "pz", "dx", "dy", "dz"))))


TRIANGLES = "SELECT vec_id AS fid, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate([p + k for p in "abc" for k in "xyz"] + ["px", "py", "pz", "dx", "dy", "dz"])) + " FROM embeddings"


def big_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points (pid, line, x, y, z) of `lineitem`."""
    of = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("pid"), F.col("l_linenumber").cast("long").alias("line"), of("l_quantity").alias("x"), (of("l_extendedprice") / 1000).alias("y"), (of("l_discount") * 100).alias("z"))


BIG_CLOUD = "SELECT CAST(l_orderkey AS BIGINT) AS pid, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_discount AS DOUBLE) * 100 AS z FROM lineitem"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polyline (curve_id, seq, x, y) of `events`, one curve a user in the order of time: hours since 2024, value."""
    from pyspark.sql import Window

    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600e6
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("curve_id"), F.row_number().over(order).cast("long").alias("seq"), hours.alias("x"), F.col("value").cast("double").alias("y"))


CURVES = "SELECT CAST(user_id AS BIGINT) AS curve_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600e6 AS x, CAST(value AS DOUBLE) AS y FROM events"



def portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polyline (curve_id, seq, x, y): each user's values against the values after them, which crosses itself."""
    from pyspark.sql import Window

    c = curves(spark, sf_dir)
    after = F.lead("y").over(Window.partitionBy("curve_id").orderBy("seq"))
    return c.select("curve_id", "seq", F.col("y").alias("x"), after.alias("y")).where("y is not null")


PORTRAITS = f"SELECT * FROM (SELECT curve_id, seq, y AS x, lead(y) OVER (PARTITION BY curve_id ORDER BY seq) AS y FROM ({CURVES})) WHERE y IS NOT NULL"

def _mean(price: str, unit: int, name: str):
    """The mean price in whole units of cents, in ten thousands of these: integers up to the last step, so that no engine
    rounds it otherwise."""
    return (F.expr(f"sum(cast(round({price} * 100) as bigint)) div (count(1) * {unit})") / 1e4).alias(name)


def _mean_sql(price: str, unit: int) -> str:
    return f"CAST(sum(CAST(round({price} * 100) AS BIGINT)) // (count(*) * {unit}) AS DOUBLE) / 1e4"


#: The mesh grows with `orders`: some four of them a vertex.
DIMS = "dims AS (SELECT greatest(8, CAST(floor(sqrt(count(*) / 4.0)) AS BIGINT)) AS side FROM orders)"
SIDE = "(SELECT side FROM dims)"


def side(spark: SparkSession, sf_dir: str) -> int:
    return max(8, math.floor(math.sqrt(table(spark, sf_dir, "orders").count() / 4.0)))


def heightfield(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A regular triangle mesh over buckets of `orders`: vertices (mesh_id, vid, x, y, z), faces (mesh_id, fid, v0, v1, v2)."""
    n = side(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    ix, iy = F.pmod("o_orderkey", F.lit(n)), F.pmod(F.floor(F.col("o_orderkey") / n), F.lit(n))
    cells = orders.groupBy(ix.cast("long").alias("ix"), iy.cast("long").alias("iy")).agg(_mean("o_totalprice", 100, "z"))
    vertices = cells.select(F.lit(0).cast("long").alias("mesh_id"), (F.col("iy") * n + F.col("ix")).alias("vid"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "z")
    inner = cells.where((F.col("ix") < n - 1) & (F.col("iy") < n - 1)).select((F.col("iy") * n + F.col("ix")).alias("v"))
    two = F.array(F.struct((F.col("v") * 2).alias("fid"), F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") + n + 1).alias("v2")), F.struct((F.col("v") * 2 + 1).alias("fid"), F.col("v").alias("v0"), (F.col("v") + n + 1).alias("v1"), (F.col("v") + n).alias("v2")))
    faces = inner.select(F.explode(two).alias("f")).select(F.lit(0).cast("long").alias("mesh_id"), "f.*")
    return vertices, faces


MESH = f"""{DIMS},
cells AS (SELECT CAST(o_orderkey % {SIDE} AS BIGINT) AS ix, CAST((o_orderkey // {SIDE}) % {SIDE} AS BIGINT) AS iy, {_mean_sql('o_totalprice', 100)} AS z FROM orders GROUP BY 1, 2),
verts AS (SELECT iy * {SIDE} + ix AS vid, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, z FROM cells),
inner_cells AS (SELECT iy * {SIDE} + ix AS v FROM cells WHERE ix < {SIDE} - 1 AND iy < {SIDE} - 1),
faces AS (SELECT v * 2 AS fid, v AS v0, v + 1 AS v1, v + {SIDE} + 1 AS v2 FROM inner_cells UNION ALL SELECT v * 2 + 1, v, v + {SIDE} + 1, v + {SIDE} FROM inner_cells),
tris AS (SELECT fid, v0, v1, v2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
         FROM faces JOIN verts a ON a.vid = v0 JOIN verts b ON b.vid = v1 JOIN verts c ON c.vid = v2),
half AS (SELECT fid, v0 AS s, v1 AS e FROM faces UNION ALL SELECT fid, v1, v2 FROM faces UNION ALL SELECT fid, v2, v0 FROM faces),
edges AS (SELECT least(s, e) AS e0, greatest(s, e) AS e1, count(*) AS n_faces FROM half GROUP BY 1, 2)"""


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid (ix, iy, value): mean price of `lineitem` by quantity and discount."""
    of = lambda c: F.col(c).cast("double")
    key = [F.floor(of("l_quantity")).cast("long").alias("ix"), F.round(of("l_discount") * 100).cast("long").alias("iy")]
    return table(spark, sf_dir, "lineitem").groupBy(*key).agg(_mean("l_extendedprice", 10, "value"))


GRID = f"grid AS (SELECT CAST(floor(CAST(l_quantity AS DOUBLE)) AS BIGINT) AS ix, CAST(round(CAST(l_discount AS DOUBLE) * 100) AS BIGINT) AS iy, {_mean_sql('l_extendedprice', 10)} AS value FROM lineitem GROUP BY 1, 2)"


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid (ix, iy, iz, value): a cube of nodes that grows with `lineitem`, some eight rows a node."""
    of = table(spark, sf_dir, "lineitem")
    n = max(4, math.floor(math.pow(of.count() / 8.0, 1 / 3) + 1e-9))
    k = F.col("l_orderkey").cast("long") * 7 + F.col("l_linenumber").cast("long")
    at = [F.pmod(k, F.lit(n)), F.pmod(F.floor(k / n), F.lit(n)), F.pmod(F.floor(k / (n * n)), F.lit(n))]
    return of.groupBy(*(a.cast("long").alias("i" + x) for a, x in zip(at, "xyz", strict=True))).agg(_mean("l_extendedprice", 100, "value"))


_N3 = "(SELECT n FROM dims3)"
VOLUME = f"""dims3 AS (SELECT greatest(4, CAST(floor(pow(count(*) / 8.0, CAST(1 AS DOUBLE) / 3) + 1e-9) AS BIGINT)) AS n FROM lineitem),
vol AS (SELECT k % {_N3} AS ix, (k // {_N3}) % {_N3} AS iy, (k // ({_N3} * {_N3})) % {_N3} AS iz, {_mean_sql('l_extendedprice', 100)} AS value FROM (SELECT *, CAST(l_orderkey AS BIGINT) * 7 + CAST(l_linenumber AS BIGINT) AS k FROM lineitem) GROUP BY 1, 2, 3)"""


def shared_path(spark: SparkSession, what: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_checkpoints(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
