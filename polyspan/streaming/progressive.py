"""Progressive sampling and windowed folds as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling


def sample_stream(points: DataFrame, n: int, folder: str, seed: int = 0) -> DataFrame:
    """Drain a stream of points and keep the n with the smallest hash of pid. Each micro-batch merges its own n with
    the state, writes a new state table and a progress row; a batch that is tried again writes the same table again."""
    spark = points.sparkSession
    schema = points.schema

    def step(batch: DataFrame, number: int) -> None:
        own = sampling.uniform(batch, n, seed).drop("u")
        if number > 0:
            own = own.unionByName(spark.read.schema(schema).parquet(f"{folder}/state-{number - 1}"))
        sampling.uniform(own, n, seed).drop("u").write.mode("overwrite").parquet(f"{folder}/state-{number}")
        batch.agg(F.count("*").alias("n_points")).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")

    query = points.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{folder}/progress").agg(F.max("batch")).first()[0]  # a run without new rows has no batch of its own
    return spark.read.schema(schema).parquet(f"{folder}/state-{last}")


def window_ranges(events: DataFrame, width: str, late: str, folder: str) -> DataFrame:
    """(key, start, n, low, high) of a stream (key, ts, value) by tumbling windows; events later than `late` are left
    out. The table is updated by each micro-batch, the newest row of a window counts."""
    spark = events.sparkSession
    folded = events.withWatermark("ts", late).groupBy("key", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))

    def step(batch: DataFrame, number: int) -> None:
        batch.select("key", F.col("w.start").alias("start"), "n", "low", "high", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/out/part-{number}")

    query = folded.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/*")
    return rows.groupBy("key", "start").agg(F.max_by(F.struct("n", "low", "high"), "batch").alias("r")).select("key", "start", "r.*")
