"""Streaming forms: routing, windowed counts and the ring of recent events.

The reference semantics are batch; windows and watermarks are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import firewall

WATERMARK, WINDOW = "1 hour", "1 day"


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def routed(lines: DataFrame, raw: str = "raw", limits: firewall.Limits = firewall.Limits()) -> DataFrame:
    """The gate's columns; the same code as in batch."""
    return firewall.inspect(lines, raw, limits)


def windowed(events: DataFrame, time: str, key: str, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Counts by window and key of an event-time stream, or of a batch."""
    at = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("_at", watermark)
    return at.groupBy(F.window("_at", window).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def deduplicated(events: DataFrame, time: str, key: str, watermark: str = WATERMARK) -> DataFrame:
    """Each event id once within the watermark; equal bytes under other ids stay."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def route_to(stream: DataFrame, paths: dict[str, str], checkpoint: str):
    """One query, one write per topic."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        for topic, path in paths.items():
            batch.where(F.col("topic") == topic).write.mode("append").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run an appending stream to the end of what is there and return what it wrote, as Parquet under the folder."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_totals(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """As drain() for running totals: each batch's changed rows are kept, and the last of each key counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/_batch_number={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in values)).select(*stream.columns)


def ring(stream: DataFrame, order: str, folder: str, n: int = 5000) -> DataFrame:
    """The latest n events of a stream: each batch keeps the n latest of itself and the ring so far, one version after the other."""
    spark, last = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
        path = f"{folder}/ring/{number}"
        held.unionByName(batch).orderBy(F.desc(order)).limit(n).write.mode("overwrite").parquet(path)
        last.append(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
