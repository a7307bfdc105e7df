"""Streams: windowed event counts with a watermark, and incremental ingestion without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.registry import key_of
from shelfmark.session import is_file, new_path


def event_windows(events: DataFrame, size: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events and their values by window and type; works on a stream and on a table alike."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    grouped = rows.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total")


def ingested_once(deliveries: DataFrame, key: str = "document_id", time: str = "received_at", lateness: str = "30 days") -> DataFrame:
    """The keys of a stream of deliveries, each once within `lateness` of its first one, without case and outer spaces.

    State is one key until the watermark has passed it; rows without key or time are not ingested.
    """
    rows = deliveries.select(key_of(F.col(key)).alias(key), F.col(time).cast("timestamp").alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    return rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark([key]).select(key)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A finite stream run to its end into a table of the shared folder."""
    spark = stream.sparkSession
    base = new_path(spark, name)
    if mode == "complete":

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/table")

        writer = stream.writeStream.foreachBatch(save).outputMode("complete")
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{base}/table").outputMode("append")
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` as a stream of its files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_file(spark, path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)
