"""Streams: windowed counts of events and an append-only log. An extension; batch tables are the model elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.runtime import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; state is kept for as long as events may be late."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all there is now, as a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a complete result replaces the one before; of others each batch has a place of its own, written again if the batch is
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def append_log(lines: DataFrame, path: str) -> None:
    """``[level] message | url=...`` lines appended to a log."""
    lines.select(F.concat(F.lit("["), "level", F.lit("] "), "message", F.lit(" | url="), "url").alias("value")).write.mode("append").text(path)
