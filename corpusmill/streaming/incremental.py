"""A corpus that grows: new files are counted once, whatever is run again.

Each micro-batch writes its own partial counts under its batch number, replacing what an earlier attempt left, so a batch that
runs twice counts once. Reading sums the parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, count: Callable[[DataFrame], DataFrame], files_per_batch: int = 64) -> None:
    """Counts the files of source that weren't counted yet and ends. count gives (keys, occurrence_count) of a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("occurrence_count").cast("long").alias("occurrence_count"))


def metric_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, tag, n, mean, least) of each window of event time; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least")).select(F.col("window.start").alias("start"), F.col("event_type").alias("tag"), "n", "mean", "least")
