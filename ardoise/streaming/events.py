"""Structured Streaming over the events table: windows with late data, sessions, idempotent arrival, statistics per batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.session import keep, shared_folder, table


def read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream of its own schema."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per type and tumbling window; events later than ``late`` are dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def once(arrivals: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each entry once, however often it arrives within ``late``."""
    return arrivals.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_available(df: DataFrame, handle: Callable[[DataFrame, int], None], name: str) -> None:
    """Process everything that is there, batch by batch, and stop; a restart goes on where this ended."""
    folder = f"{shared_folder(df.sparkSession)}/flux-{name}"
    q = df.writeStream.outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()


def complete(df: DataFrame, name: str) -> DataFrame:
    """The complete result of a streaming aggregate over what is there now, as a written table that each batch replaces."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/flux-{name}-{uuid.uuid4().hex}"
    keep(spark, base)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table")

    q = df.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/points").trigger(availableNow=True).foreachBatch(replace).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table")
