"""W1 as a stream: daily event counts and values per type.

``readStream`` over the event files, a one-day watermark on the event time,
a one-day tumbling window per event type, written by ``foreachBatch`` as
append-only versions (each micro-batch tags its rows with the batch id).
Reading keeps the newest version of each window, so a batch replayed after
a failure (same id, same rows) changes nothing.  Output and checkpoint live
under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from claimscope.session import scratch_path

EVENT_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()), StructField("event_type", StringType()),
    StructField("value", DoubleType()), StructField("props", StringType()),
])


def daily_rollup_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The streaming aggregation itself (works on a streaming DataFrame).

    ``ts`` is a wall-clock (``timestamp_ntz``) time read as UTC; the
    watermark needs an instant, so it is converted by epoch seconds, which
    does not depend on the session time zone."""
    return (events.withColumn("event_time", F.timestamp_seconds(F.unix_timestamp("ts")))
            .withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 day").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("total_value")))


def run_daily_rollup(spark: SparkSession, source_glob: str, out: str | None = None,
                     max_files_per_trigger: int = 16) -> DataFrame:
    """Run the stream over all available files (``availableNow``) and return
    the current roll-up as a batch DataFrame."""
    out = out or scratch_path(spark, f"stream-daily-{uuid.uuid4().hex}")
    stream = (spark.readStream.schema(EVENT_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_glob))
    agg = daily_rollup_stream(stream)

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("append").parquet(f"{out}/data"))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_rollup(spark, out)


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    """Newest version of every (day, event_type) window."""
    v = spark.read.parquet(f"{out}/data")
    latest = v.groupBy("w", "event_type").agg(
        F.max_by(F.struct("event_count", "total_value"), "batch_id").alias("r"))
    day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return latest.select(day.alias("day"), "event_type",
                         F.col("r.event_count").alias("event_count"),
                         F.round("r.total_value", 4).alias("total_value"))
