"""Windowed counts over a stream of events, with a bound on lateness. The same plan runs over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.catalog import schema


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema("events"))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Count and sum of values for each window and type. ``late`` closes windows that far behind the newest event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy(F.window("at", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events that are less than a gap apart. ``late`` closes those that ended that far before the newest event, which bounds the state of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory") -> StreamingQuery:
    """Runs over what is there, then stops; started again with the same checkpoint it goes on where it was."""
    return df.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
