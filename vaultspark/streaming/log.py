"""The action log as a stream: append-only, parsed as it arrives, counted by action and time window with a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.operators.upserts import parse_log


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, action, target, note) of the lines of text files as they appear in a folder."""
    return parse_log(spark.readStream.format("text").load(folder))


def action_counts(log: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, action, n) by window; lines later than the watermark are left out."""
    at = log.withColumn("at", F.to_timestamp("ts", "yyyy-MM-dd HH:mm")).where("at is not null")
    return at.withWatermark("at", late).groupBy(F.window("at", window), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def append_log(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of log rows to a Parquet table, once for what is there now."""
    return lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
