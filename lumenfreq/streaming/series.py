"""Event streams to regular series: event-time windows with a watermark, for Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files under a path as a stream of events."""
    schema = spark.read.parquet(path).schema
    # A file source lists folders and patterns: the pattern names this one file or folder.
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", ts: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """(name, start, y, n): sums of each window and channel.  Rows later than the watermark are dropped; the state holds open windows only."""
    x = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = x.groupBy(F.window("__ts", width).alias("w"), F.col(name).alias("name")).agg(F.sum(value).alias("y"), F.count("*").alias("n"))
    return out.select("name", F.col("w.start").alias("start"), "y", "n")


def _shared(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lumenfreq-")
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that has arrived, written to the shared folder batch by batch, exactly once, and read back."""
    spark = stream.sparkSession
    at = _shared(spark)
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, hour, y, n) of all closed hours: those that end at or before the latest event less the watermark's hour."""
    x = run_to_table(windowed(read_events(spark, f"{sf_dir}/events.parquet")))
    return x.select("name", F.floor(F.unix_micros("start") / 3_600_000_000).cast("long").alias("hour"), (F.round("y", 6) + F.lit(0.0)).alias("y"), F.col("n").cast("long").alias("n"))


#: The same for a finished table.
HOURLY_SQL = """
WITH e AS (SELECT event_type AS name, CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 3600000000e0) AS BIGINT) AS hour, value, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
m AS (SELECT max(us) - 3600000000 AS mark FROM e)
SELECT name, hour, round(sum(value), 6) + CAST(0 AS DOUBLE) AS y, CAST(count(*) AS BIGINT) AS n FROM e CROSS JOIN m WHERE (hour + 1) * 3600000000 <= (mark // 1000) * 1000 GROUP BY name, hour"""
