"""Following a log of Parquet files with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import shared_home


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_home(spark)}/stream_{uuid.uuid4().hex[:12]}"


def follow(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The table's file, or the part files of its folder, as a stream, with ts as a timestamp that can carry a watermark."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    df = one.parquet(path) if parts else one.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # the filter sees names of files only
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and returns what it wrote; progress lies in the shared folder."""
    spark, home = stream.sparkSession, scratch(stream.sparkSession)
    started = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{home}/progress").option("path", f"{home}/rows").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def without_repeats(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the delay; state older than that is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions that ended before the watermark: keys, start_ms, end_ms, n."""
    x = events.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return x.select(*keys, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def tumbling(events: DataFrame, keys: list[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of windows that ended before the watermark: keys, start_ms, n."""
    x = events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return x.select(*keys, F.unix_millis("w.start").alias("start_ms"), "n")
