"""Log compaction: the latest record of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import TP


def latest_offsets(records: DataFrame) -> DataFrame:
    """(topic, partition, key, latest): a partial maximum before the shuffle, so a hot key is one row a task."""
    keyed = records.filter("key is not null")
    if "is_control" in records.columns:
        keyed = keyed.filter(~F.col("is_control"))
    return keyed.groupBy(*TP, "key").agg(F.max("log_offset").alias("latest"))


def latest_per_key(records: DataFrame) -> DataFrame:
    """The whole latest record of each key of each partition."""
    last = latest_offsets(records).withColumnsRenamed({"key": "_key", "latest": "log_offset"})
    return records.join(last, [*TP, "log_offset"], "left_semi")


def purged_keys(records: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Keys whose latest record is a tombstone (null value, not an empty one) older than the retention."""
    last = latest_per_key(records)
    return last.filter(F.col("value").isNull() & (F.lit(now_ms) - F.col("ts_ms") > retention_ms)).select(*TP, "key")


def judged(records: DataFrame, now_ms: int | None = None, retention_ms: int | None = None) -> DataFrame:
    """Adds survives, for records with is_active_segment: active ones do; older ones if they have no key or are their key's latest and it isn't purged.

    Records without a key are in no join. A hot key meets one row of the other side, so a skew join may split it.
    """
    keyless = records.filter("key is null").withColumn("survives", F.lit(True))
    records = records.filter("key is not null")
    x = records.join(latest_offsets(records), [*TP, "key"], "left")
    keep = F.col("log_offset") == F.col("latest")
    if "is_control" in records.columns:
        keep = keep | F.col("is_control")
    if retention_ms is not None:
        gone = purged_keys(records, now_ms, retention_ms).withColumn("_purged", F.lit(True))
        x = x.join(gone, [*TP, "key"], "left")
        keep = keep & F.col("_purged").isNull()
    return x.withColumn("survives", F.col("is_active_segment") | keep).drop("latest", "_purged").unionByName(keyless)


def dirty_ratios(judged_records: DataFrame) -> DataFrame:
    """Of each older segment: total and discarded bytes and their ratio."""
    x = judged_records.filter(~F.col("is_active_segment")).groupBy(*TP, "segment_base")
    x = x.agg(F.sum("encoded_size").alias("total_bytes"), F.sum(F.when(~F.col("survives"), F.col("encoded_size")).otherwise(0)).alias("discarded_bytes"))
    return x.withColumn("dirty_ratio", F.col("discarded_bytes") / F.col("total_bytes"))


def compact(records: DataFrame, min_dirty: float = 0.5, most: int = 4, now_ms: int | None = None, retention_ms: int | None = None) -> DataFrame:
    """The log after one compaction: of each partition the first `most` segments that are dirty enough are rewritten."""
    j = judged(records, now_ms, retention_ms)
    dirty = dirty_ratios(j).filter((F.col("discarded_bytes") > 0) & (F.col("dirty_ratio") >= min_dirty))
    rank = F.row_number().over(Window.partitionBy(*TP).orderBy("segment_base"))  # a row a segment
    rewritten = dirty.withColumn("_n", rank).filter(F.col("_n") <= most).select(*TP, "segment_base", F.lit(True).alias("_rewrite"))
    x = j.join(rewritten, [*TP, "segment_base"], "left")
    return x.filter(F.col("survives") | F.col("_rewrite").isNull()).drop("survives", "_rewrite")
