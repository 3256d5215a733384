"""Retention and truncation; segments are rows (topic, partition, segment_base, size_bytes, newest_ms, is_active_segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import TP
from tidelog.operators.ranking import WIDTH, ceiling_join, floor_join, reached, running_max, running_sum
from tidelog.sources.shared import cut


def segment_table(records: DataFrame) -> DataFrame:
    x = records.groupBy(*TP, "segment_base")
    return x.agg(F.sum("encoded_size").alias("size_bytes"), F.max("ts_ms").alias("newest_ms"), F.max("is_active_segment").alias("is_active_segment"), F.max("log_offset").alias("last_offset"))


def expired_by_time(segments: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    return segments.filter(~F.col("is_active_segment") & (F.col("newest_ms") < now_ms - retention_ms))


def expired_by_size(segments: DataFrame, limit: int) -> DataFrame:
    """Oldest segments while what is left, the active one included, is above the limit."""
    x = running_sum(segments, TP, "segment_base", "size_bytes", "remaining", backwards=True)
    return x.filter(~F.col("is_active_segment") & (F.col("remaining") > limit))


def retain(segments: DataFrame, now_ms: int, retention_ms: int | None, limit: int | None) -> DataFrame:
    """Segments that stay under both rules."""
    gone = [g for g in (expired_by_time(segments, now_ms, retention_ms) if retention_ms is not None else None, expired_by_size(segments, limit) if limit is not None else None) if g is not None]
    for g in gone:
        segments = segments.join(g.select(*TP, "segment_base"), [*TP, "segment_base"], "left_anti")
    return segments


def trimmed_before(segments: DataFrame, offset: int) -> DataFrame:
    """Segments that stay when all before an offset go: those whose next segment begins above it, and the active one."""
    nxt = F.lead("segment_base").over(Window.partitionBy(*TP).orderBy("segment_base"))  # a row a segment
    return segments.withColumn("next_base", nxt).filter(F.col("next_base").isNull() | (F.col("next_base") > offset))


def truncate_after(batches: DataFrame, offset: int) -> DataFrame:
    """Whole batches that end before the offset."""
    return batches.filter(F.col("last_offset") < offset)


def truncated_ends(batches: DataFrame, ends: DataFrame, offset: int) -> DataFrame:
    """The ends (topic, partition, leo, hw) after a truncation: a batch goes as a whole, so the log ends where the last
    batch that stays does, and the high watermark does not stay above that. An offset at or behind the end changes nothing."""
    kept = truncate_after(batches, offset).groupBy(*TP).agg((F.max("last_offset") + 1).alias("_end"))
    x = ends.join(kept, TP, "left")
    leo = F.when(F.lit(offset) >= F.col("leo"), F.col("leo")).otherwise(F.coalesce("_end", F.lit(0)))
    return x.select(*TP, leo.cast("long").alias("leo"), F.least("hw", leo).cast("long").alias("hw"))


def roll_segments(records: DataFrame, max_bytes: int, segment_ms: int | None = None) -> DataFrame:
    """(topic, partition, segment_base, n_records, size_bytes) of segments that roll before a record would exceed
    max_bytes, or that comes segment_ms or more after the segment's first one (by the latest time so far).

    Where a segment begins depends on where the one before began. For every record the one that would begin the next
    segment is looked up along the sums of sizes and the latest times; the path of those is the segments.
    """
    x = running_sum(cut(records.select(*TP, "log_offset", "encoded_size", "ts_ms")), TP, "log_offset", "encoded_size", "_upto")
    if segment_ms is not None:
        x = running_max(x, TP, "log_offset", "ts_ms", "_now")
    rows = cut(x)  # read again by each lookup
    x = rows.withColumn("_full", F.greatest(F.col("_upto") - F.col("encoded_size") + F.lit(max_bytes), F.col("_upto")) + 1)
    x = ceiling_join(x, rows.select(*TP, "_upto", F.col("log_offset").alias("_by_size")), TP, "_full", "_upto", ["_by_size"], WIDTH * 64)
    if segment_ms is None:
        x = x.withColumn("_next", F.col("_by_size"))
    else:  # looked up once a rise and passed on by offset: any number of rows may share a latest time
        rises = cut(rows.groupBy(*TP, "_now").agg(F.min("log_offset").alias("_rise"))).withColumn("_old", F.col("_now") + F.lit(segment_ms))
        rises = ceiling_join(rises, rises.select(*TP, "_now", F.col("_rise").alias("_by_time")), TP, "_old", "_now", ["_by_time"], WIDTH * 64)
        x = floor_join(cut(x), rises, TP, "log_offset", "_rise", ["_by_time"])
        x = x.withColumn("_next", F.least("_by_size", "_by_time"))
    x = x.withColumn("_first", F.col("_upto") == F.col("encoded_size"))
    bases = reached(x.select(*TP, "log_offset", "_next", "_first"), TP, "log_offset", "_next", "_first").withColumnRenamed("log_offset", "segment_base")
    return floor_join(rows.select(*TP, "log_offset", "encoded_size"), cut(bases), TP, "log_offset", "segment_base", ["segment_base"]).groupBy(*TP, "segment_base").agg(F.count(F.lit(1)).alias("n_records"), F.sum("encoded_size").alias("size_bytes"))
