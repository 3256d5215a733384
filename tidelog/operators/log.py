"""Append, scans and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranking import WIDTH, ceiling_join, floor_join, reached, running_max, running_sum, sequence_numbers

TP = ["topic", "partition"]


def append(rows: DataFrame, arrival: str, ends: DataFrame | None = None) -> DataFrame:
    """Gives rows (topic, partition, ...) contiguous offsets in the order of arrival, after the log's ends (topic, partition, leo)."""
    rows = sequence_numbers(rows, TP, arrival, "log_offset")
    if ends is None:
        return rows
    return rows.join(ends.select(*TP, "leo"), TP, "left").withColumn("log_offset", F.col("log_offset") + F.coalesce("leo", F.lit(0))).drop("leo")


def up_to_high_watermark(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Only records below their partition's hw; ends has a row a partition."""
    return records.join(ends.select(*TP, "hw"), TP).filter("log_offset < hw").drop("hw")


def fetch_range(records: DataFrame, start: int, stop: int, ends: DataFrame | None = None) -> DataFrame:
    """Offsets start <= offset < stop of every partition, below the high watermark where ends are given."""
    found = records.filter((F.col("log_offset") >= start) & (F.col("log_offset") < stop))
    return found if ends is None else up_to_high_watermark(found, ends)


def fetch_batches(batches: DataFrame, start: int, max_bytes: int, ends: DataFrame) -> DataFrame:
    """Whole batches from the one that holds `start` on, below hw, as many as fit; the first one in any case."""
    x = batches.filter(F.col("last_offset") >= start).join(ends.select(*TP, "hw"), TP).filter("last_offset < hw").drop("hw")
    x = running_sum(x, TP, "base_offset", "size_bytes", "_total")
    return x.filter((F.col("_total") <= max_bytes) | (F.col("_total") == F.col("size_bytes"))).drop("_total")


def records_of(batches: DataFrame, records: DataFrame, start: int, of: int) -> DataFrame:
    """The records of fetched batches of `of` offsets each, without those before start."""
    numbered = records.filter(F.col("log_offset") >= start).withColumn("batch_no", F.floor(F.col("log_offset") / of))
    return numbered.join(batches.select(*TP, "batch_no"), [*TP, "batch_no"], "left_semi").drop("batch_no")


def fetch_since(records: DataFrame, ts_ms: int, ends: DataFrame) -> DataFrame:
    """Records at or after a time, below the high watermark."""
    return up_to_high_watermark(records.filter(F.col("ts_ms") >= ts_ms), ends)


def offset_for_time(records: DataFrame, targets: DataFrame, ends: DataFrame) -> DataFrame:
    """For targets (topic, partition, target_ms): the lowest offset at or after the time, else the end of the log.

    Records may be out of time order: the log's running minimum from the end is monotone, so the answer is the first
    record whose time reaches the target; it is looked up among the records that set a new running maximum.
    """
    peaks = running_max(records.select(*TP, "log_offset", "ts_ms"), TP, "log_offset", "ts_ms", "_before", include=False)
    peaks = peaks.filter(F.col("_before").isNull() | (F.col("ts_ms") > F.col("_before"))).select(*TP, (-F.col("ts_ms")).alias("_neg"), "log_offset")
    asked = targets.withColumn("_want", -F.col("target_ms"))
    lo, hi, n = records.agg(F.min("ts_ms"), F.max("ts_ms"), F.count(F.lit(1))).first()
    width = max(1, (hi - lo) * WIDTH // n) if n else 1  # about WIDTH records a run
    found = floor_join(asked, peaks, TP, "_want", "_neg", ["log_offset"], width)
    return found.join(ends.select(*TP, "leo"), TP).select(*TP, "target_ms", F.coalesce("log_offset", "leo").alias("log_offset"))


def sparse_index(records: DataFrame, every: int) -> DataFrame:
    return records.filter(F.col("log_offset") % every == 0).select(*TP, F.col("log_offset").alias("index_offset"), "ts_ms")


def byte_index(batches: DataFrame, interval: int) -> DataFrame:
    """The batches (topic, partition, base_offset, size_bytes) that get an index entry: the first of each partition, and
    each that comes when `interval` bytes or more have been written since the last entry."""
    x = running_sum(batches, TP, "base_offset", "size_bytes", "_upto").withColumn("_before", F.col("_upto") - F.col("size_bytes"))
    x = x.withColumn("_due", F.col("_before") + F.lit(interval))
    nxt = ceiling_join(x.select(*TP, "base_offset", "_before", "_due"), x.select(*TP, "_before", F.col("base_offset").alias("_next")), TP, "_due", "_before", ["_next"], WIDTH * 64)
    entries = reached(nxt, TP, "base_offset", "_next", "_before = 0")
    return batches.join(entries, [*TP, "base_offset"], "left_semi")


def seek(targets: DataFrame, index: DataFrame) -> DataFrame:
    """The nearest index entry at or before each target offset."""
    return floor_join(targets, index, TP, "log_offset", "index_offset", ["index_offset"])


def end_offsets(records: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """Earliest and latest (next) offset of each partition; partitions without records have 0 and 0."""
    x = records.groupBy(*TP).agg(F.min("log_offset").alias("earliest"), (F.max("log_offset") + 1).alias("latest"))
    if partitions is None:
        return x
    return partitions.select(*TP).join(x, TP, "left").fillna(0, ["earliest", "latest"])


def classify_appends(batches: DataFrame, arrival: str) -> DataFrame:
    """What a replica says to each batch as it arrives (whole numbers, distinct in a partition): appended if it begins
    where the log ends, already_applied if it ends before that, else gap (it begins later, or straddles the end).

    Only an appended batch moves the end. So the appended ones are a path: from the first arrival at offset 0 to the
    first later arrival that begins behind it, and so on.
    """
    x = batches.withColumn("_end", F.col("last_offset") + 1)
    begins = x.select(*TP, F.col("base_offset").alias("_end"), arrival, F.col(arrival).alias("_next"))
    links = ceiling_join(x.select(*TP, "_end", "base_offset", arrival), begins, [*TP, "_end"], arrival, arrival, ["_next"])
    first = links.filter("base_offset = 0").groupBy(*TP).agg(F.min(arrival).alias(arrival), F.lit(True).alias("_first"))
    path = reached(links.join(first, [*TP, arrival], "left"), TP, arrival, "_next", "_first").withColumn("_on", F.lit(True))
    x = x.join(path, [*TP, arrival], "left").withColumn("_moved", F.when(F.col("_on"), F.col("_end")))
    x = running_max(x, TP, arrival, "_moved", "_log_end", include=False)
    verdict = F.when(F.col("_on"), "appended").when(F.col("last_offset") < F.coalesce("_log_end", F.lit(0)), "already_applied").otherwise("gap")
    return x.withColumn("verdict", verdict).drop("_end", "_on", "_moved", "_log_end")


def append_markers(transactions: DataFrame, ends: DataFrame) -> DataFrame:
    """A control record at the end of the log for each transaction that is over, in the order of txn_seq."""
    over = transactions.filter(F.col("status").isin("Committed", "Aborted")).select(*TP, "txn_seq", F.when(F.col("status") == "Committed", "commit").otherwise("abort").alias("marker"))
    return append(over, "txn_seq", ends).withColumn("is_control", F.lit(True))


def oversized(batches: DataFrame, most: int) -> DataFrame:
    """Batches above the largest message size, which are rejected."""
    return batches.filter(F.col("size_bytes") > most)


def keyless_batches(batches: DataFrame, records: DataFrame, of: int) -> DataFrame:
    """Batches a compacted topic rejects: those with any record without a key."""
    bad = records.filter("key is null or key = ''").select(*TP, F.floor(F.col("log_offset") / of).alias("batch_no")).distinct()
    return batches.join(bad, [*TP, "batch_no"], "left_semi")


def monotonic_times(records: DataFrame) -> DataFrame:
    """The time index's clamp: the largest time so far in each partition."""
    return running_max(records, TP, "log_offset", "ts_ms", "index_ts_ms")


def in_order(records: DataFrame) -> DataFrame:
    """Rows of each partition together and by offset; nothing holds between partitions."""
    return records.repartition(*TP).sortWithinPartitions(*TP, "log_offset")


def take_fairly(records: DataFrame, n: int) -> DataFrame:
    """At most n records over all partitions, one of each in turn (a limit is the feature here)."""
    return records.orderBy("log_offset", *TP).limit(n)


def number(c: str) -> Column:
    return F.col(c).cast("long")
