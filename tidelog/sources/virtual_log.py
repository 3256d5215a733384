"""A log, its transactions, leases and groups, derived from the events table (offsets are dense in each partition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.routing import partition_for
from tidelog.operators.ranking import sequence_numbers
from tidelog.sources.tables import table

PARTITIONS = 4


def div(a, b) -> Column:
    """Integer division of non-negative numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return ((a - F.pmod(a, b)) / b).cast("long")


def millis(c) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def size_of(*columns: str) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.length(c), F.lit(0))
    return total.cast("long")


def keyed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as unnumbered records: every fiftieth has no key, errors are tombstones, views are empty."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    key = F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string"))
    value = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("props"))
    return e.select(F.lit("events").alias("topic"), "event_id", millis("ts").alias("ts_ms"), key.alias("key"), value.alias("value")).withColumn("partition", partition_for("key", PARTITIONS))


def log(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence_numbers(keyed_events(spark, folder), ["topic", "partition"], "event_id", "log_offset")
    return rows.select("topic", "partition", "log_offset", "event_id", "ts_ms", "key", "value")


def ends(records: DataFrame) -> DataFrame:
    return records.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("leo")).withColumn("hw", F.col("leo") - 5)


def segments(records: DataFrame, span: int = 500) -> DataFrame:
    base = F.col("log_offset") - F.col("log_offset") % span
    last = (F.col("leo") - 1) - (F.col("leo") - 1) % span
    x = records.join(ends(records), ["topic", "partition"])
    return x.withColumn("segment_base", base).withColumn("encoded_size", 73 + size_of("key", "value")).withColumn("is_active_segment", base == last)


def batches(records: DataFrame, of: int = 7) -> DataFrame:
    x = records.groupBy("topic", "partition", div("log_offset", of).alias("batch_no"))
    return x.agg(F.min("log_offset").alias("base_offset"), F.max("log_offset").alias("last_offset"), (53 + F.sum(20 + size_of("key", "value"))).cast("long").alias("size_bytes"))


def transactions(records: DataFrame) -> DataFrame:
    x = records.groupBy("topic", "partition", div("log_offset", 20).alias("txn_seq")).agg(F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    x = x.filter("txn_seq % 4 <> 3").join(ends(records), ["topic", "partition"])
    status = F.when(F.col("first_offset") >= div(F.col("leo") * 9, 10), "Ongoing").when(F.col("txn_seq") % 4 == 1, "Aborted").otherwise("Committed")
    return x.select("topic", "partition", "txn_seq", "first_offset", "last_offset", (1000 + F.col("txn_seq") % 7).alias("producer_id"), status.alias("status"))


def with_markers(records: DataFrame) -> DataFrame:
    """The log with a control marker as the last record of each finished transaction."""
    ended = transactions(records).filter("status in ('Committed', 'Aborted')").select("topic", "partition", F.col("last_offset").alias("log_offset"), F.lit(True).alias("_marker"))
    x = records.join(ended, ["topic", "partition", "log_offset"], "left")
    return x.select("topic", "partition", "log_offset", "ts_ms", "key", "value", F.coalesce("_marker", F.lit(False)).alias("is_control"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Produce attempts of idempotent producers; every tenth is sent twice."""
    e = sequence_numbers(table(spark, folder, "events").select("event_id", F.col("user_id").alias("producer_id")), ["producer_id"], "event_id", "base_sequence")
    x = e.withColumn("attempt", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return x.select("producer_id", "base_sequence", F.lit(0).alias("epoch"), "attempt", (F.col("event_id") * 2 + F.col("attempt") - 1).alias("arrival"))


def commits(records: DataFrame) -> DataFrame:
    group = F.concat(F.lit("g"), (F.col("key").cast("long") % 8).cast("string"))
    return records.filter("key is not null").select(group.alias("group_id"), "topic", "partition", "log_offset", F.col("event_id").alias("commit_seq"))


def leases(records: DataFrame) -> DataFrame:
    x = records.groupBy("topic", "partition", div("log_offset", 50).alias("range_no"))
    x = x.agg(F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"), F.min("ts_ms").alias("acquired_at_ms"))
    owner = F.concat(F.lit("m"), (F.col("range_no") % 3).cast("string"))
    return x.select("topic", "partition", "range_no", "first_offset", "last_offset", owner.alias("acquired_by"), (1 + F.col("range_no") % 5).alias("delivery_count"), "acquired_at_ms", F.lit(30000).cast("long").alias("lock_timeout_ms"))


def acks(held: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Accept", "Release", "Reject", "Renew", "Yield")]), (F.col("range_no") % 5 + 1).cast("int"))
    x = held.filter("range_no % 2 = 0 and last_offset - first_offset >= 29")
    member = F.when(F.col("range_no") % 12 == 0, F.lit("m9")).otherwise(F.col("acquired_by"))
    return x.select("topic", "partition", (F.col("first_offset") + 10).alias("first_offset"), (F.col("first_offset") + 29).alias("last_offset"), member.alias("member_id"), kind.alias("ack_type"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_type", millis("ts").alias("ms"))
    x = e.groupBy("user_id").agg(F.max("ms").alias("last_heartbeat_ms"), F.max(F.when(F.col("event_type").isin("view", "click"), F.col("ms"))).alias("last_progress_ms"))
    return x.select((F.col("user_id") % 8).alias("group_no"), F.col("user_id").alias("member_id"), "last_heartbeat_ms", "last_progress_ms", (3600000 * (1 + F.col("user_id") % 6)).alias("session_timeout_ms"))
