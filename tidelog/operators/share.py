"""Share groups: leased ranges of offsets, acknowledgements, expiry and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import TP
from tidelog.operators.ranking import WIDTH, running_sum

MOST_DELIVERIES = 5
SPAN = 64


def after_ack(kind: Column, count: Column, most: int = MOST_DELIVERIES) -> tuple[Column, Column]:
    """(state, delivery_count) of a leased range after an acknowledgement; a release or expiry counts as an attempt."""
    spent = F.when(count < most, "Available").otherwise("Archived")
    state = F.when(kind == "Accept", "Acknowledged").when(kind == "Release", spent).when(kind == "Reject", "Archived").when(kind == "Renew", "Acquired").when(kind == "Yield", "Available")
    return state, F.when(kind == "Yield", F.greatest(count - 1, F.lit(0))).otherwise(count)


def apply_acks(leases: DataFrame, acks: DataFrame, most: int = MOST_DELIVERIES) -> DataFrame:
    """Ranges after acknowledgements: a lease is split into what lies before, in and after each range acknowledged.

    Only the owner's acknowledgements count. Ranges of one owner's acknowledgements don't overlap. Leases and
    acknowledgements meet by cells of offsets, so the overlap join is an equi join.
    """
    cells = lambda df: F.explode(F.sequence(F.floor(F.col("first_offset") / SPAN), F.floor(F.col("last_offset") / SPAN)))
    a = acks.withColumn("_cell", cells(acks)).select(*[F.col(c).alias(f"_{c}") for c in TP], "_cell", F.col("first_offset").alias("_first"), F.col("last_offset").alias("_last"), "member_id", "ack_type")
    on = (F.col("topic") == F.col("_topic")) & (F.col("partition") == F.col("_partition")) & (F.col("c") == F.col("_cell")) & (F.col("acquired_by") == F.col("member_id")) & (F.col("first_offset") <= F.col("_last")) & (F.col("last_offset") >= F.col("_first"))
    hits = leases.withColumn("c", cells(leases)).join(a, on)
    keys = [*TP, "first_offset", "last_offset", "acquired_by", "delivery_count"]
    hits = hits.select(*keys, F.greatest("first_offset", "_first").alias("lo"), F.least("last_offset", "_last").alias("hi"), "ack_type").distinct()
    cuts = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "ack_type"))).alias("cuts"))
    x = leases.select(*keys).join(cuts, keys, "left")
    none = F.lit(None).cast("string")
    part = lambda lo, hi, kind: F.struct(lo.alias("lo"), hi.alias("hi"), kind.alias("ack_type"))
    n = F.size("cuts")
    gap = lambda i: part(F.when(i == 0, F.col("first_offset")).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["hi"] + 1), F.when(i == n, F.col("last_offset")).otherwise(F.element_at("cuts", F.least(i + 1, n))["lo"] - 1), none)
    own = F.transform("cuts", lambda c: part(c["lo"], c["hi"], c["ack_type"]))
    gaps = F.filter(F.transform(F.sequence(F.lit(0), n), gap), lambda g: g["lo"] <= g["hi"])
    parts = F.when(F.col("cuts").isNull(), F.array(part(F.col("first_offset"), F.col("last_offset"), none))).otherwise(F.concat(gaps, own))
    x = x.withColumn("p", F.explode(parts)).select(*TP, "acquired_by", "delivery_count", "p.*")
    state, count = after_ack(F.col("ack_type"), F.col("delivery_count"), most)
    return x.select(*TP, F.col("lo").alias("first_offset"), F.col("hi").alias("last_offset"), "acquired_by", F.coalesce(state, F.lit("Acquired")).alias("state"), count.alias("delivery_count"))


def expire(leases: DataFrame, now_ms: int, most: int = MOST_DELIVERIES) -> DataFrame:
    """Adds state: leases past their time follow the rule of a release."""
    late = F.lit(now_ms) >= F.col("acquired_at_ms") + F.col("lock_timeout_ms")
    return leases.withColumn("state", F.when(late & (F.col("delivery_count") < most), "Available").when(late, "Archived").otherwise("Acquired"))


def dead_letters(ranges: DataFrame, records: DataFrame) -> DataFrame:
    """Records of archived ranges, for the topic "<topic>-dlq": key, null value and place of origin are kept.

    Ranges and records meet by cells of offsets.
    """
    cells = F.explode(F.sequence(F.floor(F.col("first_offset") / SPAN), F.floor(F.col("last_offset") / SPAN)))
    gone = ranges.filter("state = 'Archived'").select(*TP, "first_offset", "last_offset", "delivery_count", cells.alias("_cell"))
    x = records.withColumn("_cell", F.floor(F.col("log_offset") / SPAN)).join(gone, [*TP, "_cell"]).filter(F.col("log_offset").between(F.col("first_offset"), F.col("last_offset")))
    return x.select(F.concat("topic", F.lit("-dlq")).alias("dlq_topic"), "topic", "partition", "log_offset", "key", "value", "delivery_count")


def coalesce_acks(acks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Ranges of adjacent offsets (topic, partition, log_offset, ack_type) of one type.

    Islands are found inside runs of offsets, which is one shuffle; only those that touch a run's edge, two a run at
    most, are then joined with their neighbours.
    """
    by = [*TP, "ack_type", "_run"]
    order = Window.partitionBy(*by).orderBy("log_offset")
    x = acks.select(*TP, "ack_type", "log_offset").withColumn("_run", F.floor(F.col("log_offset") / width))
    new = F.coalesce(F.col("log_offset") - F.lag("log_offset").over(order) > 1, F.lit(True))
    x = x.withColumn("_new", new.cast("long")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*by, "_island").agg(F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    edge = (F.col("first_offset") == F.col("_run") * width) | (F.col("last_offset") == (F.col("_run") + 1) * width - 1)
    along = Window.partitionBy(*TP, "ack_type").orderBy("first_offset")
    e = x.filter(edge).withColumn("_new", F.coalesce(F.col("first_offset") - F.lag("last_offset").over(along) > 1, F.lit(True)).cast("long"))
    e = e.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*TP, "ack_type", "_chain")
    e = e.agg(F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))
    columns = [*TP, "ack_type", "first_offset", "last_offset"]
    return x.filter(~edge).select(*columns).unionByName(e.select(*columns))


def acquire(ranges: DataFrame, ends: DataFrame, member: str, most: int) -> DataFrame:
    """What a member gets of each partition, `most` offsets at most, and what is left of the ranges it cuts:
    Available ranges first, by offset, the last one split; then offsets no range holds yet, up to the end (leo).

    Rows (topic, partition, first_offset, last_offset, state, acquired_by, delivery_count) of the ranges it touches.
    """
    open_ = ranges.filter("state = 'Available'").withColumn("_n", F.col("last_offset") - F.col("first_offset") + 1)
    open_ = running_sum(open_, TP, "first_offset", "_n", "_upto").withColumn("_take", F.least(F.col("_n"), F.lit(most) - F.col("_upto") + F.col("_n"))).filter("_take > 0")
    part = lambda lo, hi, state, by, count: F.struct(lo.alias("first_offset"), hi.alias("last_offset"), F.lit(state).alias("state"), by.alias("acquired_by"), count.cast("long").alias("delivery_count"))
    last = F.col("first_offset") + F.col("_take") - 1
    taken = part(F.col("first_offset"), last, "Acquired", F.lit(member), F.col("delivery_count") + 1)
    left = part(last + 1, F.col("last_offset"), "Available", F.lit(None).cast("string"), F.col("delivery_count"))
    again = open_.select(*TP, F.explode(F.when(F.col("_take") < F.col("_n"), F.array(taken, left)).otherwise(F.array(taken))).alias("p")).select(*TP, "p.*")
    had = open_.groupBy(*TP).agg(F.sum("_take").alias("_had"))
    held = ranges.groupBy(*TP).agg((F.max("last_offset") + 1).alias("_from"))
    x = ends.select(*TP, "leo").join(held, TP, "left").join(had, TP, "left").withColumn("_from", F.coalesce("_from", F.lit(0)))
    x = x.withColumn("_n", F.least(F.lit(most) - F.coalesce("_had", F.lit(0)), F.col("leo") - F.col("_from"))).filter("_n > 0")
    fresh = part(F.col("_from"), F.col("_from") + F.col("_n") - 1, "Acquired", F.lit(member), F.lit(1))
    return again.unionByName(x.select(*TP, fresh.alias("p")).select(*TP, "p.*"))


def start_offsets(ranges: DataFrame) -> DataFrame:
    """Where each partition's share group starts: its first range that is not resolved, else the end of all."""
    open_ = F.min(F.when(~F.col("state").isin("Acknowledged", "Archived"), F.col("first_offset")))
    return ranges.groupBy(*TP).agg(F.coalesce(open_, F.max("last_offset") + 1).alias("start_offset"))


def group_stats(ranges: DataFrame) -> DataFrame:
    """Of each topic: offsets in flight and the least start offset."""
    flying = F.sum(F.when(F.col("state") == "Acquired", F.col("last_offset") - F.col("first_offset") + 1).otherwise(0)).alias("in_flight")
    per = ranges.groupBy(*TP).agg(flying).join(start_offsets(ranges), TP)
    return per.groupBy("topic").agg(F.sum("in_flight").alias("in_flight"), F.min("start_offset").alias("start_offset"))


def restored(ranges: DataFrame) -> DataFrame:
    """After a restart nobody holds a lease; delivery counts stay."""
    return ranges.withColumn("state", F.when(F.col("state") == "Acquired", "Available").otherwise(F.col("state")))


def active_members(heartbeats: DataFrame, now_ms: int, within_ms: int = 60_000) -> DataFrame:
    return heartbeats.filter(F.lit(now_ms) - F.col("last_heartbeat_ms") <= within_ms).groupBy("group_no").agg(F.countDistinct("member_id").alias("active"))
