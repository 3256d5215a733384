"""Queries by name: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import policy, routing, values
from tidelog.operators import catalog, compaction, groups, isolation, log, metrics, producer, replication, retention, share
from tidelog.operators.log import TP
from tidelog.sources import virtual_log as v
from tidelog.sources.tables import table
from tidelog.sources.virtual_log import div, millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RECORD = [*TP, "log_offset", "ts_ms", "key", "value"]
NOW, DAY = 1706659200000, 86_400_000  # the end of the events' month
OVERSIZED = 240


def query(f):
    QUERIES[f.__name__] = f
    return f


# scans


@query
def log_latest_per_key(spark, folder):
    return compaction.latest_per_key(v.log(spark, folder)).select(*RECORD)


@query
def log_route_crc32(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", routing.partition_for(F.col("o_custkey").cast("string"), 12).alias("partition"))


@query
def log_assign_offsets(spark, folder):
    return log.append(v.keyed_events(spark, folder), "event_id").select(*TP, "log_offset", "event_id")


@query
def log_fetch_range(spark, folder):
    records = v.log(spark, folder)
    return log.fetch_range(records, 100, 600, v.ends(records)).select(*RECORD)


@query
def log_fetch_whole_batches(spark, folder):
    records = v.log(spark, folder)
    fetched = log.fetch_batches(v.batches(records), 205, 20_000, v.ends(records))
    return log.records_of(fetched, records, 205, 7).select(*TP, "log_offset", "ts_ms")


@query
def log_fetch_by_timestamp(spark, folder):
    records = v.log(spark, folder)
    return log.fetch_since(records, NOW - 3 * DAY, v.ends(records)).select(*RECORD)


@query
def log_offset_for_timestamp(spark, folder):
    records = v.log(spark, folder)
    days = F.explode(F.sequence(F.lit(NOW - 31 * DAY), F.lit(NOW + DAY), F.lit(DAY)))
    ends = v.ends(records)
    return log.offset_for_time(records, ends.select(*TP, days.alias("target_ms")), ends)


@query
def log_seek_asof_index(spark, folder):
    records = v.log(spark, folder)
    return log.seek(records.select(*TP, "log_offset"), log.sparse_index(records, 50)).select(*TP, "log_offset", "index_offset")


@query
def log_end_offsets(spark, folder):
    return log.end_offsets(v.log(spark, folder))


def arriving(spark, folder):
    """Batches as a replica gets them: some are late, so that what follows them is a gap, all are sent again, some of
    these twice, and some come cut otherwise, across the end of the log."""
    late = F.when(F.col("batch_no") % 11 == 5, 9).otherwise(0)
    copies = [F.struct(late.alias("delay"), F.lit(0).alias("shift")), F.struct(F.lit(30).alias("delay"), F.lit(0).alias("shift"))]
    more = F.when(F.col("batch_no") % 13 == 0, F.array(F.struct(F.lit(35).alias("delay"), F.lit(0).alias("shift")))).when(F.col("batch_no") % 17 == 3, F.array(F.struct(F.lit(31).alias("delay"), F.lit(3).alias("shift"))))
    none = F.expr("cast(array() as array<struct<delay: int, shift: int>>)")
    b = v.batches(v.log(spark, folder)).select("*", F.posexplode(F.concat(F.array(*copies), F.coalesce(more, none))).alias("copy", "c"))
    moved = [(F.col(n) + F.col("c.shift")).alias(n) for n in ("base_offset", "last_offset")]
    return b.select(*TP, *moved, ((F.col("batch_no") * 2 + F.col("c.delay")) * 4 + F.col("copy")).alias("arrival"))


@query
def replica_append_classify(spark, folder):
    return log.classify_appends(arriving(spark, folder), "arrival").select(*TP, "arrival", "base_offset", "last_offset", "verdict")


@query
def log_high_watermark_isr_min(spark, folder):
    ends = v.ends(v.log(spark, folder))
    replicas = ends.withColumn("node", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("watermark", F.col("leo") - 1 - (F.col("partition") * 3 + F.col("node")) % 5)
    parts = ends.select(*TP, "leo", (1 + F.col("partition") % 2).alias("min_isr"))
    return replication.high_watermarks(parts, replicas).select(*TP, "leo", "hw")


@query
def timeindex_monotonic(spark, folder):
    late = v.log(spark, folder).withColumn("ts_ms", F.col("ts_ms") - F.when(F.col("event_id") % 37 == 0, 7_200_000).otherwise(0))
    return log.monotonic_times(late).select(*TP, "log_offset", "index_ts_ms")


# isolation


@query
def committed_lso(spark, folder):
    return isolation.last_stable_offsets(v.transactions(v.log(spark, folder)))


@query
def committed_read(spark, folder):
    records = v.log(spark, folder)
    return isolation.committed_read(v.with_markers(records), v.transactions(records), v.ends(records)).select(*RECORD)


@query
def committed_aborted_ranges(spark, folder):
    t = v.transactions(v.log(spark, folder))
    return isolation.aborted_ranges(t.filter("txn_seq % 3 <> 0"), t.filter("txn_seq % 2 = 1"))


# compaction and retention


def judged(spark, folder, **rule):
    return compaction.judged(v.segments(v.log(spark, folder)), **rule)


@query
def compact_survivors(spark, folder):
    return judged(spark, folder).filter("survives").select(*TP, "segment_base", "log_offset", "key")


@query
def compact_tombstone_purge(spark, folder):
    return judged(spark, folder, now_ms=NOW, retention_ms=DAY).filter("survives").select(*TP, "segment_base", "log_offset", "key")


@query
def compact_dirty_ratio(spark, folder):
    return compaction.dirty_ratios(judged(spark, folder)).filter("dirty_ratio >= 0.95").select(*TP, "segment_base", "total_bytes", "discarded_bytes", "dirty_ratio")


@query
def compact_log(spark, folder):
    return compaction.compact(v.segments(v.log(spark, folder)), 0.5, 4).select(*TP, "segment_base", "log_offset")


@query
def compact_keyless_reject(spark, folder):
    records = v.log(spark, folder)
    return log.keyless_batches(v.batches(records), records, 7).select(*TP, "batch_no", "base_offset", "last_offset")


def segment_rows(spark, folder):
    return retention.segment_table(v.segments(v.log(spark, folder)))


@query
def retain_time(spark, folder):
    return retention.expired_by_time(segment_rows(spark, folder), NOW, 15 * DAY).select(*TP, "segment_base", "newest_ms")


@query
def retain_size(spark, folder):
    return retention.expired_by_size(segment_rows(spark, folder), 120_000).select(*TP, "segment_base", "remaining")


@query
def retain_both(spark, folder):
    return retention.retain(segment_rows(spark, folder), NOW, 15 * DAY, 120_000).select(*TP, "segment_base", "size_bytes")


@query
def retain_trim_before(spark, folder):
    return retention.trimmed_before(segment_rows(spark, folder), 1200).select(*TP, "segment_base")


@query
def log_truncate_after(spark, folder):
    return retention.truncate_after(v.batches(v.log(spark, folder)), 1003).select(*TP, "batch_no", "last_offset")


@query
def segment_roll(spark, folder):
    return retention.roll_segments(v.segments(v.log(spark, folder)), 40_000)


# producers


def changes(spark, folder):
    """Status changes of transactions, from their final state."""
    t = v.transactions(v.log(spark, folder)).withColumn("transaction_id", F.concat_ws("-", F.col("partition").cast("string"), F.col("txn_seq").cast("string")))
    steps = F.when(F.col("status") == "Committed", F.array(F.lit("Ongoing"), F.lit("PrepareCommit"), F.lit("Committed"))).when(F.col("status") == "Aborted", F.array(F.lit("Ongoing"), F.lit("PrepareAbort"), F.lit("Aborted"))).otherwise(F.when(F.col("txn_seq") % 2 == 0, F.array(F.lit("Ongoing"), F.lit("PrepareCommit"))).otherwise(F.array(F.lit("Ongoing"))))
    x = t.select("transaction_id", "partition", "txn_seq", F.posexplode(steps).alias("step", "status"))
    return x.select("transaction_id", "status", (F.col("txn_seq") * 10 + F.col("step")).alias("seq"), (F.lit(NOW) - (F.col("txn_seq") % 100) * 1000).alias("created_at_ms"))


@query
def txn_latest_status(spark, folder):
    return producer.latest_status(changes(spark, folder)).select("transaction_id", "status", "seq")


@query
def txn_timeout_action(spark, folder):
    c = changes(spark, folder)
    last = producer.latest_status(c).join(c.groupBy("transaction_id").agg(F.max("created_at_ms").alias("created_at_ms")), "transaction_id")
    return producer.timeout_actions(last, NOW, 10_000).select("transaction_id", "status", "action")


@query
def producer_exact_retry_dedup(spark, folder):
    return producer.exact_retries_dropped(v.attempts(spark, folder)).select("producer_id", "base_sequence", "arrival")


@query
def producer_sequence_gaps(spark, folder):
    return producer.sequence_gaps(v.attempts(spark, folder).filter("base_sequence % 7 <> 3"))


@query
def producer_idempotent_fold(spark, folder):
    return producer.idempotent_fold(v.attempts(spark, folder)).select("producer_id", "base_sequence", "arrival", "verdict")


@query
def producer_fencing(spark, folder):
    e = table(spark, folder, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("transactional_id"), div("event_id", 500).alias("epoch"), "event_id", (F.col("event_id") % 25 == 3).alias("is_init"))
    old = F.when(~F.col("is_init") & (F.col("event_id") % 7 == 2), F.greatest(F.col("epoch") - 1, F.lit(0))).otherwise(F.col("epoch"))  # requests that come late
    return producer.judged_requests(e.withColumn("epoch", old), "event_id").select("transactional_id", "epoch", "event_id", "verdict")


# groups


@query
def group_committed_offsets(spark, folder):
    return groups.committed_offsets(v.commits(v.log(spark, folder)))


@query
def group_lag(spark, folder):
    records = v.log(spark, folder)
    commits = v.commits(records).filter("log_offset % 3 = 0")
    subscribed = commits.select("group_id", "topic").distinct().withColumn("partition", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v.PARTITIONS - 1).cast("long"))))
    seen = groups.committed_offsets(commits.filter("not (group_id in ('g1', 'g6') and partition = 2)"))
    return groups.lag(seen, v.ends(records), subscribed).select("group_id", *TP, "lag")


def evicted(spark, folder):
    return groups.evictions(v.members(spark, folder), NOW - 3 * DAY // 24, 12 * DAY // 24)


@query
def group_evictions(spark, folder):
    return evicted(spark, folder).select("group_no", "member_id", "reason")


@query
def group_recent_evictions(spark, folder):
    return groups.recent_evictions(evicted(spark, folder), 5).select("group_no", "member_id", "rank")


@query
def assign_range(spark, folder):
    return groups.assign_range(v.members(spark, folder), 50)


@query
def assign_roundrobin(spark, folder):
    return groups.assign_round_robin(v.members(spark, folder), 50)


@query
def assign_sticky(spark, folder):
    m = v.members(spark, folder)
    return groups.assign_sticky(m.filter("member_id % 5 <> 1"), groups.assign_range(m, 50), 50)


@query
def assign_cooperative_round_one(spark, folder):
    m = v.members(spark, folder)
    return groups.cooperative_round_one(groups.assign_round_robin(m.filter("member_id % 5 <> 1"), 50), groups.assign_round_robin(m, 50))


@query
def assign_duplicate_owners(spark, folder):
    m = v.members(spark, folder)
    return groups.duplicate_owners(groups.assign_round_robin(m, 50).unionByName(groups.assign_range(m, 50).filter("partition % 3 = 0")))


# share groups


def held(spark, folder):
    return v.leases(v.log(spark, folder))


@query
def share_ack_apply(spark, folder):
    x = held(spark, folder)
    return share.apply_acks(x, v.acks(x))


@query
def share_expire_leases(spark, folder):
    return share.expire(held(spark, folder), NOW - 10 * DAY).select(*TP, "first_offset", "last_offset", "state", "delivery_count")


@query
def share_dlq_route(spark, folder):
    records = v.log(spark, folder)
    x = v.leases(records)
    return share.dead_letters(share.apply_acks(x, v.acks(x)), records)


@query
def share_coalesce_acks(spark, folder):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Accept", "Release", "Reject")]), (F.col("event_id") % 7 % 3 + 1).cast("int"))
    return share.coalesce_acks(v.log(spark, folder).select(*TP, "log_offset", kind.alias("ack_type")))


@query
def share_watermark_advance(spark, folder):
    x = held(spark, folder)
    return share.start_offsets(share.apply_acks(x, v.acks(x)).filter("first_offset >= 10"))


@query
def share_group_stats(spark, folder):
    x = held(spark, folder)
    return share.group_stats(share.apply_acks(x, v.acks(x)))


@query
def share_active_members(spark, folder):
    return share.active_members(v.members(spark, folder), NOW - 2 * DAY, 3 * DAY)


# metrics


@query
def metric_topic_counters_rollup(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("topic"), v.size_of("props").alias("bytes"))
    return metrics.topic_counters(e)


def latencies(spark, folder):
    return table(spark, folder, "events").select("event_type", (F.col("event_id") * 7919 % 6007).alias("ms"))


@query
def metric_latency_histogram(spark, folder):
    return metrics.latency_histogram(latencies(spark, folder), ["event_type"])


@query
def metric_nearest_rank_pct(spark, folder):
    return metrics.nearest_rank(latencies(spark, folder), ["event_type"], [50, 95, 99])


@query
def metric_throughput(spark, folder):
    e = table(spark, folder, "events").select("event_type", v.size_of("props").alias("bytes"), millis("ts").alias("ts_ms"))
    return metrics.throughput(e, ["event_type"])


@query
def quota_token_bucket(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("client_id"), millis("ts").alias("at_ms"), F.col("event_id").alias("seq"), (F.col("event_id") % 97 * 1000).alias("amount"))
    return metrics.token_bucket(e, 20_000.0)


# policy and catalog


@query
def policy_acl_authorize(spark, folder):
    e = table(spark, folder, "events")
    requests = e.select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("User:"), (F.col("user_id") % 10).cast("string")).alias("principal"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 3).cast("string")).alias("host"),
        F.when(F.col("event_id") % 2 == 0, "Read").otherwise("Write").alias("operation"), F.lit("Topic").alias("resource_type"), F.concat(F.col("event_type"), F.lit("-"), (F.col("event_id") % 4).cast("string")).alias("resource"),
    )
    rules = spark.createDataFrame(RULES, "principal string, host string, operation string, resource_type string, resource string, pattern string, permission string")
    return catalog.authorize(requests, rules).select("request_id", "allowed")


RULES = [
    ("User:1", "*", "All", "Topic", "click-1", "literal", "Allow"),
    ("*", "10.0.0.1", "Read", "Topic", "view-", "prefix", "Allow"),
    ("User:2", "*", "All", "Topic", "*", "literal", "Allow"),
    ("User:2", "10.0.0.2", "Write", "Topic", "*-3", "glob", "Deny"),
    ("*", "*", "Read", "Topic", "*chas*", "glob", "Allow"),
    ("User:3", "*", "Read", "Topic", "purchase-2", "literal", "Deny"),
]


@query
def policy_topic_name(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.concat(F.element_at(F.array(F.lit(""), F.lit("__"), F.lit("a..b")), (F.col("p_partkey") % 3 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.translate("p_name", " #", "__"))).alias("name"))
    return p.select("p_partkey", policy.topic_name_ok("name").alias("ok"))


@query
def catalog_describe_topic(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 7).alias("partition"), "o_orderkey")
    parts = o.filter("partition <> 3").groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("hw"), F.min(F.col("o_orderkey") % 3).alias("leader"))
    topics = o.groupBy("topic").agg(F.lit(9).alias("n_partitions"))
    return catalog.describe_topics(topics, parts)


@query
def catalog_unassigned(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 7).alias("partition"))
    return catalog.unassigned(o.groupBy("topic").agg(F.lit(9).alias("n_partitions")), o.distinct())


@query
def catalog_list_topics(spark, folder):
    t = table(spark, folder, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "").otherwise("__"), F.col("c_mktsegment"), (F.col("c_nationkey") % 3).cast("string")).alias("topic"))
    return catalog.list_topics(t.filter("topic like '%0'"), t.filter("topic like '%1'"))


@query
def catalog_replica_striping(spark, folder):
    topics = table(spark, folder, "part").select(F.col("p_brand").alias("topic")).distinct().withColumn("partitions", F.lit(6))
    x = routing.striped_replicas(topics, [1, 2, 3, 4, 5], 3)
    return x.select("topic", "partition", "leader", F.array_join(F.transform("replicas", lambda r: r.cast("string")), ",").alias("replicas"))


@query
def catalog_latest_entity(spark, folder):
    c = table(spark, folder, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "event_type")
    return catalog.latest_entity(c, ["user_id"]).select("user_id", "seq", "event_type")


@query
def config_effective_merge(spark, folder):
    c = table(spark, folder, "customer")
    stored = F.create_map(F.lit("retention.ms"), F.col("c_custkey").cast("string"), F.lit("cleanup.policy"), F.when(F.col("c_custkey") % 3 == 0, "compact").otherwise(""))
    upserts = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("retention.ms"), F.lit("5"))).otherwise(F.create_map(F.lit("segment.bytes"), F.lit("9")))
    deletes = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("retention.ms"))).otherwise(F.expr("cast(array() as array<string>)"))
    defaults = F.create_map(F.lit("retention.ms"), F.lit("604800000"), F.lit("cleanup.policy"), F.lit("delete"))
    m = catalog.effective_config(defaults, catalog.merged_config(stored, upserts, deletes))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return c.select("c_custkey", text.alias("config"))


@query
def replica_failover(spark, folder):
    ends = v.ends(v.log(spark, folder))
    parts = ends.select(*TP, (1 + F.col("partition") % 3).cast("long").alias("leader"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]).alias("replicas"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]).alias("isr"))
    acks = spark.createDataFrame([(1, NOW - 50_000), (2, NOW - 1000)], "node long, last_ack_ms long")
    x = replication.failover(parts, acks, NOW, 30_000)
    return x.select(*TP, "new_leader", F.array_join(F.transform("new_isr", lambda n: n.cast("string")), ",").alias("new_isr"))


@query
def election_tally(spark, folder):
    e = table(spark, folder, "events")
    votes = e.select((F.col("event_id") % 200).alias("term"), (F.col("user_id") % 2).alias("candidate"), (F.col("user_id") % 9).alias("voter"), (F.col("event_type") != "error").alias("granted"))
    return replication.elected(votes, 9)


# smaller operators of the sections above


@query
def txn_decision_kept(spark, folder):
    c = changes(spark, folder).select("transaction_id", "status", "seq")
    other = c.filter("status = 'Ongoing' and floor(seq / 10) % 5 = 2").select("transaction_id", F.lit("PrepareAbort").alias("status"), (F.col("seq") + 5).alias("seq"))
    return producer.latest_status(c.unionByName(other))


@query
def group_fetch_progress(spark, folder):
    fetches = table(spark, folder, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 8).alias("group_no"), F.col("user_id").alias("member_id"), millis("ts").alias("at_ms"))
    return groups.with_progress(v.members(spark, folder), fetches).select("group_no", "member_id", "last_progress_ms")


@query
def log_replication_fetch(spark, folder):
    return log.fetch_range(v.log(spark, folder), 100, 600).select(*RECORD)


@query
def log_append_markers(spark, folder):
    records = v.log(spark, folder)
    return log.append_markers(v.transactions(records), v.ends(records)).select(*TP, "log_offset", "txn_seq", "marker")


@query
def log_poll_fairly(spark, folder):
    return log.take_fairly(v.log(spark, folder), 40).select(*TP, "log_offset")


@query
def log_oversized_batches(spark, folder):
    return log.oversized(v.batches(v.log(spark, folder)), OVERSIZED).select(*TP, "batch_no", "size_bytes")


@query
def log_partition_bytes(spark, folder):
    return segment_rows(spark, folder).groupBy(*TP).agg(F.sum("size_bytes").alias("size_bytes"), F.max("newest_ms").alias("newest_ms"))


@query
def replica_undiscovered_peers(spark, folder):
    peers = table(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), "n_name")
    return catalog.undiscovered(peers, table(spark, folder, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("node")))


@query
def replica_full_ack(spark, folder):
    ends = v.ends(v.log(spark, folder))
    replicas = ends.withColumn("node", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("watermark", F.col("leo") - 1 - (F.col("partition") * 3 + F.col("node")) % 5)
    silent = replicas.withColumn("watermark", F.when((F.col("partition") + F.col("node")) % 5 != 4, F.col("watermark")))  # some were never heard of
    return replication.fully_acked(silent.withColumn("target", F.col("leo") - 4), "target", 2)


@query
def producer_lru_evictions(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("producer_id"), "event_id")
    used = e.groupBy("producer_id").agg(F.max("event_id").alias("last_used"))
    return catalog.eviction_order(used, e.filter("event_id % 50 = 0").select("producer_id").distinct(), 10)


@query
def share_restored(spark, folder):
    x = held(spark, folder)
    return share.restored(share.apply_acks(x, v.acks(x)))


@query
def policy_cidr(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.concat(F.lit("10."), (F.col("user_id") % 300).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".1")).alias("address"))
    return e.select("event_id", policy.cidr_contains("10.0.0.0/9", "address").alias("inside"))


@query
def config_values(spark, folder):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("5", " 7 ", "", "x", "-3", " LZ4", "zstd")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", values.optional_long(raw).alias("number"), values.one_of(raw, values.CODECS).alias("codec"))


@query
def batch_attributes(spark, folder):
    a = (F.col("event_id") % 32).cast("int")  # reserved codecs too
    return table(spark, folder, "events").select("event_id", values.codec_of(a).alias("codec"), values.is_transactional(a).alias("transactional"), values.is_control(a).alias("control"))


@query
def catalog_rosters(spark, folder):
    nodes = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (F.col("event_id") + j) % 5)
    none = F.expr("cast(array() as array<bigint>)")
    c = table(spark, folder, "events").select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 100 == 0, "create").otherwise("leader").alias("op"),
        (F.col("event_id") % 5).alias("leader"), nodes(2).alias("isr"), F.when(F.col("event_id") % 3 == 0, nodes(3)).otherwise(none).alias("replicas"),
    )
    x = catalog.rosters(c)
    return x.select("topic", "partition", "leader", F.array_join(F.transform("replicas", lambda r: r.cast("string")), ",").alias("replicas"))


@query
def metric_prometheus(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("topic"), v.size_of("props").alias("bytes"))
    return metrics.prometheus(metrics.topic_counters(e).select(F.lit("log_records_total").alias("metric"), "topic", F.col("records").alias("value")))


# administration: folds of a metadata log


def metadata_log(spark, folder):
    """Creations and deletions of topics, changes of their configuration, and brokers that come and go."""
    e = table(spark, folder, "events")
    n = F.col("event_id") % 20
    op = F.when(n < 2, "create").when(n == 2, "delete").when(n < 9, "alter").when(n == 9, "replace").when(n < 13, "register").when(n == 13, "unregister")
    name = F.when(F.col("user_id") % 30 == 7, "__own").when(F.col("user_id") % 30 == 8, "a..b").otherwise(F.concat(F.lit("t"), (F.col("user_id") % 30).cast("string")))
    key = F.element_at(F.array(*[F.lit(x) for x in ("retention.ms", "cleanup.policy", "segment.bytes")]), (F.col("event_id") % 3 + 1).cast("int"))
    other = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("retention.ms"), F.lit("segment.bytes")))
    x = e.select(F.col("event_id").alias("seq"), op.alias("op"), name.alias("topic"), (F.col("event_id") % 13).alias("n_partitions"), (1 + F.col("event_id") % 3).alias("replication"), F.create_map(key, F.col("event_id").cast("string")).alias("configs"), other.alias("removed"), (F.col("user_id") % 9).alias("node"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("address"))
    return x.filter("op is not null")


@query
def catalog_create_verdicts(spark, folder):
    return catalog.judged_creations(metadata_log(spark, folder)).select("seq", "topic", "verdict")


@query
def catalog_topics_in_force(spark, folder):
    return catalog.topics_in_force(metadata_log(spark, folder))


@query
def catalog_configs_in_force(spark, folder):
    x = metadata_log(spark, folder)
    return catalog.configs_in_force(x, catalog.topics_in_force(x))


@query
def catalog_brokers_in_force(spark, folder):
    return catalog.brokers_in_force(metadata_log(spark, folder))


def rule_log(spark, folder):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("user_id") % n + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("op"), F.concat(F.lit("User:"), (F.col("user_id") % 5).cast("string")).alias("principal"), F.lit("*").alias("host"), pick(("Read", "Write", "All"), 3).alias("operation"),
        pick(("Topic", "Group"), 2).alias("resource_type"), F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("resource"), F.lit("literal").alias("pattern"), pick(("Allow", "Deny", "Allow", "Allow"), 4).alias("permission"),
    )


@query
def acl_rules_in_force(spark, folder):
    return catalog.rules_in_force(rule_log(spark, folder))


@query
def acl_list(spark, folder):
    return catalog.list_rules(catalog.rules_in_force(rule_log(spark, folder)), resource_type="Topic", resource="*", principal="", operation="Any", permission="Allow")


@query
def group_list(spark, folder):
    return groups.list_groups(v.members(spark, folder), NOW - 2 * DAY // 24)


@query
def group_describe(spark, folder):
    m = v.members(spark, folder)
    x = groups.describe_groups(m, groups.assign_round_robin(groups.alive(m, NOW - 2 * DAY // 24).filter("member_id % 4 <> 1"), 50), NOW - 2 * DAY // 24)
    return x.select("group_no", "state", "member_id", F.array_join(F.transform("partitions", lambda p: p.cast("string")), ",").alias("partitions"))


@query
def group_static_members(spark, folder):
    joins = table(spark, folder, "events").filter("event_type = 'click'").select((F.col("user_id") % 8).alias("group_no"), F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("instance_id"), F.col("event_id").alias("seq"))
    return groups.static_members(joins)


@query
def group_synced(spark, folder):
    m = v.members(spark, folder).filter("member_id % 5 <> 1")
    asked = table(spark, folder, "events").filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 8).alias("group_no"), F.col("user_id").alias("member_id"))
    x = groups.synced(asked, m, groups.assign_round_robin(m, 50))
    return x.select("request_id", "error", F.array_join(F.transform("partitions", lambda p: p.cast("string")), ",").alias("partitions"))


@query
def group_commit_metadata(spark, folder):
    c = v.commits(v.log(spark, folder)).withColumn("metadata", F.when(F.col("commit_seq") % 3 != 0, F.concat(F.lit("at "), F.col("commit_seq").cast("string"))))
    return groups.committed_with_metadata(c)


@query
def log_byte_index(spark, folder):
    return log.byte_index(v.batches(v.log(spark, folder)), 4096).select(*TP, "base_offset")


@query
def log_truncated_ends(spark, folder):
    records = v.log(spark, folder)
    return retention.truncated_ends(v.batches(records), v.ends(records), 1003)


@query
def log_in_order(spark, folder):
    return log.in_order(v.log(spark, folder)).select(*TP, "log_offset", "event_id")


@query
def segment_roll_by_time(spark, folder):
    return retention.roll_segments(v.segments(v.log(spark, folder)), 40_000, DAY // 2)


@query
def share_acquire(spark, folder):
    records = v.log(spark, folder)
    x = v.leases(records)
    return share.acquire(share.apply_acks(x, v.acks(x)).filter("last_offset < 900"), v.ends(records), "m7", 130)


@query
def producer_duplicate_answers(spark, folder):
    a = v.attempts(spark, folder)
    judged = producer.idempotent_fold(a)
    took = log.append(judged.filter("verdict = 'accepted'").withColumns({"topic": F.lit("t"), "partition": F.lit(0)}), "arrival").select("arrival", F.col("log_offset").alias("last_offset"))
    return producer.duplicate_answers(judged.join(took, "arrival", "left")).select("producer_id", "base_sequence", "arrival", "verdict", "answer")


@query
def replica_shrunk_isr(spark, folder):
    nodes = lambda n, by: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (F.col(by) + j) % 5)
    x = table(spark, folder, "events").select("event_id", replication.shrunk_isr(nodes(3, "event_id"), nodes(2, "user_id")).alias("isr"))
    return x.select("event_id", F.array_join(F.transform("isr", lambda n: n.cast("string")), ",").alias("isr"))


@query
def policy_cidr_v6(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.concat(F.lit("2001:db8:"), F.hex(F.col("user_id") % 64), F.lit("::"), F.hex(F.col("event_id") % 4096)).alias("address"))
    return e.select("event_id", policy.cidr_contains("2001:db8:20::/43", "address").alias("inside"))


@query
def config_names(spark, folder):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Compact", " delete ", "compact,delete", "sticky", "RANGE", "roundrobin", "other")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", values.one_of(raw, values.POLICIES).alias("policy"), values.one_of(raw, values.ASSIGNORS).alias("assignor"))


@query
def metric_prometheus_histogram(spark, folder):
    return metrics.prometheus_histogram(metrics.latency_histogram(latencies(spark, folder), ["event_type"]), "fetch_latency_ms", "event_type")


@query
def segment_codec_zstd(spark, folder):
    from tidelog.sources.segment import decode_batches, encode_batches

    records = decode_batches(encode_batches(v.log(spark, folder), 700, "zstd"))
    return records.select(*TP, "log_offset", "batch_base_offset", "codec", F.col("value").cast("string").alias("value"))


# segment files and streams


@query
def segment_codec_round_trip(spark, folder):
    from tidelog.sources.segment import decode_batches, encode_batches

    records = decode_batches(encode_batches(v.log(spark, folder), 1000, "lz4"))
    return records.select(*TP, "log_offset", "ts_ms", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def stream_dedup(spark, folder):
    from tidelog.streaming import follow as s

    e = s.follow(spark, folder, "events").select("event_id", "user_id", "ts")
    return s.drain(s.without_repeats(e.union(e.filter("event_id % 10 = 0")), ["event_id"])).select("event_id", "user_id")


@query
def stream_session(spark, folder):
    from tidelog.streaming import follow as s

    return s.drain(s.sessions(s.follow(spark, folder, "events"), ["user_id"]))


@query
def stream_tumbling(spark, folder):
    from tidelog.streaming import follow as s

    return s.drain(s.tumbling(s.follow(spark, folder, "events"), ["event_type"]))


@query
def stream_idempotent(spark, folder):
    from tidelog.streaming import follow as s
    from tidelog.streaming.state import idempotent

    e = s.follow(spark, folder, "events").filter("event_id % 2100 <> 1213")  # lost: what follows is out of order
    e = e.select((F.col("event_id") % 50 + 1).alias("producer_id"), F.lit(0).cast("long").alias("epoch"), div("event_id", 50).alias("base_sequence"), (F.col("event_id") * 2).alias("arrival"), F.lit(1).cast("long").alias("n_records"))
    again = e.filter("arrival % 20 = 0").withColumn("arrival", F.col("arrival") + 5)
    return s.drain(idempotent(e.union(again)))


@query
def stream_share_leases(spark, folder):
    from tidelog.streaming import follow as s
    from tidelog.streaming.state import leases

    kind = F.element_at(F.array(*[F.lit(x) for x in ("acquire", "accept", "acquire", "release", "renew", "acquire", "reject", "yield")]), (F.col("event_id") % 8 + 1).cast("int"))
    e = s.follow(spark, folder, "events")
    actions = e.select((F.col("event_id") % 40).alias("range_id"), F.col("event_id").alias("seq"), kind.alias("action"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("member_id"), F.unix_millis("ts").alias("at_ms"))
    return s.drain(leases(actions, lock_ms=7_200_000))
