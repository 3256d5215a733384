"""Cases worked out by hand, models in plain Python, and layouts."""

import random
import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.functions import policy, routing, values
from tidelog.operators import catalog, compaction, groups, isolation, log, metrics, producer, ranking, replication, retention, share
from tidelog.sources import segment
from tidelog.streaming import follow
from tidelog.streaming.state import idempotent, lease_step, leases

LOG = "topic string, partition long, log_offset long, ts_ms long, key string, value string, segment_base long, encoded_size long, is_active_segment boolean"


def records(spark, rows, base=0, active=False):
    return spark.createDataFrame([("t", 0, o, ts, k, v, base, 74 + len(v or ""), active) for o, k, v, ts in rows], LOG)


def survivors(df):
    return sorted(x.log_offset for x in df.filter("survives").collect())


def test_compaction_by_hand(spark):
    now = 10**12
    purge = records(spark, [(0, "A", "val1", 1), (1, "A", "val2", 1), (2, "B", None, 1)])
    assert survivors(compaction.judged(purge, now, 1000)) == [1]
    live = records(spark, [(0, "u", "val_1", 1000), (1, "u", None, now)])
    assert survivors(compaction.judged(live, now, 86_400_000)) == [1]
    empty = records(spark, [(0, "A", "first", 1), (1, "A", "", 1)])
    assert survivors(compaction.judged(empty, now, 1)) == [1]
    keyless = records(spark, [(0, None, "x", 1), (1, None, "x", 1), (2, "k", "v1", 1), (3, "k", "v2", 1)])
    assert survivors(compaction.judged(keyless)) == [0, 1, 3]
    three = records(spark, [(0, "u1", "a", 1), (1, "u2", "a", 1), (2, "u1", "b", 1)]).unionByName(records(spark, [(3, "u2", "b", 1), (4, "u1", "c", 1)], 3)).unionByName(records(spark, [(5, "u3", "a", 1)], 5, True))
    assert sorted(x.log_offset for x in compaction.compact(three, 0.5).collect()) == [3, 4, 5]
    gate = records(spark, [(i, f"k{max(i, 1)}", "v", 1) for i in range(10)])
    assert compaction.compact(gate, 0.5).count() == 10 and compaction.compact(gate, 0.05).count() == 9


def test_read_committed_by_hand(spark):
    rows = spark.createDataFrame([("t", 0, o, 1, None, str(o), c) for o, c in ((0, False), (1, False), (2, False), (3, True), (4, False))], "topic string, partition long, log_offset long, ts_ms long, key string, value string, is_control boolean")
    ends = spark.createDataFrame([("t", 0, 5, 5)], "topic string, partition long, leo long, hw long")
    schema = "topic string, partition long, producer_id long, first_offset long, last_offset long, status string"
    see = lambda *t, **k: sorted(x.log_offset for x in isolation.committed_read(k.pop("rows", rows), spark.createDataFrame(t, schema), ends, **k).collect())
    assert see(("t", 0, 1, 1, 3, "Aborted")) == [0, 4]
    assert see(("t", 0, 1, 1, 3, "Committed")) == [0, 1, 2, 4]
    assert see(("t", 0, 1, 1, None, "Ongoing")) == [0]
    own = rows.withColumn("producer_id", F.when(F.col("log_offset") == 2, 9).otherwise(1).cast("long"))
    assert see(("t", 0, 1, 1, 3, "Aborted"), rows=own, by_producer=True) == [0, 2, 4]


def test_running_values_across_runs(spark):
    r = random.Random(3)
    rows = [("t", p, o, r.randint(0, 99)) for p in (0, 1) for o in range(200)]
    df = spark.createDataFrame(rows, "topic string, partition long, o long, x long")
    keys = ["topic", "partition"]
    out = ranking.running_sum(ranking.running_max(ranking.sequence_numbers(df, keys, "o", "n", 16), keys, "o", "x", "top", 16), keys, "o", "x", "left", 16, backwards=True)
    by = defaultdict(list)
    for x in sorted(out.collect(), key=lambda x: (x.partition, x.o)):
        by[x.partition].append(x)
    for p, xs in by.items():
        v = [q[3] for q in rows if q[1] == p]
        assert [x.n for x in xs] == list(range(200)) and [x.top for x in xs] == [max(v[: i + 1]) for i in range(200)] and [x.left for x in xs] == [sum(v[i:]) for i in range(200)]
    index = df.filter("o % 50 = 7").select(*keys, F.col("o").alias("at"), "x")
    got = {(x.partition, x.o): (x.at, x.x) for x in ranking.floor_join(df.select(*keys, "o"), index, keys, "o", "at", ["at", "x"], 16).collect()}
    v = {(q[1], q[2]): q[3] for q in rows}
    for (p, o), (at, x) in got.items():
        want = max((a for a in (7, 57, 107, 157) if a <= o), default=None)
        assert at == want and x == (None if want is None else v[p, want])


def test_fetch_serves_an_oversized_batch(spark):
    b = spark.createDataFrame([("t", 0, 0, 4, 900), ("t", 0, 5, 9, 50), ("t", 0, 10, 14, 50)], "topic string, partition long, base_offset long, last_offset long, size_bytes long")
    ends = spark.createDataFrame([("t", 0, 20)], "topic string, partition long, hw long")
    bases = lambda start, most, hw=ends: sorted(x.base_offset for x in log.fetch_batches(b, start, most, hw).collect())
    assert bases(2, 100) == [0] and bases(5, 100) == [5, 10] and bases(5, 60) == [5] and bases(0, 960) == [0, 5]
    assert bases(0, 10**6, spark.createDataFrame([("t", 0, 10)], "topic string, partition long, hw long")) == [0, 5]


def test_assignments_cover_once_and_are_even(spark):
    m = spark.createDataFrame([(g, i) for g, n in ((0, 3), (1, 7), (2, 60)) for i in range(n)], "group_no long, member_id long")
    before = groups.assign_range(m, 50)
    for out in (before, groups.assign_round_robin(m, 50), groups.assign_sticky(m.filter("member_id <> 1"), before, 50), groups.assign_sticky(m, before.limit(0), 50)):
        rows = out.collect()
        for g in (0, 1, 2):
            own = [x for x in rows if x.group_no == g]
            assert sorted(x.partition for x in own) == list(range(50))
            n = defaultdict(int)
            for x in own:
                n[x.member_id] += 1
            assert max(n.values()) - min(n.values()) <= 1
    old = {(x.group_no, x.partition): x.member_id for x in before.collect()}
    kept = sum(old[x.group_no, x.partition] == x.member_id for x in groups.assign_sticky(m.filter("member_id <> 1"), before, 50).collect())
    assert kept >= 150 - 17 - 8 - 1


def test_acks_split_leases(spark):
    L = spark.createDataFrame([("t", 0, 0, 9, "a", 1), ("t", 0, 10, 19, "b", 5), ("t", 0, 20, 20, "a", 2)], "topic string, partition long, first_offset long, last_offset long, acquired_by string, delivery_count long")
    a = spark.createDataFrame([("t", 0, 2, 3, "a", "Accept"), ("t", 0, 5, 5, "a", "Yield"), ("t", 0, 10, 12, "a", "Accept"), ("t", 0, 18, 25, "b", "Release"), ("t", 0, 20, 20, "a", "Reject")], "topic string, partition long, first_offset long, last_offset long, member_id string, ack_type string")
    got = sorted((x.first_offset, x.last_offset, x.state, x.delivery_count) for x in share.apply_acks(L, a).collect())
    assert got == [(0, 1, "Acquired", 1), (2, 3, "Acknowledged", 1), (4, 4, "Acquired", 1), (5, 5, "Available", 0), (6, 9, "Acquired", 1), (10, 17, "Acquired", 5), (18, 19, "Archived", 5), (20, 20, "Archived", 2)]


def test_idempotent_producers_in_batch_and_stream(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.randint(0, 3), r.randint(0, 1), r.randint(0, 6), k, r.randint(1, 2)) for k in range(400)]
    df = spark.createDataFrame(rows, "producer_id long, epoch long, base_sequence long, arrival long, n_records long")
    state, want = {}, {}
    for pid, epoch, base, k, n in rows:
        want[k], state[pid] = producer.verdict(state.get(pid), pid, epoch, base, n)
    assert {x.arrival: x.verdict for x in producer.idempotent_fold(df).collect()} == want
    assert set(want.values()) == set(producer.VERDICTS)
    assert [producer.verdict(s, 5, e, b, 1)[0] for s, e, b in ((None, 0, 9), ((1, 4), 0, 5), ((1, 4), 2, 0), ((1, 4), 1, 4), ((1, 4), 1, 6), ((1, 4), 1, 5))] == ["accepted", "fenced", "accepted", "duplicate", "out_of_order", "accepted"]
    df.coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/a.parquet")
    assert {x.arrival: x.verdict for x in follow.drain(idempotent(stream)).collect()} == want


def test_leases_in_a_stream_follow_the_model(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randint(0, 4), k, r.choice(["acquire", "acquire", "accept", "release", "reject", "renew", "yield"]), r.choice("ab"), k * 9000) for k in range(300)]
    state, want = {}, {}
    for i, k, action, member, at in rows:
        state[i], what = lease_step(state.get(i), action, member, at, 30_000, 3)
        want[k] = (what, state[i][0], state[i][2])
    df = spark.createDataFrame(rows, "range_id long, seq long, action string, member_id string, at_ms long")
    df.coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    out = follow.drain(leases(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/a.parquet"), 30_000, 3)).collect()
    assert {x.seq: (x.outcome, x.state, x.delivery_count) for x in out} == want
    after, _ = lease_step(("Acquired", "a", 3, 10), "acquire", "b", 10, 30_000, 3)
    assert after[0] == "Archived"


def test_sessions_of_stream_and_batch(spark, sf):
    got = {tuple(x) for x in follow.drain(follow.sessions(follow.follow(spark, sf, "events"), ["user_id"])).collect()}
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = {tuple(x) for x in e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_millis("w.start"), F.unix_millis("w.end"), "n").collect()}
    assert got <= whole and len(whole - got) <= 5


def test_segment_layout_and_codecs(spark, tmp_path):
    rows = [(7, 1000, b"k", b"v"), (8, 990, None, b""), (12, 1005, b"", None)]
    data = segment.encode(rows, producer=(42, 3, 9), transactional=True)
    assert data[0] == 0xC0 and struct.unpack(">I", data[1:5])[0] == len(data) - 5 and struct.unpack(">I", data[5:9])[0] == zlib.crc32(data[9:])
    assert len(data) == 53 + 3 * 20 + 2 and struct.unpack(">QI", data[9:21]) == (7, 5)
    for codec in segment.CODECS:
        b, end = segment.decode(segment.encode(rows, codec))
        assert b["records"] == rows and b["codec"] == codec and end == b["encoded_size"]
    for bad in (data[:-1], b"\0" + data[1:], data[:30] + bytes([data[30] ^ 1]) + data[31:]):
        with pytest.raises(ValueError):
            segment.decode(bad)
    (tmp_path / "my-topic-3").mkdir()
    more = segment.encode([(13, 1006, None, b"c")], "zstd", control=True)
    (tmp_path / "my-topic-3" / "00000000000000000007.log").write_bytes(data + more + data[:20])
    got = sorted((x.topic, x.partition, x.log_offset, x.is_control, x.key) for x in segment.read_segments(spark, str(tmp_path)).collect())
    assert got == [("my-topic", 3, 7, False, b"k"), ("my-topic", 3, 8, False, None), ("my-topic", 3, 12, False, b""), ("my-topic", 3, 13, True, None)]


def test_batches_span_arrow_batches_and_no_task_holds_all(spark):
    rows = [("t", p, o, 1000 - o, None if o % 7 == 0 else f"k{o}", None if o % 5 == 0 else "" if o % 5 == 1 else "v" * (o % 50)) for p in (0, 1) for o in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "topic string, partition long, log_offset long, ts_ms long, key string, value string").repartition(3)
    for records, codec in (("7", "zstd"), ("10000", "lz4")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            done = segment.encode_batches(df, 20, codec)
            got = segment.decode_batches(done)
            assert sorted((x.topic, x.partition, x.log_offset, x.ts_ms, x.key and x.key.decode(), None if x.value is None else x.value.decode()) for x in got.collect()) == sorted(rows)
            bases = sorted((x.partition, x.batch_base_offset, x.batch_last_offset) for x in got.select("partition", "batch_base_offset", "batch_last_offset").distinct().collect())
            assert bases == [(p, min(b), max(b)) for p in (0, 1) for n in range(15) for b in [[o for o in range(0, 300, 3) if o // 20 == n]]]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in done._jdf.queryExecution().optimizedPlan().toString()  # a row of all records of a batch: 10,000 of them make an Arrow batch


def test_segments_roll_and_expire(spark):
    rows = [(o, "k", "x" * 26, o) for o in range(10)]
    df = records(spark, rows)
    assert [(x.segment_base, x.n_records) for x in retention.roll_segments(df, 350).orderBy("segment_base").collect()] == [(0, 3), (3, 3), (6, 3), (9, 1)]
    s = spark.createDataFrame([("t", 0, b, 100, b, b == 30) for b in (0, 10, 20, 30)], "topic string, partition long, segment_base long, size_bytes long, newest_ms long, is_active_segment boolean")
    gone = lambda d: sorted(x.segment_base for x in d.collect())
    assert gone(retention.expired_by_size(s, 250)) == [0, 10] and gone(retention.expired_by_time(s, 100, 85)) == [0, 10]
    assert gone(retention.trimmed_before(s, 20)) == [20, 30] and gone(retention.expired_by_size(s, 0)) == [0, 10, 20]


def test_patterns_names_and_addresses(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    g = lambda p, t: val(policy.glob_match(F.lit(p), F.lit(t)))
    assert g("a*c", "abbc") and g("*", "") and g("a.c*", "a.cx") and not g("a.c", "abc") and not g("a*", "ba") and g("*$1*", "x$1\ny")
    c = lambda n, a: val(policy.cidr_contains(n, F.lit(a)))
    assert c("10.1.0.0/16", "10.1.255.3") and not c("10.1.0.0/16", "10.2.0.1") and c("0.0.0.0/0", "1.2.3.4") and not c("10.0.0.0/8", "nope")
    assert c("2001:db8::/32", "2001:db8:1::5") and not c("2001:db8::/32", "2001:db9::") and not c("2001:db8::/32", "10.0.0.1")
    n = lambda t: val(policy.topic_name_ok(F.lit(t)))
    assert n("a.b_c-1") and n("é") and not n("a..b") and not n("__x") and not n("") and not n("a" * 250) and not n("a b") and n("a" * 249)
    assert val(routing.partition_for(F.lit("abc"), 12)) == zlib.crc32(b"abc") % 12 and val(routing.partition_for(F.lit(""), 12)) == 0 and val(routing.partition_for(F.lit(None).cast("string"), 12)) == 0
    assert routing.placement_seed("") == 0xCBF29CE484222325 and routing.placement_seed("a") == 0xAF63DC4C8601EC8C
    assert val(values.codec_of(F.lit(18))) == "zstd" and val(values.is_control(F.lit(18))) and not val(values.is_transactional(F.lit(18)))
    assert val(values.optional_long(F.lit(" 12 "))) == 12 and val(values.optional_long(F.lit("-1"))) is None and val(values.optional_long(F.lit("x"))) is None
    assert val(values.one_of(F.lit(" LZ4 "), values.CODECS)) == "lz4"


def test_deny_wins(spark):
    req = spark.createDataFrame([(1, "User:a", "h", "Read", "Topic", "x"), (2, "User:b", "h", "Read", "Topic", "x"), (3, "User:a", "h", "Read", "Topic", "y")], "request_id long, principal string, host string, operation string, resource_type string, resource string")
    rules = spark.createDataFrame([("*", "*", "All", "Topic", "x", "literal", "Allow"), ("User:a", "*", "Read", "Topic", "x", "literal", "Deny")], "principal string, host string, operation string, resource_type string, resource string, pattern string, permission string")
    assert sorted(map(lambda x: (x.request_id, x.allowed), catalog.authorize(req, rules).collect())) == [(1, False), (2, True), (3, False)]
    assert catalog.list_rules(rules, principal="User:a", host=None).count() == 1


def test_each_request_gets_the_answer_of_its_fields(spark):
    asked = [(1, "a", None, "Read", "Topic", "x"), (1, "a", "h", "Read", "Topic", "y"), (None, "a", "h", "Read", "Topic", "x"), (2, None, "h", "Read", "Topic", "x"), (3, "a", "h", "Read", "Topic", None)]
    req = spark.createDataFrame(asked, "request_id long, principal string, host string, operation string, resource_type string, resource string")
    rules = spark.createDataFrame([("*", "*", "All", "Topic", "x", "literal", "Allow"), ("a", "h", "Read", "Topic", "y", "literal", "Deny")], "principal string, host string, operation string, resource_type string, resource string, pattern string, permission string")
    got = catalog.authorize(req, rules)
    assert {tuple(x)[:6]: x.allowed for x in got.collect()} == dict(zip(asked, [True, False, True, True, False], strict=True))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[request_id", plan)  # a group a request is as large as the input


def test_watermarks_votes_and_failover(spark):
    parts = spark.createDataFrame([("t", 0, 10, 2), ("t", 1, 10, 1)], "topic string, partition long, leo long, min_isr long")
    reps = spark.createDataFrame([("t", 0, 9), ("t", 0, 6), ("t", 1, 0)], "topic string, partition long, watermark long")
    assert {x.partition: x.hw for x in replication.high_watermarks(parts, reps).collect()} == {0: 7, 1: 10}
    acked = replication.fully_acked(reps.withColumn("want", F.lit(6)), "want", 2)
    assert {x.partition: x.acked for x in acked.collect()} == {0: True, 1: False}
    p = spark.createDataFrame([("t", 0, 1, [1, 2, 3], [1, 2]), ("t", 1, 4, [4, 2], [4])], "topic string, partition long, leader long, replicas array<long>, isr array<long>")
    acks = spark.createDataFrame([(1, 0), (2, 95)], "node long, last_ack_ms long")
    assert {x.partition: (x.new_leader, x.new_isr) for x in replication.failover(p, acks, 100, 50).collect()} == {0: (2, [2]), 1: (4, [4])}


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([("a", m) for m in (1, 2, 5, 30, 9000)], "k string, ms long")
    h = {x.le: x.cumulative for x in metrics.latency_histogram(s, ["k"]).collect()}
    assert h["1"] == 1 and h["5"] == 3 and h["50"] == 4 and h["5000"] == 4 and h["+Inf"] == 5
    assert {x.p: x.ms for x in metrics.nearest_rank(s, ["k"], [0, 50, 99, 100]).collect()} == {0: 1, 50: 5, 99: 9000, 100: 9000}
    q = spark.createDataFrame([(1, 0, 0, 80), (1, 0, 1, 70), (1, 1000, 2, 10), (2, 0, 0, 100)], "client_id long, at_ms long, seq long, amount long")
    assert {(x.client_id, x.seq): x.delay_ms for x in metrics.token_bucket(q, 100.0).collect()} == {(1, 0): 0.0, (1, 1): 500.0, (1, 2): 0.0, (2, 0): 0.0}


def test_rosters(spark):
    c = spark.createDataFrame([("t", None, "create", None, None, None, 1), ("t", 0, "leader", 1, [1, 2], [1, 2, 3], 2), ("t", 0, "leader", 2, [2, 9], [], 3), ("t", 1, "leader", 5, [5], [], 4)], "topic string, partition long, op string, leader long, isr array<long>, replicas array<long>, seq long")
    assert {x.partition: (x.leader, x.replicas) for x in catalog.rosters(c).collect()} == {0: (2, [1, 2, 3, 9]), 1: (5, [5])}


def test_follow_reads_a_folder_of_part_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, parts = (follow.drain(follow.follow(spark, folder, "events")) for folder in (sf, str(tmp_path)))
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, one.collect())) and parts.count() == events.count() > 0
