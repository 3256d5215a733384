"""Operators along an order against loops in plain Python, and rules worked out by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.functions import values
from tidelog.operators import catalog, groups, log, metrics, producer, ranking, retention, share
from tidelog.sources import segment

TP = "topic string, partition long, "
BATCH = TP + "arrival long, base_offset long, last_offset long"


def verdicts(batches):
    end, out = defaultdict(int), {}
    for t, p, arrival, base, last in sorted(batches, key=lambda b: b[2]):
        if last < end[t, p]:
            out[t, p, arrival] = "already_applied"
        elif base != end[t, p]:
            out[t, p, arrival] = "gap"
        else:
            out[t, p, arrival] = "appended"
            end[t, p] = last + 1
    return out


def test_only_an_appended_batch_moves_the_end(spark):
    rows = [("t", 0, i, lo, hi) for i, (lo, hi) in enumerate([(0, 9), (20, 29), (30, 39), (10, 19), (35, 49)])]
    got = {x.arrival: x.verdict for x in log.classify_appends(spark.createDataFrame(rows, BATCH), "arrival").collect()}
    assert [got[i] for i in range(5)] == ["appended", "gap", "gap", "appended", "gap"]
    r = random.Random(5)
    rows = [("t", p, k, lo, lo + r.randint(0, 4)) for p in (0, 1) for k in range(150) for lo in [r.randint(max(0, k // 4 - 6), k // 4 + 6)]]
    out = log.classify_appends(spark.createDataFrame(rows, BATCH), "arrival").collect()
    assert {(x.topic, x.partition, x.arrival): x.verdict for x in out} == verdicts(rows)
    assert {x.verdict for x in out} == {"appended", "gap", "already_applied"}
    assert log.classify_appends(spark.createDataFrame([], BATCH), "arrival").count() == 0


def test_requests_are_fenced_by_the_epoch_of_their_time(spark):
    rows = [("a", 0, 0, True), ("a", 0, 1, False), ("a", 1, 2, True), ("a", 0, 3, False), ("a", 1, 4, False), ("b", 0, 5, False)]
    df = spark.createDataFrame(rows, "transactional_id string, epoch long, seq long, is_init boolean")
    got = {x.seq: x.verdict for x in producer.judged_requests(df, "seq").collect()}
    assert got == {0: "init", 1: "ok", 2: "init", 3: "fenced", 4: "ok", 5: "unknown"}


def test_a_duplicate_is_told_the_last_accepted_offset(spark):
    rows = [(1, 0, "accepted", 10), (1, 1, "duplicate", None), (1, 2, "accepted", 14), (1, 3, "duplicate", None), (2, 4, "out_of_order", None)]
    df = spark.createDataFrame(rows, "producer_id long, arrival long, verdict string, last_offset long")
    assert {x.arrival: x.answer for x in producer.duplicate_answers(df).collect()} == {0: 10, 1: 10, 2: 14, 3: 14, 4: None}


def test_reserved_codecs_have_no_name(spark):
    df = spark.range(32).select("id", values.codec_of(F.col("id").cast("int")).alias("c"))
    assert {x.id: x.c for x in df.collect()} == {i: ("none", "lz4", "zstd", *[None] * 5)[i & 7] for i in range(32)}


def test_rates_without_time(spark):
    df = spark.createDataFrame([("a", 5, 100), ("b", 5, 100), ("b", 5, 2100)], "k string, bytes long, ts_ms long")
    got = {x.k: (x.records_per_s, x.mb_per_s) for x in metrics.throughput(df, ["k"]).collect()}
    assert got == {"a": (None, None), "b": (1.0, 5e-6)}


def test_token_buckets_are_the_loops(spark):
    r = random.Random(11)
    rows, at = [], defaultdict(int)
    for seq in range(600):
        c = r.choice([1, 1, 1, 2, 3])
        at[c] += r.choice([0, 1, 40, 900, 200_000])
        rows.append((c, at[c], seq, r.randint(0, 90)))
    level, last, want = {}, {}, {}
    for c, t, seq, amount in sorted(rows, key=lambda x: (x[1], x[2])):
        level[c] = min(100.0, level.get(c, 100.0) + (t - last.get(c, t)) * 0.1) - amount
        last[c] = t
        want[seq] = min(60_000.0, -level[c] / 100.0 * 1000.0) if level[c] < 0 else 0.0
    out = metrics.token_bucket(spark.createDataFrame(rows, "client_id long, at_ms long, seq long, amount long"), 100.0).collect()
    assert {x.seq: pytest.approx(x.delay_ms, abs=1e-6) for x in out} == want and any(want.values())


def test_nearest_ranks_are_the_sorted_lists(spark):
    r = random.Random(2)
    rows = [(k, r.randint(0, 300_000)) for k in ("a", "b", None) for _ in range(r.randint(1, 200))]
    got = {(x.k, x.p): x.ms for x in metrics.nearest_rank(spark.createDataFrame(rows, "k string, ms long"), ["k"], [0, 1, 50, 99, 100]).collect()}
    for k in ("a", "b", None):
        v = sorted(m for x, m in rows if x == k)
        for p in (0, 1, 50, 99, 100):
            assert got[k, p] == v[int(p / 100 * (len(v) - 1) + 0.5)]


def rolled(rows, most, ms):
    out, state = defaultdict(int), {}
    for t, p, o, size, ts in sorted(rows):
        base, used, born, now = state.get((t, p), (o, 0, ts, ts))
        now = max(now, ts)
        if used and (used + size > most or (ms is not None and now - born >= ms)):
            base, used, born = o, 0, now
        state[t, p] = (base, used + size, born, now)
        out[t, p, base] += 1
    return dict(out)


def test_segments_roll_like_the_loop(spark):
    r = random.Random(4)
    rows = [("t", p, o, r.choice([5, 20, 90, 400]), 1000 * o + r.randint(-4000, 4000)) for p in (0, 1) for o in range(120)]
    df = spark.createDataFrame(rows, TP + "log_offset long, encoded_size long, ts_ms long")
    for most, ms in ((300, None), (300, 9000), (10**9, 7000), (1, None)):
        got = {(x.topic, x.partition, x.segment_base): x.n_records for x in retention.roll_segments(df, most, ms).collect()}
        assert got == rolled(rows, most, ms)


def test_paths_are_followed_run_by_run(spark, monkeypatch):
    r = random.Random(11)
    links = [("t", p, o * 3, min(o + r.choice([1, 1, 2, 9]), 199) * 3 if o < 199 and r.random() < 0.999 else None, o == 5) for p in (0, 1) for o in range(200)]
    want = set()
    for p in (0, 1):
        to, at = {x[2]: x[3] for x in links if x[1] == p}, 15
        while at is not None:
            want.add((p, at))
            at = to[at]
    df = spark.createDataFrame(links, TP + "log_offset long, _next long, _first boolean")
    cuts = []
    monkeypatch.setattr(ranking, "cut", lambda d, f=ranking.cut: cuts.append(1) or f(d))
    for width, most in ((16, 40), (1000, 5)):  # before: 3 + 2 for each doubling of the path, all rows in each
        cuts.clear()
        got = ranking.reached(df, ["topic", "partition"], "log_offset", "_next", "_first", width)
        assert {(x.partition, x.log_offset) for x in got.collect()} == want and len(cuts) <= most


def test_times_that_stand_still_are_looked_up_once(spark, monkeypatch):
    rows = [("t", p, o, 10, 1000 * min(o, 20)) for p in (0, 1) for o in range(120)]
    df = spark.createDataFrame(rows, TP + "log_offset long, encoded_size long, ts_ms long")
    asked = []
    monkeypatch.setattr(retention, "ceiling_join", lambda left, *a, f=retention.ceiling_join: asked.append((left.count(), a[2])) or f(left, *a))
    got = {(x.topic, x.partition, x.segment_base): x.n_records for x in retention.roll_segments(df, 300, 7000).collect()}
    assert got == rolled(rows, 300, 7000) and dict((on, n) for n, on in asked)["_old"] == 42  # the rises: before, 240 rows in one run of time


def test_index_entries_come_by_bytes(spark):
    r = random.Random(6)
    rows = [("t", p, o * 5, r.choice([10, 70, 500])) for p in (0, 1) for o in range(100)]
    want = set()
    for p in (0, 1):
        since = None
        for _, _, base, size in (x for x in rows if x[1] == p):
            if since is None or since >= 200:
                want.add((p, base))
                since = 0
            since += size
    got = log.byte_index(spark.createDataFrame(rows, TP + "base_offset long, size_bytes long"), 200)
    assert {(x.partition, x.base_offset) for x in got.collect()} == want


def test_acks_coalesce_across_runs(spark):
    r = random.Random(7)
    rows = [("t", p, o, r.choice(["Accept", "Accept", "Accept", "Reject"])) for p in (0, 1) for o in range(300) if r.random() < 0.95]
    want, last = set(), {}
    for t, p, o, kind in sorted(rows):
        lo, hi = last.get((p, kind), (o, o - 1))
        if hi != o - 1:
            want.add((p, kind, lo, hi))
            lo = o
        last[p, kind] = (lo, o)
    want |= {(p, kind, *v) for (p, kind), v in last.items()}
    df = spark.createDataFrame([*rows, *rows[:40]], TP + "log_offset long, ack_type string")
    for width in (4, 7, 1000):
        assert {(x.partition, x.ack_type, x.first_offset, x.last_offset) for x in share.coalesce_acks(df, width).collect()} == want


def test_acquire_redelivers_splits_and_takes_fresh(spark):
    ranges = spark.createDataFrame([("t", 0, 0, 9, "Available", 2), ("t", 0, 10, 19, "Acquired", 1), ("t", 0, 20, 29, "Available", 1), ("t", 1, 0, 9, "Archived", 5)], TP + "first_offset long, last_offset long, state string, delivery_count long")
    ends = spark.createDataFrame([("t", 0, 40), ("t", 1, 12), ("t", 2, 3)], TP + "leo long")
    got = lambda n: sorted((x.partition, x.first_offset, x.last_offset, x.state, x.acquired_by, x.delivery_count) for x in share.acquire(ranges, ends, "m", n).collect())
    assert got(15) == [(0, 0, 9, "Acquired", "m", 3), (0, 20, 24, "Acquired", "m", 2), (0, 25, 29, "Available", None, 1), (1, 10, 11, "Acquired", "m", 1), (2, 0, 2, "Acquired", "m", 1)]
    assert [x for x in got(23) if not x[0]] == [(0, 0, 9, "Acquired", "m", 3), (0, 20, 29, "Acquired", "m", 2), (0, 30, 32, "Acquired", "m", 1)]


def test_rules_meet_requests_by_their_heads(spark):
    r = random.Random(8)
    name = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    rules = [(r.choice(["*", "u", "v"]), r.choice(["*", "h"]), r.choice(["All", "Read"]), r.choice(["Topic", "Group"]), x, kind, r.choice(["Allow", "Allow", "Deny"])) for _ in range(30) for kind in [r.choice(["literal", "prefix", "glob"])] for x in [name() if kind != "glob" else r.choice(["*", "*b", "a*", "a*b", "ab"])]]
    rules += [("w", "*", "All", "Topic", "*", "literal", "Allow")]
    asked = [(i, r.choice("uvw"), r.choice("hg"), r.choice(["Read", "Write"]), r.choice(["Topic", "Group"]), name()) for i in range(200)]

    def fits(rule, q):
        who, host, op, kind, res, pattern, _ = rule
        import fnmatch

        same = who in ("*", q[1]) and host in ("*", q[2]) and op in ("All", q[3]) and kind == q[4]
        return same and {"literal": res in ("*", q[5]), "prefix": q[5].startswith(res), "glob": fnmatch.fnmatchcase(q[5], res)}[pattern]

    want = {}
    for q in asked:
        found = {x[6] for x in rules if fits(x, q)}
        want[q[0]] = "Allow" in found and "Deny" not in found
    df = spark.createDataFrame(asked, "request_id long, principal string, host string, operation string, resource_type string, resource string")
    table = spark.createDataFrame(rules, "principal string, host string, operation string, resource_type string, resource string, pattern string, permission string")
    assert {x.request_id: x.allowed for x in catalog.authorize(df, table).collect()} == want and len(set(want.values())) == 2
    assert catalog.list_rules(table, principal="*", host="", operation="Any", permission=None).count() == len(rules)


META = "seq long, op string, topic string, n_partitions long, replication long, configs map<string,string>, removed array<string>, node long, address string"


def test_metadata_folds_by_hand(spark):
    rows = [
        (1, "create", "a", 3, 1, None, None, None, None), (2, "create", "a", 4, 1, None, None, None, None), (3, "alter", "a", None, None, {"x": "1", "y": "1"}, None, None, None), (4, "delete", "a", None, None, None, None, None, None),
        (5, "alter", "a", None, None, {"z": "0"}, None, None, None), (6, "create", "a", 5, 2, None, None, None, None), (7, "alter", "a", None, None, {"x": "2", "y": "2"}, ["x"], None, None), (8, "alter", "a", None, None, {}, ["y"], None, None),
        (9, "create", "b", 0, 1, None, None, None, None), (10, "create", "c", 1, 1, None, None, None, None), (11, "alter", "c", None, None, {"x": "1"}, None, None, None), (12, "replace", "c", None, None, {"y": "9"}, None, None, None), (13, "alter", "c", None, None, {"w": "3"}, None, None, None),
        (14, "register", None, None, None, None, None, 1, "h:1"), (15, "register", None, None, None, None, None, 2, "h:2"), (16, "unregister", None, None, None, None, None, 1, None), (17, "register", None, None, None, None, None, 2, "h:3"),
    ]
    log_ = spark.createDataFrame(rows, META)
    made = {x.seq: x.verdict for x in catalog.judged_creations(log_).collect()}
    assert made == {1: "created", 2: "already_exists", 6: "created", 9: "invalid", 10: "created"}
    topics = catalog.topics_in_force(log_)
    assert {(x.topic, x.seq, x.n_partitions, x.replication) for x in topics.collect()} == {("a", 6, 5, 2), ("c", 10, 1, 1)}
    assert {(x.topic, x.key, x.value) for x in catalog.configs_in_force(log_, topics).collect()} == {("a", "x", "2"), ("c", "y", "9"), ("c", "w", "3")}
    assert {(x.node, x.address) for x in catalog.brokers_in_force(log_).collect()} == {(2, "h:3")}


def test_groups_by_hand(spark):
    m = spark.createDataFrame([(1, 1, 100, 50), (1, 2, 10, 50), (2, 3, 10, 50)], "group_no long, member_id long, last_heartbeat_ms long, session_timeout_ms long")
    a = spark.createDataFrame([(1, 1, 4), (1, 1, 2)], "group_no long, member_id long, partition long")
    assert {(x.group_no, x.n_members) for x in groups.list_groups(m, 120).collect()} == {(1, 1), (2, 0)}
    assert {(x.group_no, x.state, x.member_id, tuple(x.partitions or ())) for x in groups.describe_groups(m, a, 120).collect()} == {(1, "Stable", 1, (2, 4)), (2, "Empty", None, ())}
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 9)], "request_id long, group_no long, member_id long")
    assert {(x.request_id, x.error, tuple(x.partitions)) for x in groups.synced(asked, m, a).collect()} == {(1, None, (2, 4)), (2, None, ()), (3, "unknown_member", ())}
    joins = spark.createDataFrame([(1, "i", 5), (1, "j", 6), (1, "i", 9)], "group_no long, instance_id string, seq long")
    assert {(x.instance_id, x.member_id, x.joins) for x in groups.static_members(joins).collect()} == {("i", "i-3", 2), ("j", "j-2", 1)}
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 7)], TP + "leo long")
    offsets = spark.createDataFrame([("g", "t", 0, 3)], "group_id string, " + TP + "log_offset long")
    subscribed = spark.createDataFrame([("g", "t", 0), ("g", "t", 1)], "group_id string, topic string, partition long")
    assert {(x.partition, x.lag) for x in groups.lag(offsets, ends, subscribed).collect()} == {(0, 6), (1, 7)}
    c = spark.createDataFrame([("g", "t", 0, 3, 1, "x"), ("g", "t", 0, 2, 2, None)], "group_id string, " + TP + "log_offset long, commit_seq long, metadata string")
    assert [(x.log_offset, x.metadata) for x in groups.committed_with_metadata(c).collect()] == [(2, "")]


def test_truncation_ends_at_a_whole_batch(spark):
    b = spark.createDataFrame([("t", 0, 0, 4), ("t", 0, 5, 9), ("t", 1, 0, 4), ("t", 2, 0, 9)], TP + "base_offset long, last_offset long")
    ends = spark.createDataFrame([("t", 0, 10, 9), ("t", 1, 5, 5), ("t", 2, 10, 3)], TP + "leo long, hw long")
    assert {(x.partition, x.leo, x.hw) for x in retention.truncated_ends(b, ends, 7).collect()} == {(0, 5, 5), (1, 5, 5), (2, 0, 0)}


def test_segments_are_lost_in_silence_nowhere(spark, tmp_path):
    with pytest.raises(ValueError):
        segment.encode([(i, 0, None, b"") for i in range(segment.MOST_RECORDS + 1)])
    one, two = (segment.encode([(o, 0, None, b"x")]) for o in (0, 1))
    broken = one[:-1] + bytes([one[-1] ^ 1])
    assert [b["batch_base_offset"] for b in segment.batches_of(one + two[:-3])] == [0]
    for data, active in ((one + two[:-3], False), (broken + two, True), (one + b"\0" * 60, True)):
        with pytest.raises(ValueError):
            list(segment.batches_of(data, active))
    (tmp_path / "t-0").mkdir()
    (tmp_path / "t-0" / "00000000000000000000.log").write_bytes(one)
    (tmp_path / "t-0" / "00000000000000000001.log").write_bytes(two + one[:9])
    assert sorted(x.log_offset for x in segment.read_segments(spark, str(tmp_path)).collect()) == [0, 1]
    (tmp_path / "t-0" / "00000000000000000000.log").write_bytes(one[:-1])
    with pytest.raises(Exception, match="byte 0 of a segment"):
        segment.read_segments(spark, str(tmp_path)).collect()


def test_label_values_are_escaped(spark):
    df = spark.createDataFrame([("m", 'a"b\\c\nd', 1)], "metric string, topic string, value long")
    assert metrics.prometheus(df).first().line == 'm{topic="a\\"b\\\\c\\nd"} 1'
