"""DuckDB SQL for the queries. Views of the virtual log come first, as far as a query needs them."""

from __future__ import annotations

import re

NOW, DAY = 1706659200000, 86_400_000
MS = "(epoch_us({x}) // 1000)"
#: CRC-32 of an ASCII string that isn't empty, byte by byte. Fixed value: the reflected polynomial 3988292384.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({k}) + 1), lambda i: ascii(({k})[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for _ in range(8)]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"

VIEWS = {
    "vlog": f"""SELECT topic, partition, cast(row_number() OVER (PARTITION BY partition ORDER BY event_id) - 1 AS bigint) AS log_offset, event_id, ts_ms, key, value
FROM (SELECT 'events' AS topic, event_id, {MS.format(x="ts")} AS ts_ms, CASE WHEN event_id % 50 = 0 THEN NULL ELSE cast(user_id AS varchar) END AS key,
 CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE props END AS value,
 CASE WHEN event_id % 50 = 0 THEN 0 ELSE {CRC.format(k="cast(user_id AS varchar)")} % 4 END AS partition FROM events) e""",
    "vends": "SELECT topic, partition, cast(count(*) AS bigint) AS leo, cast(count(*) - 5 AS bigint) AS hw FROM vlog GROUP BY topic, partition",
    "vseg": """SELECT v.*, log_offset - log_offset % 500 AS segment_base, cast(73 + coalesce(length(key), 0) + coalesce(length(value), 0) AS bigint) AS encoded_size,
 log_offset - log_offset % 500 = (leo - 1) - (leo - 1) % 500 AS is_active_segment FROM vlog v JOIN vends d USING (topic, partition)""",
    "vbatch": """SELECT topic, partition, log_offset // 7 AS batch_no, min(log_offset) AS base_offset, max(log_offset) AS last_offset,
 cast(53 + sum(20 + coalesce(length(key), 0) + coalesce(length(value), 0)) AS bigint) AS size_bytes FROM vlog GROUP BY topic, partition, log_offset // 7""",
    "vtxn": """SELECT topic, partition, txn_seq, first_offset, last_offset,
 CASE WHEN first_offset >= leo * 9 // 10 THEN 'Ongoing' WHEN txn_seq % 4 = 1 THEN 'Aborted' ELSE 'Committed' END AS status
FROM (SELECT topic, partition, log_offset // 20 AS txn_seq, min(log_offset) AS first_offset, max(log_offset) AS last_offset FROM vlog GROUP BY topic, partition, log_offset // 20) t JOIN vends d USING (topic, partition) WHERE txn_seq % 4 <> 3""",
    "vrec": """SELECT v.topic, v.partition, v.log_offset, v.ts_ms, v.key, v.value, coalesce(t.status IN ('Committed', 'Aborted') AND v.log_offset = t.last_offset, false) AS is_control
FROM vlog v LEFT JOIN vtxn t ON v.topic = t.topic AND v.partition = t.partition AND v.log_offset BETWEEN t.first_offset AND t.last_offset""",
    "vattempts": """SELECT producer_id, base_sequence, epoch, attempt, event_id * 2 + attempt - 1 AS arrival
FROM (SELECT user_id AS producer_id, 0 AS epoch, event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bigint) AS base_sequence FROM events) s
CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 AS attempt) a WHERE attempt = 1 OR event_id % 10 = 0""",
    "vcommits": "SELECT concat('g', cast(cast(key AS bigint) % 8 AS varchar)) AS group_id, topic, partition, log_offset, event_id AS commit_seq FROM vlog WHERE key IS NOT NULL",
    "vleases": """SELECT topic, partition, log_offset // 50 AS range_no, min(log_offset) AS first_offset, max(log_offset) AS last_offset, concat('m', cast(log_offset // 50 % 3 AS varchar)) AS acquired_by,
 1 + log_offset // 50 % 5 AS delivery_count, min(ts_ms) AS acquired_at_ms, 30000 AS lock_timeout_ms FROM vlog GROUP BY topic, partition, log_offset // 50""",
    "vacks": """SELECT topic, partition, first_offset + 10 AS first_offset, first_offset + 29 AS last_offset, CASE WHEN range_no % 12 = 0 THEN 'm9' ELSE acquired_by END AS member_id,
 CASE range_no % 5 WHEN 0 THEN 'Accept' WHEN 1 THEN 'Release' WHEN 2 THEN 'Reject' WHEN 3 THEN 'Renew' ELSE 'Yield' END AS ack_type FROM vleases WHERE range_no % 2 = 0 AND last_offset - first_offset >= 29""",
    "vmembers": f"""SELECT user_id % 8 AS group_no, user_id AS member_id, max({MS.format(x="ts")}) AS last_heartbeat_ms, max(CASE WHEN event_type IN ('view', 'click') THEN {MS.format(x="ts")} END) AS last_progress_ms,
 3600000 * (1 + user_id % 6) AS session_timeout_ms FROM events GROUP BY user_id""",
    "latest": "SELECT topic, partition, key, max(log_offset) AS latest FROM vlog WHERE key IS NOT NULL GROUP BY topic, partition, key",
    "purged": f"SELECT v.topic, v.partition, v.key FROM vlog v JOIN latest l ON v.topic = l.topic AND v.partition = l.partition AND v.key = l.key AND v.log_offset = l.latest WHERE v.value IS NULL AND {NOW} - v.ts_ms > {DAY}",
    "judged": "SELECT s.*, s.is_active_segment OR s.key IS NULL OR s.log_offset = l.latest AS survives FROM vseg s LEFT JOIN latest l ON s.topic = l.topic AND s.partition = l.partition AND s.key = l.key",
    "ratios": "SELECT topic, partition, segment_base, cast(sum(encoded_size) AS bigint) AS total_bytes, cast(sum(CASE WHEN NOT survives THEN encoded_size ELSE 0 END) AS bigint) AS discarded_bytes FROM judged WHERE NOT is_active_segment GROUP BY topic, partition, segment_base",
    "segs": "SELECT topic, partition, segment_base, cast(sum(encoded_size) AS bigint) AS size_bytes, max(ts_ms) AS newest_ms, bool_or(is_active_segment) AS is_active_segment FROM vseg GROUP BY topic, partition, segment_base",
    "sized": "SELECT *, cast(sum(size_bytes) OVER (PARTITION BY topic, partition ORDER BY segment_base DESC) AS bigint) AS remaining FROM segs",
    "arriving": """SELECT topic, partition, base_offset + shift AS base_offset, last_offset + shift AS last_offset, (batch_no * 2 + delay) * 4 + copy AS arrival FROM (
 SELECT *, 0 AS copy, CASE WHEN batch_no % 11 = 5 THEN 9 ELSE 0 END AS delay, 0 AS shift FROM vbatch UNION ALL SELECT *, 1, 30, 0 FROM vbatch
 UNION ALL SELECT *, 2, 35, 0 FROM vbatch WHERE batch_no % 13 = 0 UNION ALL SELECT *, 2, 31, 3 FROM vbatch WHERE batch_no % 17 = 3 AND batch_no % 13 <> 0) a""",
    "vmeta": """SELECT event_id AS seq, CASE WHEN n < 2 THEN 'create' WHEN n = 2 THEN 'delete' WHEN n < 9 THEN 'alter' WHEN n = 9 THEN 'replace' WHEN n < 13 THEN 'register' WHEN n = 13 THEN 'unregister' END AS op,
 CASE user_id % 30 WHEN 7 THEN '__own' WHEN 8 THEN 'a..b' ELSE concat('t', user_id % 30) END AS topic, event_id % 13 AS n_partitions, 1 + event_id % 3 AS replication,
 ['retention.ms', 'cleanup.policy', 'segment.bytes'][event_id % 3 + 1] AS key, cast(event_id AS varchar) AS value, CASE WHEN event_id % 4 = 0 THEN ['retention.ms', 'segment.bytes'] ELSE [] END AS removed,
 user_id % 9 AS node, concat('10.0.0.', event_id % 250) AS address FROM (SELECT *, event_id % 20 AS n FROM events) e WHERE n < 14""",
    "tried": """SELECT *, op = 'create' AND NOT starts_with(topic, '__') AND NOT contains(topic, '..') AND n_partitions BETWEEN 1 AND 10000 AS ok FROM vmeta WHERE op IN ('create', 'delete')""",
    "created": """SELECT * FROM (SELECT *, lag(CASE WHEN op = 'delete' THEN 'delete' ELSE 'create' END) OVER (PARTITION BY topic ORDER BY seq) AS last_op FROM tried WHERE op = 'delete' OR ok) t WHERE op = 'create' AND coalesce(last_op, 'delete') = 'delete'""",
    "topics": "SELECT topic, max(seq) AS seq, max_by(n_partitions, seq) AS n_partitions, max_by(replication, seq) AS replication FROM created c WHERE NOT EXISTS (SELECT 1 FROM tried d WHERE d.op = 'delete' AND d.topic = c.topic AND d.seq > c.seq) GROUP BY topic",
    "vrules": """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, concat('User:', user_id % 5) AS principal, '*' AS host, ['Read', 'Write', 'All'][user_id % 3 + 1] AS operation, ['Topic', 'Group'][user_id % 2 + 1] AS resource_type,
 concat('r', user_id % 40) AS resource, 'literal' AS pattern, ['Allow', 'Deny', 'Allow', 'Allow'][user_id % 4 + 1] AS permission FROM events""",
    "rules": "SELECT principal, host, operation, resource_type, resource, pattern, permission FROM vrules GROUP BY ALL HAVING max_by(op, seq) = 'add'",
    "changes": f"""SELECT concat(partition, '-', txn_seq) AS transaction_id, txn_seq, unnest(steps) AS status, txn_seq * 10 + unnest(range(len(steps))) AS seq, {NOW} - txn_seq % 100 * 1000 AS created_at_ms
FROM (SELECT *, CASE status WHEN 'Committed' THEN ['Ongoing', 'PrepareCommit', 'Committed'] WHEN 'Aborted' THEN ['Ongoing', 'PrepareAbort', 'Aborted'] ELSE CASE WHEN txn_seq % 2 = 0 THEN ['Ongoing', 'PrepareCommit'] ELSE ['Ongoing'] END END AS steps FROM vtxn) t""",
    "last_change": "SELECT transaction_id, max_by(status, seq) AS status, max(seq) AS seq, max(created_at_ms) AS created_at_ms FROM changes GROUP BY transaction_id",
    "offsets": "SELECT group_id, topic, partition, max_by(log_offset, commit_seq) AS log_offset FROM vcommits GROUP BY group_id, topic, partition",
    "evicted": f"""SELECT *, CASE WHEN {NOW - 3 * DAY // 24} - last_heartbeat_ms > session_timeout_ms THEN 'session_timeout' WHEN {NOW - 3 * DAY // 24} - last_progress_ms > {12 * DAY // 24} THEN 'stalled' END AS reason FROM vmembers""",
    "ranks": "SELECT group_no, member_id, row_number() OVER (PARTITION BY group_no ORDER BY member_id) - 1 AS rank, count(*) OVER (PARTITION BY group_no) AS n FROM vmembers",
    "fewer": "SELECT group_no, member_id, row_number() OVER (PARTITION BY group_no ORDER BY member_id) - 1 AS rank, count(*) OVER (PARTITION BY group_no) AS n FROM vmembers WHERE member_id % 5 <> 1",
    "parts": "SELECT unnest(range(50)) AS p",
    "by_range": "SELECT group_no, member_id, p AS partition FROM ranks, parts WHERE p >= rank * (50 // n) + least(rank, 50 % n) AND p < (rank + 1) * (50 // n) + least(rank + 1, 50 % n)",
    "by_turn": "SELECT group_no, member_id, p AS partition FROM ranks, parts WHERE p % n = rank",
    "fewer_by_turn": "SELECT group_no, member_id, p AS partition FROM fewer, parts WHERE p % n = rank",
    "offs": "SELECT l.topic, l.partition, l.acquired_by, l.delivery_count, l.first_offset AS lease, unnest(range(l.first_offset, l.last_offset + 1)) AS o FROM vleases l",
    "resolved": """SELECT o.topic, o.partition, o.acquired_by, o.lease, o.o,
 CASE a.ack_type WHEN 'Accept' THEN 'Acknowledged' WHEN 'Release' THEN CASE WHEN o.delivery_count < 5 THEN 'Available' ELSE 'Archived' END WHEN 'Reject' THEN 'Archived' WHEN 'Yield' THEN 'Available' ELSE 'Acquired' END AS state,
 CASE WHEN a.ack_type = 'Yield' THEN greatest(o.delivery_count - 1, 0) ELSE o.delivery_count END AS delivery_count, coalesce(a.first_offset, -1) AS ack
FROM offs o LEFT JOIN vacks a ON o.topic = a.topic AND o.partition = a.partition AND o.acquired_by = a.member_id AND o.o BETWEEN a.first_offset AND a.last_offset""",
    "ranges": """SELECT topic, partition, min(o) AS first_offset, max(o) AS last_offset, acquired_by, state, delivery_count
FROM (SELECT *, o - row_number() OVER (PARTITION BY topic, partition, lease, ack ORDER BY o) AS island FROM resolved) r GROUP BY topic, partition, acquired_by, state, delivery_count, lease, ack, island""",
    "latencies": "SELECT event_type, event_id * 7919 % 6007 AS ms FROM events",
}

BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)
START = "SELECT topic, partition, coalesce(min(CASE WHEN state NOT IN ('Acknowledged', 'Archived') THEN first_offset END), max(last_offset) + 1) AS start_offset FROM {r} GROUP BY topic, partition"

#: Segments as an append loop makes them, one record after the other; {c}: whether a record begins a new one.
ROLLED = """WITH RECURSIVE p AS (SELECT topic, partition, log_offset, encoded_size, max(ts_ms) OVER (PARTITION BY topic, partition ORDER BY log_offset) AS tm FROM vseg),
f AS (SELECT topic, partition, log_offset, encoded_size AS size, log_offset AS base, tm AS born FROM p WHERE log_offset = 0
 UNION ALL SELECT p.topic, p.partition, p.log_offset, CASE WHEN {c} THEN p.encoded_size ELSE size + p.encoded_size END, CASE WHEN {c} THEN p.log_offset ELSE base END, CASE WHEN {c} THEN p.tm ELSE born END
 FROM f JOIN p ON p.topic = f.topic AND p.partition = f.partition AND p.log_offset = f.log_offset + 1)
SELECT topic, partition, base AS segment_base, count(*) AS n_records, max(size) AS size_bytes FROM f GROUP BY topic, partition, base"""
#: Verdicts as a broker gives them, one attempt after the other; {a}: attempts, {c}: columns.
JUDGED = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY producer_id ORDER BY arrival) AS i FROM ({a}) a),
f AS (SELECT *, 'accepted' AS verdict, CASE WHEN producer_id = 0 THEN NULL ELSE base_sequence END AS last FROM r WHERE i = 1
 UNION ALL SELECT r.*, CASE WHEN last IS NULL THEN 'accepted' WHEN r.base_sequence <= last THEN 'duplicate' WHEN r.base_sequence > last + 1 THEN 'out_of_order' ELSE 'accepted' END,
 CASE WHEN last IS NULL THEN NULL WHEN r.base_sequence = last + 1 THEN r.base_sequence ELSE last END FROM f JOIN r ON r.producer_id = f.producer_id AND r.i = f.i + 1)
SELECT {c} FROM f"""

SQL = {
    "log_latest_per_key": "SELECT v.topic, v.partition, v.log_offset, v.ts_ms, v.key, v.value FROM vlog v JOIN latest l ON v.topic = l.topic AND v.partition = l.partition AND v.log_offset = l.latest",
    "log_route_crc32": f"SELECT o_orderkey, {CRC.format(k='cast(o_custkey AS varchar)')} % 12 AS partition FROM orders",
    "log_assign_offsets": "SELECT topic, partition, log_offset, event_id FROM vlog",
    "log_fetch_range": "SELECT v.topic, v.partition, log_offset, ts_ms, key, value FROM vlog v JOIN vends USING (topic, partition) WHERE log_offset >= 100 AND log_offset < 600 AND log_offset < hw",
    "log_fetch_whole_batches": """SELECT v.topic, v.partition, v.log_offset, v.ts_ms FROM vlog v JOIN (SELECT *, sum(size_bytes) OVER (PARTITION BY topic, partition ORDER BY base_offset) AS total FROM vbatch JOIN vends USING (topic, partition) WHERE last_offset >= 205 AND last_offset < hw) b
 ON v.topic = b.topic AND v.partition = b.partition AND v.log_offset // 7 = b.batch_no WHERE (total <= 20000 OR total = size_bytes) AND v.log_offset >= 205""",
    "log_fetch_by_timestamp": f"SELECT v.topic, v.partition, log_offset, ts_ms, key, value FROM vlog v JOIN vends USING (topic, partition) WHERE ts_ms >= {NOW - 3 * DAY} AND log_offset < hw",
    "log_offset_for_timestamp": f"""SELECT t.topic, t.partition, t.target_ms, coalesce(min(v.log_offset), any_value(t.leo)) AS log_offset
FROM (SELECT topic, partition, leo, unnest(range({NOW - 31 * DAY}, {NOW + DAY} + 1, {DAY})) AS target_ms FROM vends) t LEFT JOIN vlog v ON v.topic = t.topic AND v.partition = t.partition AND v.ts_ms >= t.target_ms GROUP BY t.topic, t.partition, t.target_ms""",
    "log_seek_asof_index": """SELECT t.topic, t.partition, t.log_offset, i.log_offset AS index_offset FROM vlog t
 ASOF JOIN (SELECT * FROM vlog WHERE log_offset % 50 = 0) i ON t.topic = i.topic AND t.partition = i.partition AND t.log_offset >= i.log_offset""",
    "log_end_offsets": "SELECT topic, partition, min(log_offset) AS earliest, max(log_offset) + 1 AS latest FROM vlog GROUP BY topic, partition",
    "replica_append_classify": """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY arrival) AS i FROM arriving),
f AS (SELECT topic, partition, 0::BIGINT AS i, NULL::BIGINT AS arrival, NULL::BIGINT AS base_offset, NULL::BIGINT AS last_offset, NULL::VARCHAR AS verdict, 0::BIGINT AS log_end FROM vends
 UNION ALL SELECT n.topic, n.partition, n.i, n.arrival, n.base_offset, n.last_offset, CASE WHEN n.last_offset < log_end THEN 'already_applied' WHEN n.base_offset = log_end THEN 'appended' ELSE 'gap' END,
 CASE WHEN n.base_offset = log_end THEN n.last_offset + 1 ELSE log_end END FROM f JOIN n ON n.topic = f.topic AND n.partition = f.partition AND n.i = f.i + 1)
SELECT topic, partition, arrival, base_offset, last_offset, verdict FROM f WHERE i > 0""",
    "log_high_watermark_isr_min": """SELECT topic, partition, leo, CASE WHEN 1 + partition % 2 > 1 THEN least(leo, (SELECT min(leo - 1 - (partition * 3 + n) % 5) + 1 FROM (SELECT unnest([1, 2, 3]) AS n) r)) ELSE leo END AS hw FROM vends""",
    "timeindex_monotonic": "SELECT topic, partition, log_offset, max(ts_ms - CASE WHEN event_id % 37 = 0 THEN 7200000 ELSE 0 END) OVER (PARTITION BY topic, partition ORDER BY log_offset) AS index_ts_ms FROM vlog",
    "committed_lso": "SELECT topic, partition, min(first_offset) AS lso FROM vtxn WHERE status = 'Ongoing' GROUP BY topic, partition",
    "committed_read": """SELECT r.topic, r.partition, r.log_offset, r.ts_ms, r.key, r.value FROM vrec r JOIN vends d USING (topic, partition) LEFT JOIN (SELECT topic, partition, min(first_offset) AS lso FROM vtxn WHERE status = 'Ongoing' GROUP BY topic, partition) l USING (topic, partition)
WHERE NOT is_control AND log_offset < hw AND (lso IS NULL OR log_offset < lso) AND NOT EXISTS (SELECT 1 FROM vtxn t WHERE t.status = 'Aborted' AND t.topic = r.topic AND t.partition = r.partition AND r.log_offset BETWEEN t.first_offset AND t.last_offset)""",
    "committed_aborted_ranges": "SELECT DISTINCT topic, partition, first_offset, last_offset FROM vtxn WHERE status = 'Aborted' AND (txn_seq % 3 <> 0 OR txn_seq % 2 = 1)",
    "compact_survivors": "SELECT topic, partition, segment_base, log_offset, key FROM judged WHERE survives",
    "compact_tombstone_purge": "SELECT j.topic, j.partition, j.segment_base, j.log_offset, j.key FROM judged j LEFT JOIN purged p ON j.topic = p.topic AND j.partition = p.partition AND j.key = p.key WHERE j.is_active_segment OR (j.survives AND p.key IS NULL)",
    "compact_dirty_ratio": "SELECT *, discarded_bytes / total_bytes AS dirty_ratio FROM ratios WHERE discarded_bytes / total_bytes >= 0.95",
    "compact_log": """SELECT j.topic, j.partition, j.segment_base, j.log_offset FROM judged j LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY segment_base) AS n FROM ratios WHERE discarded_bytes > 0 AND discarded_bytes / total_bytes >= 0.5) x WHERE n <= 4) r
 ON j.topic = r.topic AND j.partition = r.partition AND j.segment_base = r.segment_base WHERE j.survives OR r.n IS NULL""",
    "compact_keyless_reject": "SELECT b.topic, b.partition, batch_no, base_offset, last_offset FROM vbatch b WHERE EXISTS (SELECT 1 FROM vlog v WHERE v.topic = b.topic AND v.partition = b.partition AND v.log_offset // 7 = b.batch_no AND (v.key IS NULL OR v.key = ''))",
    "retain_time": f"SELECT topic, partition, segment_base, newest_ms FROM segs WHERE NOT is_active_segment AND newest_ms < {NOW - 15 * DAY}",
    "retain_size": "SELECT topic, partition, segment_base, remaining FROM sized WHERE NOT is_active_segment AND remaining > 120000",
    "retain_both": f"SELECT topic, partition, segment_base, size_bytes FROM sized WHERE is_active_segment OR (newest_ms >= {NOW - 15 * DAY} AND remaining <= 120000)",
    "retain_trim_before": "SELECT topic, partition, segment_base FROM (SELECT *, lead(segment_base) OVER (PARTITION BY topic, partition ORDER BY segment_base) AS nb FROM segs) s WHERE nb IS NULL OR nb > 1200",
    "log_truncate_after": "SELECT topic, partition, batch_no, last_offset FROM vbatch WHERE last_offset < 1003",
    "txn_latest_status": "SELECT transaction_id, status, seq FROM last_change",
    "txn_timeout_action": f"SELECT transaction_id, status, CASE WHEN status IN ('Ongoing', 'PrepareAbort') THEN 'abort' ELSE 'commit' END AS action FROM last_change WHERE {NOW} - created_at_ms > 10000 AND status IN ('Ongoing', 'PrepareAbort', 'PrepareCommit')",
    "producer_exact_retry_dedup": "SELECT producer_id, base_sequence, min(arrival) AS arrival FROM vattempts GROUP BY producer_id, epoch, base_sequence",
    "producer_sequence_gaps": "SELECT * FROM (SELECT producer_id, base_sequence, lag(base_sequence) OVER (PARTITION BY producer_id ORDER BY base_sequence) AS previous FROM (SELECT DISTINCT producer_id, base_sequence FROM vattempts WHERE base_sequence % 7 <> 3) d) x WHERE previous IS NOT NULL AND base_sequence <> previous + 1",
    "producer_fencing": """SELECT transactional_id, epoch, event_id, CASE WHEN is_init THEN 'init' WHEN cur IS NULL THEN 'unknown' WHEN epoch = cur THEN 'ok' ELSE 'fenced' END AS verdict
FROM (SELECT r.*, (SELECT max_by(q.event_id // 500, q.event_id) FROM events q WHERE q.user_id % 20 = r.u AND q.event_id < r.event_id AND q.event_id % 25 = 3) AS cur
 FROM (SELECT concat('t', user_id % 20) AS transactional_id, user_id % 20 AS u, event_id, event_id % 25 = 3 AS is_init, CASE WHEN event_id % 25 <> 3 AND event_id % 7 = 2 THEN greatest(event_id // 500 - 1, 0) ELSE event_id // 500 END AS epoch FROM events) r) x""",
    "group_committed_offsets": "SELECT * FROM offsets",
    "group_lag": """SELECT g.group_id, d.topic, d.partition, d.leo - coalesce(c.o + 1, 0) AS lag FROM (SELECT DISTINCT group_id FROM vcommits WHERE log_offset % 3 = 0) g CROSS JOIN vends d
LEFT JOIN (SELECT group_id, topic, partition, max_by(log_offset, commit_seq) AS o FROM vcommits WHERE log_offset % 3 = 0 AND NOT (group_id IN ('g1', 'g6') AND partition = 2) GROUP BY ALL) c ON c.group_id = g.group_id AND c.topic = d.topic AND c.partition = d.partition""",
    "group_evictions": "SELECT group_no, member_id, reason FROM evicted WHERE reason IS NOT NULL",
    "group_recent_evictions": "SELECT group_no, member_id, rank FROM (SELECT group_no, member_id, row_number() OVER (PARTITION BY group_no ORDER BY last_heartbeat_ms DESC, member_id) AS rank FROM evicted WHERE reason IS NOT NULL) r WHERE rank <= 5",
    "assign_range": "SELECT * FROM by_range",
    "assign_roundrobin": "SELECT * FROM by_turn",
    "assign_cooperative_round_one": """SELECT coalesce(t.group_no, p.group_no) AS group_no, coalesce(t.member_id, p.member_id) AS member_id,
 array_to_string(list_sort(list_filter(coalesce(t.l, []), lambda x: list_contains(coalesce(p.l, []), x))), ',') AS kept, array_to_string(list_sort(list_filter(coalesce(p.l, []), lambda x: NOT list_contains(coalesce(t.l, []), x))), ',') AS revoked,
 len(list_filter(coalesce(t.l, []), lambda x: NOT list_contains(coalesce(p.l, []), x))) > 0 AS second_round
FROM (SELECT group_no, member_id, list(partition) AS l FROM fewer_by_turn GROUP BY ALL) t FULL JOIN (SELECT group_no, member_id, list(partition) AS l FROM by_turn GROUP BY ALL) p ON t.group_no = p.group_no AND t.member_id = p.member_id""",
    "assign_duplicate_owners": "SELECT group_no, partition, count(*) AS owners FROM (SELECT * FROM by_turn UNION ALL SELECT * FROM by_range WHERE partition % 3 = 0) a GROUP BY group_no, partition HAVING count(*) > 1",
    "share_ack_apply": "SELECT * FROM ranges",
    "share_expire_leases": f"SELECT topic, partition, first_offset, last_offset, CASE WHEN {NOW - 10 * DAY} >= acquired_at_ms + lock_timeout_ms THEN CASE WHEN delivery_count < 5 THEN 'Available' ELSE 'Archived' END ELSE 'Acquired' END AS state, delivery_count FROM vleases",
    "share_dlq_route": "SELECT concat(v.topic, '-dlq') AS dlq_topic, v.topic, v.partition, v.log_offset, v.key, v.value, r.delivery_count FROM resolved r JOIN vlog v ON v.topic = r.topic AND v.partition = r.partition AND v.log_offset = r.o WHERE r.state = 'Archived'",
    "share_coalesce_acks": """SELECT topic, partition, ack_type, min(log_offset) AS first_offset, max(log_offset) AS last_offset FROM (SELECT *, log_offset - row_number() OVER (PARTITION BY topic, partition, ack_type ORDER BY log_offset) AS island
 FROM (SELECT topic, partition, log_offset, ['Accept', 'Release', 'Reject'][event_id % 7 % 3 + 1] AS ack_type FROM vlog) a) i GROUP BY topic, partition, ack_type, island""",
    "share_watermark_advance": START.format(r="(SELECT * FROM ranges WHERE first_offset >= 10) x"),
    "share_group_stats": f"SELECT r.topic, cast(sum(CASE WHEN state = 'Acquired' THEN last_offset - first_offset + 1 ELSE 0 END) AS bigint) AS in_flight, min(start_offset) AS start_offset FROM ranges r JOIN ({START.format(r='ranges')}) s USING (topic, partition) GROUP BY r.topic",
    "share_active_members": f"SELECT group_no, count(DISTINCT member_id) AS active FROM vmembers WHERE {NOW - 2 * DAY} - last_heartbeat_ms <= {3 * DAY} GROUP BY group_no",
    "metric_topic_counters_rollup": "SELECT event_type AS topic, count(*) AS records, cast(sum(coalesce(length(props), 0)) AS bigint) AS bytes, cast(grouping(event_type) AS bigint) AS is_total FROM events GROUP BY ROLLUP (event_type)",
    "metric_latency_histogram": " UNION ALL ".join(
        [f"SELECT event_type, '{b}' AS le, count(*) FILTER (ms <= {b}) AS cumulative, cast(sum(ms) AS bigint) AS total_ms FROM latencies GROUP BY event_type" for b in BOUNDS]
        + ["SELECT event_type, '+Inf', count(*), cast(sum(ms) AS bigint) FROM latencies GROUP BY event_type"]
    ),
    "metric_nearest_rank_pct": "SELECT event_type, p, ms FROM (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM latencies) s, (SELECT unnest([50, 95, 99])::BIGINT AS p) q WHERE k = floor(p / 100.0::DOUBLE * (n - 1) + 0.5)",
    "metric_throughput": f"SELECT event_type, count(*) / ((max({MS.format(x='ts')}) - min({MS.format(x='ts')})) / 1000.0::DOUBLE) AS records_per_s, sum(coalesce(length(props), 0)) / 1e6 / ((max({MS.format(x='ts')}) - min({MS.format(x='ts')})) / 1000.0::DOUBLE) AS mb_per_s FROM events GROUP BY event_type",
    "policy_acl_authorize": """WITH q AS (SELECT event_id AS request_id, concat('User:', user_id % 10) AS u, concat('10.0.0.', event_id % 3) AS h, CASE WHEN event_id % 2 = 0 THEN 'Read' ELSE 'Write' END AS o, concat(event_type, '-', event_id % 4) AS r FROM events)
SELECT request_id, ((u = 'User:1' AND r = 'click-1') OR (h = '10.0.0.1' AND o = 'Read' AND starts_with(r, 'view-')) OR u = 'User:2' OR (o = 'Read' AND contains(r, 'chas')))
 AND NOT ((u = 'User:2' AND h = '10.0.0.2' AND o = 'Write' AND r LIKE '%-3') OR (u = 'User:3' AND o = 'Read' AND r = 'purchase-2')) AS allowed FROM q""",
    "policy_topic_name": r"""SELECT p_partkey, length(name) BETWEEN 1 AND 249 AND regexp_full_match(name, '[\p{L}\p{N}._-]+') AND NOT contains(name, '..') AND NOT starts_with(name, '__') AS ok
FROM (SELECT p_partkey, concat(['', '__', 'a..b'][p_partkey % 3 + 1], CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE translate(p_name, ' #', '__') END) AS name FROM part) n""",
    "catalog_describe_topic": """SELECT t.topic, t.partition, coalesce(s.hw, 0) AS hw, coalesce(s.leader, -1) AS leader FROM (SELECT DISTINCT o_orderpriority AS topic, unnest(range(9)) AS partition FROM orders) t
LEFT JOIN (SELECT o_orderpriority AS topic, o_custkey % 7 AS partition, count(*) AS hw, min(o_orderkey % 3) AS leader FROM orders WHERE o_custkey % 7 <> 3 GROUP BY ALL) s ON t.topic = s.topic AND t.partition = s.partition""",
    "catalog_unassigned": "SELECT DISTINCT o_orderpriority AS topic, unnest(range(9)) AS partition FROM orders EXCEPT SELECT o_orderpriority, o_custkey % 7 FROM orders",
    "catalog_list_topics": "SELECT DISTINCT topic FROM (SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '__' END, c_mktsegment, c_nationkey % 3) AS topic FROM customer) c WHERE (topic LIKE '%0' OR topic LIKE '%1') AND NOT starts_with(topic, '__')",
    "catalog_latest_entity": "SELECT user_id, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'",
    "config_effective_merge": """SELECT c_custkey, concat_ws(',', CASE WHEN p <> '' THEN concat('cleanup.policy=', p) END, concat('retention.ms=', r), CASE WHEN c_custkey % 2 = 1 THEN 'segment.bytes=9' END) AS config
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'compact' ELSE '' END AS p, CASE WHEN c_custkey % 2 = 0 THEN '5' WHEN c_custkey % 5 = 0 THEN '604800000' ELSE cast(c_custkey AS varchar) END AS r FROM customer) c""",
    "segment_codec_round_trip": "SELECT topic, partition, log_offset, ts_ms, key, value FROM vlog",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "replica_failover": f"""WITH a AS (SELECT * FROM (VALUES (1, {NOW - 50_000}), (2, {NOW - 1000})) AS v(node, acked)),
x AS (SELECT topic, partition, 1 + partition % 3 AS leader, EXISTS (SELECT 1 FROM a WHERE node = 1 + partition % 3 AND {NOW} - acked > 30000) AS dead FROM vends),
y AS (SELECT x.*, n FROM x, (SELECT unnest([1, 2, 3]) AS n) r LEFT JOIN a ON a.node = r.n WHERE coalesce({NOW} - acked <= 30000, false) OR (n = leader AND NOT dead))
SELECT topic, partition, CASE WHEN dead THEN min(n) ELSE leader END AS new_leader, array_to_string(list(n ORDER BY n), ',') AS new_isr FROM y GROUP BY topic, partition, leader, dead""",
    "election_tally": "SELECT event_id % 200 AS term, user_id % 2 AS candidate, count(DISTINCT user_id % 9) AS votes FROM events WHERE event_type <> 'error' GROUP BY ALL HAVING count(DISTINCT user_id % 9) >= 5",
    "txn_decision_kept": """WITH c AS (SELECT transaction_id, status, seq FROM changes UNION ALL SELECT transaction_id, 'PrepareAbort', seq + 5 FROM changes WHERE status = 'Ongoing' AND txn_seq % 5 = 2),
k AS (SELECT *, CASE WHEN status IN ('PrepareCommit', 'Committed') THEN 'commit' WHEN status IN ('PrepareAbort', 'Aborted') THEN 'abort' END AS kind FROM c),
f AS (SELECT transaction_id, min_by(kind, seq) AS decided FROM k WHERE kind IS NOT NULL GROUP BY transaction_id)
SELECT transaction_id, max_by(status, seq) AS status, max(seq) AS seq FROM k LEFT JOIN f USING (transaction_id) WHERE decided IS NULL OR kind = decided GROUP BY transaction_id""",
    "group_fetch_progress": f"""SELECT m.group_no, m.member_id, greatest(m.last_progress_ms, f.at_ms) AS last_progress_ms FROM vmembers m
LEFT JOIN (SELECT user_id, max({MS.format(x="ts")}) AS at_ms FROM events WHERE event_type = 'purchase' GROUP BY user_id) f ON f.user_id = m.member_id""",
    "log_replication_fetch": "SELECT topic, partition, log_offset, ts_ms, key, value FROM vlog WHERE log_offset >= 100 AND log_offset < 600",
    "log_append_markers": """SELECT t.topic, t.partition, leo + row_number() OVER (PARTITION BY t.topic, t.partition ORDER BY txn_seq) - 1 AS log_offset, txn_seq, CASE status WHEN 'Committed' THEN 'commit' ELSE 'abort' END AS marker
FROM vtxn t JOIN vends d ON t.topic = d.topic AND t.partition = d.partition WHERE status IN ('Committed', 'Aborted')""",
    "log_poll_fairly": "SELECT topic, partition, log_offset FROM vlog ORDER BY log_offset, topic, partition LIMIT 40",
    "log_oversized_batches": "SELECT topic, partition, batch_no, size_bytes FROM vbatch WHERE size_bytes > 240",
    "log_partition_bytes": "SELECT topic, partition, cast(sum(encoded_size) AS bigint) AS size_bytes, max(ts_ms) AS newest_ms FROM vseg GROUP BY topic, partition",
    "replica_undiscovered_peers": "SELECT n_nationkey AS node, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)",
    "replica_full_ack": "SELECT topic, partition, bool_and((partition + node) % 5 <> 4 AND leo - 1 - (partition * 3 + node) % 5 >= leo - 4) AS acked FROM vends, (SELECT unnest([1, 2, 3]) AS node) n GROUP BY topic, partition",
    "producer_lru_evictions": "SELECT user_id AS producer_id, max(event_id) AS last_used FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0) GROUP BY user_id ORDER BY last_used, user_id LIMIT 10",
    "share_restored": "SELECT topic, partition, first_offset, last_offset, acquired_by, CASE state WHEN 'Acquired' THEN 'Available' ELSE state END AS state, delivery_count FROM ranges",
    "policy_cidr": "SELECT event_id, user_id % 300 < 128 AS inside FROM events",
    "config_values": """SELECT c_custkey, CASE WHEN try_cast(trim(raw) AS bigint) >= 0 THEN try_cast(trim(raw) AS bigint) END AS number, CASE WHEN lower(trim(raw)) IN ('none', 'lz4', 'zstd') THEN lower(trim(raw)) END AS codec
FROM (SELECT c_custkey, ['5', ' 7 ', '', 'x', '-3', ' LZ4', 'zstd'][c_custkey % 7 + 1] AS raw FROM customer) c""",
    "batch_attributes": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'lz4' WHEN 2 THEN 'zstd' END AS codec, event_id % 16 >= 8 AS transactional, event_id % 32 >= 16 AS control FROM events",
    "catalog_rosters": """WITH c AS (SELECT event_type AS topic, user_id % 4 AS partition, event_id AS seq, event_id % 5 AS leader, [event_id % 5, (event_id + 1) % 5] AS isr, CASE WHEN event_id % 3 = 0 THEN [event_id % 5, (event_id + 1) % 5, (event_id + 2) % 5] END AS replicas FROM events),
m AS (SELECT topic, max(seq) AS made FROM c WHERE seq % 100 = 0 GROUP BY topic),
g AS (SELECT c.topic, c.partition, max_by(leader, seq) AS leader, max_by(isr, seq) AS isr, max_by(replicas, seq) FILTER (WHERE replicas IS NOT NULL) AS named FROM c JOIN m ON c.topic = m.topic WHERE seq % 100 <> 0 AND seq > made GROUP BY c.topic, c.partition)
SELECT topic, partition, leader, array_to_string(list_concat(coalesce(named, isr), list_filter(isr, lambda z: NOT list_contains(coalesce(named, isr), z))), ',') AS replicas FROM g""",
    "segment_roll": ROLLED.format(c="size + p.encoded_size > 40000"),
    "segment_roll_by_time": ROLLED.format(c=f"(size + p.encoded_size > 40000 OR p.tm - born >= {DAY // 2})"),
    "log_byte_index": """WITH RECURSIVE b AS (SELECT topic, partition, base_offset, size_bytes, row_number() OVER (PARTITION BY topic, partition ORDER BY base_offset) AS i FROM vbatch),
f AS (SELECT topic, partition, i, base_offset, true AS entry, size_bytes AS since FROM b WHERE i = 1
 UNION ALL SELECT b.topic, b.partition, b.i, b.base_offset, since >= 4096, CASE WHEN since >= 4096 THEN 0 ELSE since END + b.size_bytes FROM f JOIN b ON b.topic = f.topic AND b.partition = f.partition AND b.i = f.i + 1)
SELECT topic, partition, base_offset FROM f WHERE entry""",
    "log_truncated_ends": "SELECT d.topic, d.partition, CASE WHEN leo <= 1003 THEN leo ELSE coalesce(e, 0) END AS leo, least(hw, CASE WHEN leo <= 1003 THEN leo ELSE coalesce(e, 0) END) AS hw FROM vends d LEFT JOIN (SELECT topic, partition, max(last_offset) + 1 AS e FROM vbatch WHERE last_offset < 1003 GROUP BY ALL) b USING (topic, partition)",
    "log_in_order": "SELECT topic, partition, log_offset, event_id FROM vlog",
    "quota_token_bucket": f"""WITH RECURSIVE r AS (SELECT user_id AS client_id, {MS.format(x="ts")} AS at_ms, event_id AS seq, event_id % 97 * 1000 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY {MS.format(x="ts")}, event_id) AS i FROM events),
f AS (SELECT *, 20000::DOUBLE - amount AS level FROM r WHERE i = 1 UNION ALL SELECT r.*, least(20000::DOUBLE, f.level + (r.at_ms - f.at_ms) * 20::DOUBLE) - r.amount FROM f JOIN r ON r.client_id = f.client_id AND r.i = f.i + 1)
SELECT client_id, at_ms, seq, amount, CASE WHEN level < 0 THEN least(60000::DOUBLE, -level / 20000::DOUBLE * 1000::DOUBLE) ELSE 0::DOUBLE END AS delay_ms FROM f""",
    "producer_idempotent_fold": JUDGED.format(a="SELECT producer_id, epoch, base_sequence, arrival FROM vattempts", c="producer_id, base_sequence, arrival, verdict"),
    "stream_idempotent": JUDGED.format(a="SELECT event_id % 50 + 1 AS producer_id, 0 AS epoch, event_id // 50 AS base_sequence, event_id * 2 + d AS arrival FROM events, (SELECT unnest([0, 5]) AS d) z WHERE event_id % 2100 <> 1213 AND (d = 0 OR event_id % 10 = 0)", c="producer_id, epoch, base_sequence, arrival, verdict"),
    "producer_duplicate_answers": """WITH j AS (SELECT *, producer_id = 0 OR attempt = 1 AS ok FROM vattempts), n AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY arrival) - 1 AS told FROM j)
SELECT producer_id, base_sequence, arrival, CASE WHEN ok THEN 'accepted' ELSE 'duplicate' END AS verdict, last_value(CASE WHEN ok THEN told END IGNORE NULLS) OVER (PARTITION BY producer_id ORDER BY arrival) AS answer FROM n""",
    "stream_tumbling": f"SELECT event_type, d * {DAY} AS start_ms, n FROM (SELECT event_type, {MS.format(x='ts')} // {DAY} AS d, count(*) AS n FROM events GROUP BY ALL) w WHERE (d + 1) * {DAY} <= (SELECT max({MS.format(x='ts')}) - 3600000 FROM events)",
    "stream_session": """SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, (epoch_us(max(ts)) + 1800000000) // 1000 AS end_ms, count(*) AS n
FROM (SELECT *, sum(CASE WHEN epoch_us(ts) - before <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) l) e
GROUP BY user_id, s HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)""",
    "stream_share_leases": f"""WITH RECURSIVE r AS (SELECT event_id % 40 AS range_id, event_id AS seq, ['acquire', 'accept', 'acquire', 'release', 'renew', 'acquire', 'reject', 'yield'][event_id % 8 + 1] AS action, concat('m', user_id % 3) AS member, {MS.format(x="ts")} AS tm,
 row_number() OVER (PARTITION BY event_id % 40 ORDER BY {MS.format(x="ts")}, event_id) AS i FROM events),
f AS (SELECT DISTINCT range_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 'Available' AS state, NULL::VARCHAR AS owner, 0::BIGINT AS delivery_count, 0::BIGINT AS held_until FROM r
 UNION ALL SELECT range_id, i, seq, outcome, CASE outcome WHEN 'acquired' THEN 'Acquired' WHEN 'renewed' THEN 'Acquired' WHEN 'accepted' THEN 'Acknowledged' WHEN 'dead_lettered' THEN 'Archived' WHEN 'yielded' THEN 'Available' WHEN 'released' THEN 'Available' ELSE s END,
  CASE WHEN outcome IN ('acquired', 'renewed') THEN member WHEN outcome IN ('refused', 'ignored') THEN o END, CASE outcome WHEN 'acquired' THEN n + 1 WHEN 'yielded' THEN greatest(n - 1, 0) ELSE n END, CASE WHEN outcome IN ('acquired', 'renewed') THEN tm + 7200000 WHEN outcome IN ('refused', 'ignored') THEN u ELSE 0 END
 FROM (SELECT *, CASE WHEN action = 'acquire' THEN CASE WHEN s = 'Available' THEN 'acquired' ELSE 'refused' END WHEN s <> 'Acquired' OR o IS DISTINCT FROM member THEN 'ignored' WHEN action = 'renew' THEN 'renewed' WHEN action = 'accept' THEN 'accepted'
   WHEN action = 'reject' THEN 'dead_lettered' WHEN action = 'yield' THEN 'yielded' WHEN n < 5 THEN 'released' ELSE 'dead_lettered' END AS outcome
  FROM (SELECT r.*, CASE WHEN f.state = 'Acquired' AND r.tm >= f.held_until THEN CASE WHEN f.delivery_count < 5 THEN 'Available' ELSE 'Archived' END ELSE f.state END AS s, CASE WHEN f.state = 'Acquired' AND r.tm >= f.held_until THEN NULL ELSE f.owner END AS o, f.delivery_count AS n, f.held_until AS u
   FROM f JOIN r ON r.range_id = f.range_id AND r.i = f.i + 1) x) y)
SELECT range_id, seq, outcome, state, delivery_count FROM f WHERE i > 0""",
    "catalog_replica_striping": """SELECT topic, p AS partition, n[1] AS leader, array_to_string(n, ',') AS replicas FROM (SELECT topic, p, [((s + p + j) % 5 + 1)::BIGINT FOR j IN [0, 1, 2]] AS n
FROM (SELECT topic, unnest(range(6)) AS p, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(topic) + 1), lambda i: ascii(topic[i])::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 5 AS s FROM (SELECT DISTINCT p_brand AS topic FROM part) t) x) y""",
    "catalog_create_verdicts": "SELECT seq, topic, CASE WHEN NOT ok THEN 'invalid' WHEN seq IN (SELECT seq FROM created) THEN 'created' ELSE 'already_exists' END AS verdict FROM tried WHERE op = 'create'",
    "catalog_topics_in_force": "SELECT topic, seq, n_partitions, replication FROM topics",
    "catalog_configs_in_force": """WITH c AS (SELECT m.*, t.seq AS made FROM vmeta m JOIN topics t ON t.topic = m.topic WHERE m.op IN ('alter', 'replace') AND m.seq > t.seq),
k AS (SELECT c.* FROM c LEFT JOIN (SELECT topic, max(seq) AS reset FROM c WHERE op = 'replace' GROUP BY topic) r ON r.topic = c.topic WHERE reset IS NULL OR seq >= reset),
e AS (SELECT topic, seq, key, value FROM k UNION ALL SELECT topic, seq, gone, NULL FROM (SELECT topic, seq, key, unnest(removed) AS gone FROM k WHERE op = 'alter') x WHERE gone <> key)
SELECT topic, key, arg_max_null(value, seq) AS value FROM e GROUP BY topic, key HAVING arg_max_null(value, seq) IS NOT NULL""",
    "catalog_brokers_in_force": "SELECT node, address FROM vmeta WHERE op IN ('register', 'unregister') QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) = 1 AND op = 'register'",
    "acl_rules_in_force": "SELECT * FROM rules",
    "acl_list": "SELECT * FROM rules WHERE resource_type = 'Topic' AND permission = 'Allow'",
    "group_list": f"SELECT group_no, count(*) FILTER ({NOW - 2 * DAY // 24} - last_heartbeat_ms <= session_timeout_ms) AS n_members FROM vmembers GROUP BY group_no",
    "group_describe": f"""WITH a AS (SELECT * FROM vmembers WHERE {NOW - 2 * DAY // 24} - last_heartbeat_ms <= session_timeout_ms),
k AS (SELECT group_no, member_id, row_number() OVER (PARTITION BY group_no ORDER BY member_id) - 1 AS rank, count(*) OVER (PARTITION BY group_no) AS n FROM a WHERE member_id % 4 <> 1),
o AS (SELECT group_no, member_id, array_to_string(list(p ORDER BY p), ',') AS ps FROM k, parts WHERE p % n = rank GROUP BY ALL)
SELECT g.group_no, CASE WHEN a.member_id IS NULL THEN 'Empty' ELSE 'Stable' END AS state, a.member_id, CASE WHEN a.member_id IS NOT NULL THEN coalesce(ps, '') END AS partitions
FROM (SELECT DISTINCT group_no FROM vmembers) g LEFT JOIN a ON a.group_no = g.group_no LEFT JOIN o ON o.group_no = a.group_no AND o.member_id = a.member_id""",
    "group_static_members": """SELECT group_no, instance_id, concat(instance_id, '-', max(k)) AS member_id, count(*) AS joins
FROM (SELECT user_id % 8 AS group_no, concat('i', user_id) AS instance_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS k FROM events WHERE event_type = 'click') j GROUP BY group_no, instance_id""",
    "group_synced": """WITH o AS (SELECT group_no, member_id, array_to_string(list(partition ORDER BY partition), ',') AS ps FROM fewer_by_turn GROUP BY ALL)
SELECT event_id AS request_id, CASE WHEN m.member_id IS NULL THEN 'unknown_member' END AS error, coalesce(ps, '') AS partitions FROM events e LEFT JOIN fewer m ON m.member_id = e.user_id LEFT JOIN o ON o.member_id = m.member_id WHERE event_type = 'view'""",
    "group_commit_metadata": "SELECT group_id, topic, partition, log_offset, CASE WHEN commit_seq % 3 = 0 THEN '' ELSE concat('at ', commit_seq) END AS metadata FROM vcommits QUALIFY row_number() OVER (PARTITION BY group_id, topic, partition ORDER BY commit_seq DESC) = 1",
    "share_acquire": """WITH r AS (SELECT * FROM ranges WHERE last_offset < 900),
o AS (SELECT topic, partition, unnest(range(first_offset, last_offset + 1)) AS o, first_offset, last_offset, delivery_count FROM r WHERE state = 'Available'),
n AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY o) AS k FROM o),
had AS (SELECT topic, partition, least(max(k), 130) AS had FROM n GROUP BY ALL),
ends AS (SELECT d.topic, d.partition, leo, coalesce(had, 0) AS had, (SELECT max(last_offset) + 1 FROM r WHERE r.partition = d.partition) AS start FROM vends d LEFT JOIN had USING (topic, partition)),
touched AS (SELECT topic, partition, first_offset AS f FROM n WHERE k <= 130 GROUP BY ALL)
SELECT n.topic, n.partition, min(o) AS first_offset, max(o) AS last_offset, CASE WHEN k <= 130 THEN 'Acquired' ELSE 'Available' END AS state, CASE WHEN k <= 130 THEN 'm7' END AS acquired_by, max(delivery_count) + CASE WHEN k <= 130 THEN 1 ELSE 0 END AS delivery_count
FROM n JOIN touched t ON t.topic = n.topic AND t.partition = n.partition AND t.f = n.first_offset GROUP BY n.topic, n.partition, n.first_offset, k <= 130
UNION ALL SELECT topic, partition, coalesce(start, 0), coalesce(start, 0) + least(130 - had, leo - coalesce(start, 0)) - 1, 'Acquired', 'm7', 1 FROM ends WHERE had < 130 AND leo > coalesce(start, 0)""",
    "replica_shrunk_isr": "SELECT event_id, array_to_string(list_filter([event_id % 5, (event_id + 1) % 5, (event_id + 2) % 5], lambda n: n IN (user_id % 5, (user_id + 1) % 5)), ',') AS isr FROM events",
    "policy_cidr_v6": "SELECT event_id, user_id % 64 BETWEEN 32 AND 63 AS inside FROM events",
    "config_names": """SELECT c_custkey, CASE WHEN x IN ('delete', 'compact', 'compact,delete') THEN x END AS policy, CASE WHEN x IN ('range', 'roundrobin', 'sticky', 'cooperative-sticky') THEN x END AS assignor
FROM (SELECT c_custkey, lower(trim(['Compact', ' delete ', 'compact,delete', 'sticky', 'RANGE', 'roundrobin', 'other'][c_custkey % 7 + 1])) AS x FROM customer) c""",
    "metric_prometheus_histogram": "SELECT '# HELP fetch_latency_ms Latency in milliseconds.' AS line UNION ALL SELECT '# TYPE fetch_latency_ms histogram' UNION ALL "
    + " UNION ALL ".join([f"""SELECT concat('fetch_latency_ms_bucket{{event_type="', event_type, '",le="{b}"}} ', count(*) FILTER (ms <= {b})) FROM latencies GROUP BY event_type""" for b in BOUNDS])
    + """ UNION ALL SELECT concat('fetch_latency_ms_bucket{event_type="', event_type, '",le="+Inf"} ', count(*)) FROM latencies GROUP BY event_type UNION ALL SELECT concat('fetch_latency_ms_sum{event_type="', event_type, '"} ', sum(ms)::BIGINT) FROM latencies GROUP BY event_type
 UNION ALL SELECT concat('fetch_latency_ms_count{event_type="', event_type, '"} ', count(*)) FROM latencies GROUP BY event_type""",
    "segment_codec_zstd": "SELECT topic, partition, log_offset, log_offset - log_offset % 700 AS batch_base_offset, 'zstd' AS codec, value FROM vlog",
    "metric_prometheus": """SELECT concat('log_records_total{topic="', event_type, '"} ', count(*)) AS line FROM events GROUP BY event_type UNION ALL SELECT concat('log_records_total ', count(*)) FROM events""",
}


def with_views(sql: str) -> str:
    """The statement after the views it needs, in the order of their definition."""
    need, todo = set(), [sql]
    while todo:
        names = {n for n in re.findall(r"\w+", todo.pop()) if n in VIEWS} - need
        need |= names
        todo += [VIEWS[n] for n in names]
    chain = ", ".join(f"{n} AS ({q})" for n, q in VIEWS.items() if n in need)
    if not chain:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {chain}, {sql[15:]}"
    return f"WITH {chain}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {chain} {sql}"


ORACLE_SQL = {name: with_views(sql) for name, sql in SQL.items()}
