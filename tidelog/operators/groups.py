"""Consumer groups: offsets, lag, evictions and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import TP
from tidelog.operators.ranking import sequence_numbers


def committed_offsets(commits: DataFrame) -> DataFrame:
    """Each group's last commit of each partition; it names the last processed offset."""
    return commits.groupBy("group_id", *TP).agg(F.max_by("log_offset", "commit_seq").alias("log_offset"))


def committed_with_metadata(commits: DataFrame) -> DataFrame:
    """As committed_offsets, with what the last commit said beside its offset (no metadata is the empty string)."""
    last = F.max_by(F.struct("log_offset", F.coalesce("metadata", F.lit("")).alias("metadata")), "commit_seq")
    return commits.groupBy("group_id", *TP).agg(last.alias("_last")).select("group_id", *TP, "_last.*")


def lag(offsets: DataFrame, ends: DataFrame, subscribed: DataFrame | None = None) -> DataFrame:
    """Offsets still to process: from committed + 1, or from 0 where a group subscribed to (group_id, topic, partition)
    has no commit, to the end."""
    x = offsets if subscribed is None else subscribed.select("group_id", *TP).join(offsets, ["group_id", *TP], "left")
    x = x.join(ends.select(*TP, "leo"), TP)
    return x.withColumn("lag", F.col("leo") - F.coalesce(F.col("log_offset") + 1, F.lit(0)))


def alive(members: DataFrame, now_ms: int) -> DataFrame:
    """Members whose session has not timed out: what a group is pruned to before it is listed or described."""
    return members.filter(F.lit(now_ms) - F.col("last_heartbeat_ms") <= F.col("session_timeout_ms"))


def list_groups(members: DataFrame, now_ms: int) -> DataFrame:
    """All groups, those that lost every member included, with the number of members left."""
    here = alive(members, now_ms).groupBy("group_no").agg(F.count(F.lit(1)).alias("n_members"))
    return members.select("group_no").distinct().join(here, "group_no", "left").fillna(0, ["n_members"])


def describe_groups(members: DataFrame, assignment: DataFrame, now_ms: int) -> DataFrame:
    """Each living member with its partitions in order (none: an empty list) and its group's state."""
    own = assignment.groupBy("group_no", "member_id").agg(F.array_sort(F.collect_list("partition")).alias("partitions"))
    x = alive(members, now_ms).select("group_no", "member_id").join(own, ["group_no", "member_id"], "left")
    x = x.withColumn("partitions", F.coalesce("partitions", F.expr("cast(array() as array<bigint>)")))
    return list_groups(members, now_ms).join(x, "group_no", "left").withColumn("state", F.when(F.col("n_members") > 0, "Stable").otherwise("Empty")).drop("n_members")


def static_members(joins: DataFrame) -> DataFrame:
    """The member that holds each instance id: a rejoin (group_no, instance_id, seq) gets a new member id, instance-seq,
    with seq counted by group, and takes the place of the one before."""
    x = sequence_numbers(joins, ["group_no"], "seq", "_no").withColumn("_no", F.col("_no") + 1)
    last = F.max_by(F.struct("_no", "seq"), "seq")
    x = x.groupBy("group_no", "instance_id").agg(last.alias("l"), F.count(F.lit(1)).alias("joins"))
    return x.select("group_no", "instance_id", F.concat_ws("-", "instance_id", F.col("l._no").cast("string")).alias("member_id"), "joins")


def synced(requests: DataFrame, members: DataFrame, assignment: DataFrame) -> DataFrame:
    """What each request (request_id, group_no, member_id) for an assignment gets: its partitions, none if it has none,
    or unknown_member."""
    own = assignment.groupBy("group_no", "member_id").agg(F.array_sort(F.collect_list("partition")).alias("partitions"))
    x = requests.join(members.select("group_no", "member_id", F.lit(True).alias("_known")), ["group_no", "member_id"], "left").join(own, ["group_no", "member_id"], "left")
    none = F.expr("cast(array() as array<bigint>)")
    return x.withColumn("error", F.when(F.col("_known").isNull(), "unknown_member")).withColumn("partitions", F.when(F.col("_known"), F.coalesce("partitions", none)).otherwise(none)).drop("_known")


def evictions(members: DataFrame, now_ms: int, max_poll_ms: int) -> DataFrame:
    """Members a group loses, with the reason: a session that timed out, or no progress for too long."""
    reason = F.when(F.lit(now_ms) - F.col("last_heartbeat_ms") > F.col("session_timeout_ms"), "session_timeout")
    reason = reason.when(F.lit(now_ms) - F.col("last_progress_ms") > max_poll_ms, "stalled")
    return members.withColumn("reason", reason).filter("reason is not null")


def with_progress(members: DataFrame, fetches: DataFrame) -> DataFrame:
    """Members after fetches (group_no, member_id, at_ms): a fetch moves a member's progress forward, never back."""
    last = fetches.groupBy("group_no", "member_id").agg(F.max("at_ms").alias("_at"))
    x = members.join(last, ["group_no", "member_id"], "left")
    return x.withColumn("last_progress_ms", F.greatest("last_progress_ms", "_at")).drop("_at")


def recent_evictions(evicted: DataFrame, n: int = 20) -> DataFrame:
    """The last n of each group, by heartbeat (a limit is the feature)."""
    w = Window.partitionBy("group_no").orderBy(F.desc("last_heartbeat_ms"), "member_id")
    return evicted.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def ranked_members(members: DataFrame) -> DataFrame:
    """rank (from 0, by member_id) and n of each group: a row a member."""
    w = Window.partitionBy("group_no")
    return members.select("group_no", "member_id").withColumn("rank", (F.row_number().over(w.orderBy("member_id")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def assign_range(members: DataFrame, partitions: int) -> DataFrame:
    """Contiguous shares; the first members by id get one partition more where they don't divide evenly."""
    r = ranked_members(members)
    base, more = F.floor(F.lit(partitions) / F.col("n")), F.lit(partitions) % F.col("n")
    start = F.col("rank") * base + F.least("rank", more)
    size = base + F.when(F.col("rank") < more, 1).otherwise(0)
    x = r.withColumn("_start", start).withColumn("_size", size).filter("_size > 0")
    return x.select("group_no", "member_id", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_size") - 1)).alias("partition"))


def assign_round_robin(members: DataFrame, partitions: int) -> DataFrame:
    r = ranked_members(members).filter(F.col("rank") < partitions)
    return r.select("group_no", "member_id", F.explode(F.sequence(F.col("rank").cast("long"), F.lit(partitions - 1).cast("long"), F.col("n").cast("long"))).alias("partition"))


def assign_sticky(members: DataFrame, previous: DataFrame, partitions: int) -> DataFrame:
    """Keeps what members had, up to an even share, and deals the rest to those with the least.

    Everything is by rank: a member keeps its first ceil(P/M) partitions; shares differ by one at most, and the larger
    ones go to members that keep most. Free partitions and open places are both numbered, and meet by number.
    """
    r = ranked_members(members)
    p = F.lit(partitions)
    before = previous.join(r.select("group_no", "member_id"), ["group_no", "member_id"], "left_semi").filter(F.col("partition") < partitions)
    before = before.groupBy("group_no", "partition").agg(F.min("member_id").alias("member_id"))
    held = before.groupBy("group_no", "member_id").agg(F.count(F.lit(1)).alias("had"))
    w = Window.partitionBy("group_no").orderBy(F.desc("had"), "rank")
    share = r.join(held, ["group_no", "member_id"], "left").fillna(0, ["had"])
    share = share.withColumn("share", F.floor(p / F.col("n")) + F.when(F.row_number().over(w) <= p % F.col("n"), 1).otherwise(0))
    own = Window.partitionBy("group_no", "member_id").orderBy("partition")
    kept = before.withColumn("_k", F.row_number().over(own)).join(share.select("group_no", "member_id", "share"), ["group_no", "member_id"]).filter("_k <= share").select("group_no", "member_id", "partition")
    counts = kept.groupBy("group_no", "member_id").agg(F.count(F.lit(1)).alias("kept"))
    missing = share.join(counts, ["group_no", "member_id"], "left").withColumn("_open", F.col("share") - F.coalesce("kept", F.lit(0))).filter("_open > 0")
    places = missing.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_open").cast("long"))))
    places = places.withColumn("_no", F.row_number().over(Window.partitionBy("group_no").orderBy("_i", "rank"))).select("group_no", "member_id", "_no")
    every = r.select("group_no").distinct().withColumn("partition", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(partitions - 1).cast("long"))))
    free = every.join(kept, ["group_no", "partition"], "left_anti").withColumn("_no", F.row_number().over(Window.partitionBy("group_no").orderBy("partition")))
    return kept.unionByName(free.join(places, ["group_no", "_no"]).select("group_no", "member_id", "partition"))


def cooperative_round_one(target: DataFrame, previous: DataFrame) -> DataFrame:
    """Each member's partitions of the first round (target and previous), and those it has to give up."""
    lists = lambda df, name: df.groupBy("group_no", "member_id").agg(F.array_sort(F.collect_list("partition")).alias(name))
    x = lists(target, "_target").join(lists(previous, "_previous"), ["group_no", "member_id"], "full")
    none = F.expr("cast(array() as array<bigint>)")
    t, p = F.coalesce("_target", none), F.coalesce("_previous", none)
    keep, lost = F.array_sort(F.array_intersect(t, p)), F.array_sort(F.array_except(p, t))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return x.select("group_no", "member_id", text(keep).alias("kept"), text(lost).alias("revoked"), (F.size(F.array_except(t, keep)) > 0).alias("second_round"))


def duplicate_owners(assignment: DataFrame) -> DataFrame:
    """Partitions with more than one owner: such a submission is rejected as a whole."""
    return assignment.groupBy("group_no", "partition").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")
