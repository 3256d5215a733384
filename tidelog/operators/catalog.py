"""Topics, brokers, access rules and configuration, as folds of change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.policy import glob_match, topic_name_ok


def latest_entity(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last change of each entity; deleted ones (op = 'delete') are gone."""
    rest = [c for c in changes.columns if c not in keys]
    x = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(*keys, "_last.*")
    return x.filter("op <> 'delete'") if "op" in rest else x


def rosters(changes: DataFrame) -> DataFrame:
    """(topic, partition, leader, replicas) from leadership changes: replicas are the last named since the topic was
    made, else the in-sync ones, and in-sync members that are missing there are added at the end."""
    made = changes.filter("op = 'create'").groupBy("topic").agg(F.max("seq").alias("_made"))
    x = changes.filter("op = 'leader'").join(made, "topic").filter("seq > _made")
    named = F.max_by("replicas", F.when(F.size("replicas") > 0, F.col("seq")))
    x = x.groupBy("topic", "partition").agg(F.max_by("leader", "seq").alias("leader"), F.max_by("isr", "seq").alias("isr"), named.alias("named"))
    return x.select("topic", "partition", "leader", F.array_union(F.coalesce("named", "isr"), "isr").alias("replicas"))


def describe_topics(topics: DataFrame, partitions: DataFrame) -> DataFrame:
    """A row for each partition a topic should have; those without state get 0 as high watermark and no leader."""
    every = topics.select("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_partitions").cast("long") - 1)).alias("partition"))
    x = every.join(partitions, ["topic", "partition"], "left")
    return x.select("topic", "partition", F.coalesce("hw", F.lit(0)).alias("hw"), F.coalesce("leader", F.lit(-1)).cast("long").alias("leader"))


def list_topics(topics: DataFrame, open_: DataFrame) -> DataFrame:
    return topics.select("topic").union(open_.select("topic")).distinct().filter(~F.startswith("topic", F.lit("__"))).orderBy("topic")


def unassigned(topics: DataFrame, assignments: DataFrame) -> DataFrame:
    every = topics.select("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_partitions").cast("long") - 1)).alias("partition"))
    return every.join(assignments, ["topic", "partition"], "left_anti")


def undiscovered(peers: DataFrame, registered: DataFrame) -> DataFrame:
    """Configured peers (node) that no broker has registered as."""
    return peers.join(registered, "node", "left_anti")


def merged_config(stored: Column, upserts: Column, deletes: Column) -> Column:
    """Deletes first, then upserts, so a key in both is set."""
    rest = F.map_filter(stored, lambda k, v: ~F.array_contains(deletes, k) & ~F.array_contains(F.map_keys(upserts), k))
    return F.map_concat(rest, upserts)


def effective_config(defaults: Column, stored: Column) -> Column:
    """The stored values over the defaults; an empty value clears the setting."""
    kept = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(stored), k))
    return F.map_filter(F.map_concat(kept, stored), lambda k, v: v != "")


def authorize(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed to requests (request_id, principal, host, operation, resource_type, resource): any matching deny
    wins, else any matching allow; without a rule the answer is no.

    Rules (principal, host, operation, resource_type, resource, pattern, permission) meet requests by equality: a literal
    one by its resource, any other by its head, the text before its first star (a prefix rule: all of it), which has to
    begin the resource. There are at most as many lengths of heads as a name may have characters, and only those come
    to the driver. Heads of no length meet all requests of their type, as they have to. The answer depends on the fields
    alone, so rules meet each distinct combination once and requests look theirs up: no step keeps a group a request.
    """
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in rules.columns])
    exact = (F.col("_pattern") == "literal") & (F.col("_resource") != "*")
    head = F.when((F.col("_pattern") == "prefix") | exact, F.col("_resource")).otherwise(F.substring_index("_resource", "*", 1))
    r = r.withColumn("_exact", exact).withColumn("_head", head)
    lengths = sorted(x[0] for x in r.filter("not _exact").select(F.length("_head")).distinct().collect() if x[0] is not None)
    who = ((F.col("_principal") == "*") | (F.col("_principal") == F.col("principal"))) & ((F.col("_host") == "*") | (F.col("_host") == F.col("host"))) & ((F.col("_operation") == "All") | (F.col("_operation") == F.col("operation")))
    fits = F.when(F.col("_pattern") == "prefix", F.startswith("resource", "_resource")).when(F.col("_pattern") == "glob", glob_match("_resource", "resource")).otherwise(F.lit(True))
    part = lambda text, is_exact: F.struct(text.alias("head"), F.lit(is_exact).alias("exact"))
    heads = [part(F.col("resource"), True), *[part(F.substring("resource", 1, n), False) for n in lengths]]
    fields = ["principal", "host", "operation", "resource_type", "resource"]
    distinct = requests.select(*fields).distinct()
    asked = distinct.withColumn("_h", F.explode(F.array_distinct(F.array(*heads))))
    on = (F.col("resource_type") == F.col("_resource_type")) & (F.col("_h.head") == F.col("_head")) & (F.col("_h.exact") == F.col("_exact")) & who & fits
    found = asked.join(r, on).groupBy(*fields).agg(F.max(F.col("_permission") == "Deny").alias("denied"), F.max(F.col("_permission") == "Allow").alias("granted"))
    granted = found.filter("granted and not denied").select(*[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_yes"))
    x = requests.join(granted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields], "left")
    return x.select(*requests.columns, F.coalesce("_yes", F.lit(False)).alias("allowed"))


def list_rules(rules: DataFrame, **wanted: str | None) -> DataFrame:
    """Rules that agree with each field of a filter; None, the empty string, `*` and `Any` leave a field open."""
    for c, v in wanted.items():
        if v not in (None, "", "*", "Any"):
            rules = rules.filter(F.col(c) == v)
    return rules


RULE = ["principal", "host", "operation", "resource_type", "resource", "pattern", "permission"]


def rules_in_force(changes: DataFrame) -> DataFrame:
    """The rules after a log of changes (the fields of a rule, op add or remove, seq): a rule is there if its last change
    added it; adding one twice or removing one that isn't there changes nothing."""
    return changes.groupBy(*RULE).agg(F.max_by("op", "seq").alias("_op")).filter("_op = 'add'").drop("_op")


# the metadata log: changes (seq, op, topic or node, ...) of topics, their configuration and brokers


def judged_creations(changes: DataFrame, most_partitions: int = 10_000) -> DataFrame:
    """Creations of topics with a verdict, in the order of seq: a bad name or number of partitions is invalid; a topic
    that exists at that time already_exists; else created."""
    from tidelog.operators.ranking import running_max

    ok = topic_name_ok("topic") & F.col("n_partitions").between(1, most_partitions)
    x = changes.filter("op in ('create', 'delete')").withColumn("_ok", (F.col("op") == "create") & ok)
    x = x.withColumn("_gone", F.when(F.col("op") == "delete", F.col("seq"))).withColumn("_made", F.when(F.col("_ok"), F.col("seq")))
    x = running_max(running_max(x, ["topic"], "seq", "_gone", "_deleted", include=False), ["topic"], "seq", "_made", "_last", include=False)
    there = F.coalesce(F.col("_last") > F.coalesce("_deleted", F.lit(-1)), F.lit(False))
    verdict = F.when(~F.col("_ok"), "invalid").when(there, "already_exists").otherwise("created")
    return x.filter("op = 'create'").withColumn("verdict", verdict).drop("_ok", "_gone", "_made", "_deleted", "_last")


def topics_in_force(changes: DataFrame, most_partitions: int = 10_000) -> DataFrame:
    """(topic, seq, n_partitions, replication) of the topics there are after all creations and deletions."""
    made = judged_creations(changes, most_partitions).filter("verdict = 'created'").groupBy("topic").agg(F.max_by(F.struct("seq", "n_partitions", "replication"), "seq").alias("t"))
    gone = changes.filter("op = 'delete'").groupBy("topic").agg(F.max("seq").alias("_gone"))
    return made.join(gone, "topic", "left").filter("_gone is null or t.seq > _gone").select("topic", "t.*")


def configs_in_force(changes: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, key, value) after all changes of configuration since each topic was made: op replace (configs, a map) sets
    all of them, op alter sets `configs` and takes away `removed` (a key in both is set)."""
    x = changes.filter("op in ('replace', 'alter')").join(topics.select("topic", F.col("seq").alias("_made")), "topic").filter("seq > _made")
    last = x.filter("op = 'replace'").groupBy("topic").agg(F.max("seq").alias("_reset"))
    x = x.join(last, "topic", "left").filter("_reset is null or seq >= _reset")
    none = F.expr("cast(array() as array<string>)")
    gone = F.transform(F.array_except(F.when(F.col("op") == "alter", F.coalesce("removed", none)).otherwise(none), F.map_keys("configs")), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))
    x = x.select("topic", "seq", F.explode(F.concat(F.map_entries("configs"), gone)).alias("e")).select("topic", "seq", "e.*")
    return x.groupBy("topic", "key").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("topic", "key", "v.value").filter("value is not null")


def brokers_in_force(changes: DataFrame) -> DataFrame:
    """(node, address) of the brokers whose last change registered them; the address is that of the last registration."""
    x = changes.filter("op in ('register', 'unregister')").groupBy("node").agg(F.max_by(F.struct("op", "address"), "seq").alias("l"))
    return x.filter("l.op = 'register'").select("node", "l.address")


def eviction_order(producers: DataFrame, open_: DataFrame, k: int) -> DataFrame:
    """The k producers least recently used that have no open transaction (a limit is the feature)."""
    return producers.join(open_, "producer_id", "left_anti").orderBy("last_used", "producer_id").limit(k)
