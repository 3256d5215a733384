"""Arithmetic of replicas: watermarks, acknowledgements, votes, in-sync sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.log import TP


def high_watermarks(partitions: DataFrame, replicas: DataFrame) -> DataFrame:
    """partitions (topic, partition, leo, min_isr); replicas in sync with their last offset held (watermark).

    With min_isr above one all in-sync replicas have to hold a record, else the leader alone decides.
    """
    least = replicas.groupBy(*TP).agg((F.min("watermark") + 1).alias("_held"))
    x = partitions.join(least, TP, "left")
    hw = F.when(F.col("min_isr") > 1, F.least(F.coalesce("_held", F.lit(0)), "leo")).otherwise(F.col("leo"))
    return x.withColumn("hw", hw).drop("_held")


def fully_acked(replicas: DataFrame, target: str, min_isr: int) -> DataFrame:
    """Whether enough replicas are in sync and all of them reached the target; a missing watermark has not."""
    x = replicas.groupBy(*TP).agg(F.bool_and(F.coalesce(F.col("watermark") >= F.col(target), F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("_n"))
    return x.select(*TP, (F.col("_all") & (F.col("_n") >= min_isr)).alias("acked"))


def elected(votes: DataFrame, voters: int) -> DataFrame:
    """Candidates with more than half of all voters in a term."""
    x = votes.filter("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return x.filter(F.col("votes") >= voters // 2 + 1)


def shrunk_isr(isr: Column, alive: Column) -> Column:
    return F.array_intersect(isr, alive)


def failover(partitions: DataFrame, acks: DataFrame, now_ms: int, most_lag_ms: int, unclean: bool = False) -> DataFrame:
    """partitions (topic, partition, leader, replicas, isr) with acks (node, last_ack_ms): the new isr and leader.

    A replica that was never heard of is out of sync; a leader never heard of counts as alive. A dead leader's place
    goes to the smallest in-sync node that is alive, or (unclean) to the smallest replica alive.
    """
    ages = acks.agg(F.map_from_entries(F.collect_list(F.struct("node", "last_ack_ms"))).alias("_seen"))  # a row a broker
    x = partitions.join(F.broadcast(ages))
    fresh = lambda n: F.coalesce(F.lit(now_ms) - F.element_at("_seen", n) <= most_lag_ms, F.lit(False))
    x = x.withColumn("_dead", F.coalesce(F.lit(now_ms) - F.element_at("_seen", F.col("leader")) > most_lag_ms, F.lit(False)))
    x = x.withColumn("new_isr", F.filter("isr", lambda n: fresh(n) | ((n == F.col("leader")) & ~F.col("_dead"))))
    heir = F.array_min("new_isr")
    if unclean:
        heir = F.coalesce(heir, F.array_min(F.filter("replicas", fresh)))
    return x.withColumn("new_leader", F.when(F.col("_dead"), heir).otherwise(F.col("leader"))).drop("_seen", "_dead")
