"""Where a key and a topic go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def partition_for(key, partitions: int) -> Column:
    """CRC-32 of the key's bytes modulo the partitions; no key, an empty key or no partitions mean partition 0."""
    if partitions <= 0:
        return F.lit(0).cast("long")
    k = _col(key).cast("binary")
    return F.when(F.length(k) > 0, F.crc32(k) % partitions).otherwise(F.lit(0)).cast("long")


def placement_seed(topic: str) -> int:
    """64-bit FNV-1a of the topic's name. Offset basis and prime."""
    basis, prime = 0xCBF29CE484222325, 0x100000001B3
    seed = basis
    for byte in topic.encode():
        seed = (seed ^ byte) * prime % 2**64
    return seed


def striped_replicas(topics: DataFrame, brokers: list[int], replication: int) -> DataFrame:
    """(topic, partition, leader, replicas) of topics (topic, partitions): neighbours on the sorted broker ring.

    A topic starts at its seed's place, each partition one broker further; there are at most as many replicas as brokers.
    """
    ring, copies = sorted(brokers), min(replication, len(brokers))
    start = F.pandas_udf(lambda names: names.map(lambda t: placement_seed(t) % max(1, len(ring))).astype("int64"), "long")  # a topic a row
    x = topics.withColumn("_start", start("topic")).withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("partitions").cast("int") - 1)))
    nodes = F.array(*[F.lit(b) for b in ring])
    at = lambda j: F.element_at(nodes, ((F.col("_start") + F.col("partition") + j) % len(ring) + 1).cast("int"))
    replicas = F.array(*[at(j) for j in range(copies)])
    return x.select("topic", F.col("partition").cast("long").alias("partition"), replicas.alias("replicas")).withColumn("leader", F.element_at("replicas", 1))
