"""Connected components of an edge table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v), both ways. Each u hangs its larger (small: its smaller) neighbours, and itself, on its least."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = pairs.join(least.hint("shuffle_hash"), F.col("u") == F.col("_u"))
    keep = F.col("v") < F.col("u") if small else F.col("v") > F.col("u")
    out = joined.filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the smallest node that can be reached.

    Nodes may be of any ordered type. Loops and repeated edges are ignored; nulls are not allowed; no edges, no rows.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = cut(_star(both(_star(both(now), False)), True))
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
