"""Visibility under transactions: last stable offset, aborted ranges, committed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.log import TP, up_to_high_watermark

OPEN = ("Ongoing", "PrepareCommit", "PrepareAbort")
#: Offsets of a range are met in cells of this many, so that a join of records and ranges is an equi join.
CELL = 1024


def last_stable_offsets(transactions: DataFrame) -> DataFrame:
    """lso of each partition with a transaction in flight that has written; others have no row (no bound)."""
    x = transactions.filter(F.col("status").isin(*OPEN) & F.col("first_offset").isNotNull())
    return x.groupBy(*TP).agg(F.min("first_offset").alias("lso"))


def aborted_ranges(*sources: DataFrame) -> DataFrame:
    """Distinct (topic, partition, first_offset, last_offset) of aborted transactions in any of the sources."""
    out = None
    for t in sources:
        own = t.filter("status = 'Aborted'").select(*TP, "first_offset", "last_offset")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def outside(records: DataFrame, ranges: DataFrame, by: list[str] = TP) -> DataFrame:
    """Records in none of the inclusive ranges: an anti join on keys and cell, so any number of ranges joins by hash."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first_offset") / CELL), F.floor(F.col("last_offset") / CELL))))
    r = cells.select(*[F.col(c).alias(f"_{c}") for c in by], "_cell", F.col("first_offset").alias("_first"), F.col("last_offset").alias("_last"))
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    on += [F.floor(F.col("log_offset") / CELL) == F.col("_cell"), F.col("log_offset") >= F.col("_first"), F.col("log_offset") <= F.col("_last")]
    return records.join(r, on, "left_anti")


def committed_read(records: DataFrame, transactions: DataFrame, ends: DataFrame, by_producer: bool = False) -> DataFrame:
    """What a read-committed consumer sees: no control records, below hw and lso, outside aborted ranges.

    A range hides every record in it, whoever wrote it; by_producer hides the aborting producer's records only (records
    then have producer_id).
    """
    x = up_to_high_watermark(records.filter(~F.col("is_control")), ends)
    lso = last_stable_offsets(transactions)
    x = x.join(lso, TP, "left").filter("lso is null or log_offset < lso").drop("lso")
    if by_producer:
        ranges = transactions.filter("status = 'Aborted'").select(*TP, "producer_id", "first_offset", "last_offset").distinct()
        return outside(x, ranges, [*TP, "producer_id"])
    return outside(x, aborted_ranges(transactions))
