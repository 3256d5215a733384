"""Idempotent and transactional producers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranking import running_max

VERDICTS = ("accepted", "duplicate", "out_of_order", "fenced")


def exact_retries_dropped(attempts: DataFrame) -> DataFrame:
    """First arrival of each (producer, epoch, sequence)."""
    return attempts.groupBy("producer_id", "epoch", "base_sequence").agg(F.min("arrival").alias("arrival"))


def sequence_gaps(attempts: DataFrame) -> DataFrame:
    """Distinct sequences that don't follow the one before: (producer_id, base_sequence, previous)."""
    x = attempts.select("producer_id", "base_sequence").distinct()
    x = running_max(x, ["producer_id"], "base_sequence", "base_sequence", "previous", include=False)
    return x.filter("previous is not null and base_sequence <> previous + 1")


def verdict(state: tuple[int, int] | None, producer_id: int, epoch: int, base: int, count: int) -> tuple[str, tuple[int, int] | None]:
    """One step: state is (epoch, last sequence) of a producer or None; producer 0 is not tracked."""
    if producer_id == 0:
        return "accepted", state
    if state is not None:
        if epoch < state[0]:
            return "fenced", state
        if epoch == state[0]:
            if base <= state[1]:
                return "duplicate", state
            if base > state[1] + 1:
                return "out_of_order", state
    return "accepted", (epoch, base + count - 1)


def idempotent_fold(attempts: DataFrame) -> DataFrame:
    """Adds verdict to attempts (producer_id, epoch, base_sequence, arrival, n_records), in the order of arrival.

    Whether a batch is accepted depends on the last one accepted. Rows are dealt by producer and sorted; one pass keeps
    one producer's last sequence at a time.
    """
    names = ["producer_id", "epoch", "base_sequence", "arrival"]
    rows = attempts.select(*names, (F.col("n_records") if "n_records" in attempts.columns else F.lit(1)).alias("n_records"))

    def fold(frames):
        at, state = None, None
        for f in frames:
            out = []
            for pid, epoch, base, count in zip(f.producer_id, f.epoch, f.base_sequence, f.n_records, strict=True):
                if pid != at:
                    at, state = pid, None
                v, state = verdict(state, pid, epoch, base, count)
                out.append(v)
            yield f[names].assign(verdict=out)

    dealt = rows.repartition("producer_id").sortWithinPartitions("producer_id", "arrival")
    kinds = ", ".join(f"{c} {attempts.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInPandas(fold, f"{kinds}, verdict string")


def judged_requests(requests: DataFrame, arrival: str) -> DataFrame:
    """Adds verdict to requests (transactional_id, epoch, is_init) in the order of arrival: an init sets the id's epoch;
    any other request is ok with the epoch that is current when it comes, fenced with another one, and unknown before
    the first init."""
    x = requests.withColumn("_set", F.when(F.col("is_init"), F.col("epoch")))
    x = running_max(x, ["transactional_id"], arrival, "_set", "_current", include=False)  # epochs only rise
    verdict = F.when(F.col("is_init"), "init").when(F.col("_current").isNull(), "unknown").when(F.col("epoch") == F.col("_current"), "ok").otherwise("fenced")
    return x.withColumn("verdict", verdict).drop("_set", "_current")


def duplicate_answers(judged: DataFrame) -> DataFrame:
    """For attempts with verdict and, where accepted, last_offset: adds answer, the offset a producer is told, which for
    a duplicate is that of its last accepted batch."""
    x = judged.withColumn("_took", F.when(F.col("verdict") == "accepted", F.col("last_offset")))
    x = running_max(x, ["producer_id"], "arrival", "_took", "_last")  # offsets rise with arrival
    return x.withColumn("answer", F.when(F.col("verdict").isin("accepted", "duplicate"), F.col("_last"))).drop("_took", "_last")


def latest_status(changes: DataFrame) -> DataFrame:
    """Each transaction's status: its last change that is allowed. The first decision, prepared or final, stays: later
    changes that are undecided or decide otherwise are refused."""
    kind = F.when(F.col("status").isin("PrepareCommit", "Committed"), "commit").when(F.col("status").isin("PrepareAbort", "Aborted"), "abort").otherwise("open")
    x = changes.withColumn("_kind", kind)
    last = lambda k: F.max(F.when(F.col("_kind") == k, F.struct("seq", "status"))).alias(k)
    decided = F.min(F.when(F.col("_kind") != "open", F.struct("seq", "_kind")))["_kind"]
    x = x.groupBy("transaction_id").agg(decided.alias("_decided"), last("commit"), last("abort"), last("open"))
    kept = F.when(F.col("_decided") == "commit", F.col("commit")).when(F.col("_decided") == "abort", F.col("abort")).otherwise(F.col("open"))
    return x.select("transaction_id", kept["status"].alias("status"), kept["seq"].alias("seq"))


def timeout_actions(transactions: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """What a sweep does with transactions past their time: ongoing ones abort, prepared ones finish as decided."""
    late = transactions.filter(F.lit(now_ms) - F.col("created_at_ms") > timeout_ms)
    action = F.when(F.col("status").isin("Ongoing", "PrepareAbort"), "abort").when(F.col("status") == "PrepareCommit", "commit")
    return late.withColumn("action", action).filter("action is not null")
