"""Keyed state: idempotent producers and leases, with the rules of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.producer import verdict

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with checkpoints in the shared folder, so that it may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Producers(StatefulProcessor):
    """Epoch and last accepted sequence of each producer; rows of a trigger are taken in the order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values("arrival")
        state = tuple(int(x) for x in self.last.get()) if self.last.exists() else None
        out = []
        for epoch, base, count in zip(f.epoch, f.base_sequence, f.n_records, strict=True):
            v, state = verdict(state, int(key[0]), int(epoch), int(base), int(count))
            out.append(v)
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame({"producer_id": key[0], "epoch": f.epoch, "base_sequence": f.base_sequence, "arrival": f.arrival, "verdict": out})

    def close(self) -> None:
        pass


def idempotent(attempts: DataFrame) -> DataFrame:
    """Adds verdict to a stream of attempts (producer_id, epoch, base_sequence, arrival, n_records)."""
    use_rocksdb(attempts.sparkSession)
    return attempts.groupBy("producer_id").transformWithStateInPandas(Producers(), "producer_id long, epoch long, base_sequence long, arrival long, verdict string", "Append", "None")


def lease_step(state: tuple | None, action: str, member: str, at_ms: int, lock_ms: int, most: int) -> tuple[tuple, str]:
    """One step of a lease: state is (state, owner, delivery count, until); returns the new one and what happened.

    A lease past its time is released first. Only Available ranges are acquired, and only the owner acknowledges.
    """
    s, owner, count, until = state or ("Available", None, 0, 0)
    if s == "Acquired" and at_ms >= until:
        s, owner = ("Available" if count < most else "Archived"), None
    if action == "acquire":
        if s != "Available":
            return (s, owner, count, until), "refused"
        return ("Acquired", member, count + 1, at_ms + lock_ms), "acquired"
    if s != "Acquired" or owner != member:
        return (s, owner, count, until), "ignored"
    if action == "renew":
        return (s, owner, count, at_ms + lock_ms), "renewed"
    if action == "accept":
        return ("Acknowledged", None, count, 0), "accepted"
    if action == "reject":
        return ("Archived", None, count, 0), "dead_lettered"
    if action == "yield":
        return ("Available", None, max(0, count - 1), 0), "yielded"
    return (("Available", None, count, 0), "released") if count < most else (("Archived", None, count, 0), "dead_lettered")


class Leases(StatefulProcessor):
    """State of each leased range; expiry follows the times in the rows, so that reruns agree."""

    def __init__(self, lock_ms: int = 30_000, most: int = 5):
        self.lock_ms, self.most = lock_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", "state string, owner string, count long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        state = tuple(self.lease.get()) if self.lease.exists() else None
        out = []
        for action, member, at in zip(f.action, f.member_id, f.at_ms, strict=True):
            state, what = lease_step(state, action, member, int(at), self.lock_ms, self.most)
            out.append((what, state[0], state[2]))
        self.lease.update(state)
        columns = dict(zip(("outcome", "state", "delivery_count"), map(list, zip(*out, strict=True)), strict=True))
        yield pd.DataFrame({"range_id": key[0], "seq": f.seq, **columns})

    def close(self) -> None:
        pass


def leases(actions: DataFrame, lock_ms: int = 30_000, most: int = 5) -> DataFrame:
    """Outcome of each action (range_id, seq, action, member_id, at_ms) on a leased range."""
    use_rocksdb(actions.sparkSession)
    return actions.groupBy("range_id").transformWithStateInPandas(Leases(lock_ms, most), "range_id long, seq long, outcome string, state string, delivery_count long", "Append", "None")
