"""Best-fit packing planned on a length histogram.

The plan sees counts, not documents: lengths from long to short, each count of equal pieces goes to the open sequences
whose rest fits best, a run of sequences at a time. It is a list of (length, ranks from, to, first sequence, offset),
whose size depends on the capacity and not on the corpus. Each piece then finds its place by its rank in its length.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, ranked, small_batches, texts
from tidelog.llm.tokens import RANKS, VOCABULARY, by_bytes, encoder

CAPACITY, END = 2048, b"\0\0\0\0"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: (length, rank from, rank to, first sequence, offset), ranks from 0 in each length.

    Every step uses up a length or a run of open sequences, and opens at most two runs.
    """
    rest: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: runs (first sequence, how many)
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = next((r for r in range(length, capacity) if rest[r]), None)
            if free is None:
                n = -(-left // (capacity // length))
                rest[capacity].append((sequences, n))
                sequences, free = sequences + n, capacity
            first, n = rest[free].pop()
            used = min(n, left)
            if used < n:
                rest[free].append((first + used, n - used))
            rest[free - length].append((first, used))
            out.append((length, rank, rank + used, first, capacity - free))
            rank, left = rank + used, left - used
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a text's ids and a final 0, cut if they are more than `capacity`.

    All pieces but the first are full.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(vocabulary, ranks).encode
        for whole in batches:
            for b in by_bytes(whole):
                at, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(b.column("text").to_pylist()):
                    ids = encode(text) + END
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        at.append(k)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                made = [pa.array(piece, pa.int32()), *[pa.array(v, pa.int64()) for v in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the final 0 alone; null doc_ids and repeated rows are packed each for itself;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, capacity, vocabulary, ranks))
    counts = {x["length"]: x["n"] for x in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps = spark.createDataFrame(plan(counts, capacity), "_length long, _from long, _to long, _first long, offset long")
    placed = ranked(made.withColumn("_key", F.struct("doc_id", "piece")), ["length"], F.col("_key"), "_rank").drop("_key")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    out = placed.join(F.broadcast(steps), on)  # the plan's size is bounded by the capacity
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")
