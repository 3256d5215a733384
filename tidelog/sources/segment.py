"""Segment files: batches of records in a fixed big-endian layout, read from any store that Spark reads.

A batch is a header and its records. Fixed values, in order: magic 0xC0 (1 byte), length of what follows (4), CRC-32 of
all after it (4), base offset (8), last offset delta (4), base time (8), producer id (8), producer epoch (2), base
sequence (4), leader epoch (4), attributes (2), record count (4). A record: offset delta (4), time delta (8), key, value;
each a length (4, -1 is null) and its bytes. Attributes: codec in bits 0 to 2 (0 none, 1 lz4, 2 zstd), 8 transactional,
16 control.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, BODY, ENTRY = struct.Struct(">BII"), struct.Struct(">QIQQhiIHI"), struct.Struct(">Iq")
MAGIC, MOST_BYTES, MOST_RECORDS = 0xC0, 64 << 20, 100_000
CODECS = ("none", "lz4", "zstd")
RECORD = "topic string, partition long, log_offset long, ts_ms long, key binary, value binary, is_control boolean, is_transactional boolean, producer_id long, producer_epoch int, base_sequence int, leader_epoch long, batch_base_offset long, batch_last_offset long, codec string, encoded_size long"


def _optional(v: bytes | None) -> bytes:
    return struct.pack(">i", -1) if v is None else struct.pack(">i", len(v)) + v


def _packed(codec: int, data: bytes) -> bytes:
    if codec == 1:
        import pyarrow as pa

        return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    if codec == 2:
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    return data


def _unpacked(codec: int, data: bytes) -> bytes:
    if codec == 1:
        import pyarrow as pa

        (n,) = struct.unpack_from("<I", data)
        if n > MOST_BYTES:
            raise ValueError("a batch of more than 64 MiB")
        return pa.Codec("lz4_raw").decompress(data[4:], decompressed_size=n, asbytes=True)
    if codec == 2:
        import zstandard

        with zstandard.ZstdDecompressor(max_window_size=1 << 26).stream_reader(data) as r:
            out = r.read(MOST_BYTES + 1)
        if len(out) > MOST_BYTES:
            raise ValueError("a batch of more than 64 MiB")
        return out
    if codec:
        raise ValueError(f"unknown codec {codec}")
    return data


def encode(records, codec: str = "none", producer=(0, 0, 0), leader_epoch: int = 0, transactional: bool = False, control: bool = False) -> bytes:
    """A batch of records (offset, ts_ms, key, value) in the order of offset; producer: (id, epoch, base sequence)."""
    if not 0 < len(records) <= MOST_RECORDS:
        raise ValueError(f"a batch holds 1 to {MOST_RECORDS} records, not {len(records)}")
    base, t0 = records[0][0], records[0][1]
    data = b"".join(ENTRY.pack(o - base, t - t0) + _optional(k) + _optional(v) for o, t, k, v in records)
    if len(data) > MOST_BYTES:
        raise ValueError("a batch of more than 64 MiB")
    kind = CODECS.index(codec)
    body = BODY.pack(base, records[-1][0] - base, t0, producer[0], producer[1], producer[2], leader_epoch, kind | 8 * transactional | 16 * control, len(records)) + _packed(kind, data)
    return HEAD.pack(MAGIC, len(body) + 4, zlib.crc32(body)) + body


def decode(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(header and records, where the batch ends). Lengths are checked before they are believed."""
    if len(data) - at < HEAD.size + BODY.size:
        raise ValueError("a truncated batch")
    magic, length, crc = HEAD.unpack_from(data, at)
    end = at + 5 + length
    if magic != MAGIC or length < BODY.size + 4 or end > len(data):
        raise ValueError("no batch, or a truncated one")
    body = data[at + HEAD.size : end]
    if zlib.crc32(body) != crc:
        raise ValueError("a batch with a wrong CRC")
    base, last, t0, pid, epoch, seq, leader, attributes, n = BODY.unpack_from(body)
    raw = _unpacked(attributes & 7, body[BODY.size :])
    if n > MOST_RECORDS or n * 20 > len(raw):
        raise ValueError("more records than a batch can hold")
    records, p = [], 0

    def field() -> bytes | None:
        nonlocal p
        (size,) = struct.unpack_from(">i", raw, p)
        p += 4
        if size < -1 or p + max(size, 0) > len(raw):
            raise ValueError("a wrong length in a record")
        if size < 0:
            return None
        p += size
        return raw[p - size : p]

    for _ in range(n):
        delta, dt = ENTRY.unpack_from(raw, p)
        p += ENTRY.size
        key = field()
        records.append((base + delta, t0 + dt, key, field()))
    if p != len(raw):
        raise ValueError("data after the last record")
    head = {"batch_base_offset": base, "batch_last_offset": base + last, "producer_id": pid, "producer_epoch": epoch, "base_sequence": seq, "leader_epoch": leader, "codec": CODECS[attributes & 7], "is_transactional": bool(attributes & 8), "is_control": bool(attributes & 16), "encoded_size": end - at}
    return head | {"records": records}, end


def batches_of(data: bytes, active: bool = True):
    """The batches of a segment. A crash may leave the active one with a torn end, which is cut: a last batch that is not
    all there. Anything else that is no batch is an error, there and in older segments."""
    at = 0
    while at < len(data):
        whole = len(data) - at >= HEAD.size and at + 5 + HEAD.unpack_from(data, at)[1] <= len(data)
        if active and not whole and data[at] == MAGIC:
            return
        try:
            batch, at = decode(data, at)
        except (ValueError, struct.error) as e:
            raise ValueError(f"byte {at} of a segment: {e}") from e
        yield batch


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of the segment files <path>/<topic>-<partition>/*.log, by the store's own reader; a segment is a row.

    The active segment of a partition is the one with the last name; only its torn end is left out without an error.
    """
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def rows(frames):
        for f in frames:
            for where, content, active in zip(f.path, f.content, f.active, strict=True):
                topic, _, partition = where.rsplit("/", 2)[-2].rpartition("-")
                for b in batches_of(content, active):
                    head = {k: v for k, v in b.items() if k != "records"}
                    out = [{"topic": topic, "partition": int(partition), "log_offset": o, "ts_ms": t, "key": k, "value": v, **head} for o, t, k, v in b["records"]]
                    yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    last = files.select("path").groupBy(F.regexp_replace("path", r"[^/]*\z", "").alias("_folder")).agg(F.max("path").alias("_last"))  # names are base offsets
    x = files.withColumn("_folder", F.regexp_replace("path", r"[^/]*\z", "")).join(last, "_folder")
    return x.select("path", "content", (F.col("path") == F.col("_last")).alias("active")).mapInPandas(rows, RECORD)


def _arrow(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def encode_batches(records: DataFrame, of: int = 1000, codec: str = "zstd") -> DataFrame:
    """(topic, partition, base_offset, batch): records in batches of `of` offsets.

    Records reach a task in the order of batches and offsets; it holds one Arrow batch of them and what has come of one
    log batch, however many log batches it gets.
    """
    schema = "topic string, partition long, base_offset long, batch binary"

    def rows(frames):
        at, held = [], []
        for f in frames:
            for *to, o, t, k, v in zip(*[c.to_pylist() for c in f.columns], strict=True):
                if held and to != at:
                    yield _arrow([(*at[:2], held[0][0], encode(held, codec))], schema)
                    held = []
                at = to
                held.append((o, t, k, v))
        if held:
            yield _arrow([(*at[:2], held[0][0], encode(held, codec))], schema)

    key, value = (F.col(c).cast("binary").alias(c) for c in ("key", "value"))
    by = ["topic", "partition", "_batch"]
    x = records.select("topic", F.col("partition").cast("long").alias("partition"), F.floor(F.col("log_offset") / of).alias("_batch"), "log_offset", F.col("ts_ms").cast("long").alias("ts_ms"), key, value)
    return x.repartition(*by).sortWithinPartitions(*by, "log_offset", "ts_ms", "key", "value").mapInArrow(rows, schema)


def decode_batches(batches: DataFrame) -> DataFrame:
    """The records of encoded batches (topic, partition, batch), one batch after the other."""
    rest = [c.split()[0] for c in RECORD.split(", ")][6:]

    def rows(frames):
        for f in frames:
            for i in range(f.num_rows):
                topic, partition, data = (c[i].as_py() for c in f.columns)
                b, _ = decode(data)
                if b["records"]:
                    head = [b[c] for c in rest]
                    yield _arrow([(topic, partition, *r, *head) for r in b["records"]], RECORD)

    return batches.select("topic", F.col("partition").cast("long").alias("partition"), "batch").mapInArrow(rows, RECORD)
