"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through.

A window is WIDTH consecutive words of one document. Documents are dealt to chunks by a hash of doc_id.

1. Exact copies of a whole text are settled by a digest: all but the smallest doc_id repeat it from end to end.
2. Each chunk adds its windows to a partial count-min sketch of DEPTH rows: a cell number for each window and row,
   kept sparse, as sorted gaps, at most two of a kind (a count of two is all that is asked). Cell space is divided
   into blocks; partial sketches are merged by block, and each chunk gets back its own cells whose merged count is
   two or more. Counts are never too low, so no repeated window is lost; neither sketch nor answer is ever whole
   in one place, so its width grows with the corpus.
3. A chunk's windows whose estimate (the least of its rows) is two or more go on with a 96-bit hash, once for each
   chunk with the smallest doc_id; grouping these exactly gives the first place of each. A window that a third of
   all documents share gives one entry for each chunk and not one for each document.
4. Chunks learn which of their windows start earlier elsewhere, find repeats among themselves, and drop the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernel
from tidelog.llm.common import cut, small_batches, tasks_for, texts

WIDTH, DEPTH, CELL_BITS = 20, 2, 24
#: Bytes of text in a chunk and windows in a block of the sketch, about.
CHUNK_BYTES, BLOCK_WINDOWS = 8 << 20, 2 << 20
KEY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8")])
LOST = np.dtype([("a", "<u8"), ("b", "<u4")])
NO_ID = np.iinfo(np.int64).min
FULL = 0xFFFF


def pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as 16-bit gaps; a gap of FULL or more is written as FULLs and a rest."""
    gaps = np.diff(cells, prepend=0)
    over = gaps // FULL
    out = np.full(len(gaps) + int(over.sum()), FULL, np.uint16)
    out[np.cumsum(over + 1) - 1] = gaps % FULL
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != FULL]


def cells(hashes: np.ndarray, row: int, blocks: int) -> np.ndarray:
    """Block and cell of each window in a row of the sketch, as block << CELL_BITS | cell."""
    x = kernel.mix(hashes + kernel.splitmix(DEPTH + 1, 77)[row])
    return (((x >> np.uint64(32)) % np.uint64(blocks)) << np.uint64(CELL_BITS) | (x & np.uint64((1 << CELL_BITS) - 1))).astype(np.int64)


class Chunk:
    """The texts of a chunk in the order of doc_id, with the exact copies of others set apart."""

    def __init__(self, table: pa.Table, copies: set[tuple[int, str]] = frozenset()):
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.text = ids[order], table.column("text").combine_chunks().take(pa.array(order))
        if isinstance(self.text, pa.ChunkedArray):
            self.text = self.text.combine_chunks()
        copied = {i for i, _ in copies}
        self.copy = np.zeros(len(ids), bool)
        for k in np.flatnonzero(np.isin(self.ids, np.fromiter(copied, np.int64, len(copied)))) if copied else ():
            self.copy[k] = (int(self.ids[k]), hashlib.md5(self.text[int(k)].as_py().encode()).hexdigest()) in copies

    def windows(self, width: int, second: bool):
        """(row, start word, hash[, second hash]) of all windows of rows that are no copies, and words of each row."""
        parts, count = [], np.zeros(len(self.ids), np.int64)
        for x in kernel.blocks(self.text):
            starts, ends, before = x.words()
            count[x.lo : x.hi] = np.diff(before)
            h, first = kernel.windows(x.word_hashes(starts, ends), before, width)
            row = np.searchsorted(before, first, "right") - 1
            own = ~self.copy[x.lo + row]
            part = [(x.lo + row)[own], (first - before[row])[own], h[own]]
            if second:
                g, _ = kernel.windows(x.word_hashes(starts, ends, seed=1), before, width, seed=1)
                part.append((g[own] >> np.uint64(32)).astype(np.uint32))
            parts.append(part)
        kinds = [np.int64, np.int64, np.uint64, np.uint32][: 3 + second]
        return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)], count


def runs(keys: np.ndarray):
    """(key, from, to) of each run of equal values."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    bounds = np.concatenate([[0], edge, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    return ((keys[a], a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def ids_out(ids) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, mask=ids == NO_ID)


def copies_in(right: pa.Table) -> set[tuple[int, str]]:
    if not right.num_rows:  # a group with nothing on this side has no columns either
        return set()
    own = right.filter(pc.equal(right.column("row"), -1))
    return set(zip(own.column("copy").to_pylist(), (x.decode() for x in own.column("payload").to_pylist()), strict=True))


def sketch(blocks: int, width: int):
    """A chunk's partial sketch: (row, block, chunk, payload)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "block": [], "chunk": [], "payload": []}
        if left.num_rows:
            (_, _, h), _ = Chunk(left, copies_in(right)).windows(width, False)
            for r in range(DEPTH):
                c = np.sort(cells(h, r, blocks))
                third = np.zeros(len(c), bool)
                third[2:] = c[2:] == c[:-2]  # two of a kind are enough
                c = c[~third]
                for b, lo, hi in runs(c >> CELL_BITS):
                    out["row"].append(r)
                    out["block"].append(int(b))
                    out["chunk"].append(key[0].as_py())
                    out["payload"].append(pack(c[lo:hi] & ((1 << CELL_BITS) - 1)))
        return pa.table(out, SKETCH)

    return run


SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])
SIDE = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("copy", pa.int64()), ("payload", pa.binary())])
FOUND = pa.schema([("kind", pa.string()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("block", pa.int32()), ("payload", pa.binary())])
DONE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def merge(table: pa.Table) -> pa.Table:
    """One block of one row: merged counts, and for each chunk its cells that reach two."""
    got = [unpack(x) for x in table.column("payload").to_pylist()]
    chunks, r, b = table.column("chunk").to_numpy(), table.column("row")[0].as_py(), table.column("block")[0].as_py()
    every = np.sort(np.concatenate(got))
    often = np.unique(every[1:][every[1:] == every[:-1]])
    out = {"chunk": [], "row": [], "block": [], "copy": [], "payload": []}
    for c, x in zip(chunks, got, strict=True):
        x = np.unique(x)
        at = np.searchsorted(often, x)
        x = x[often[np.minimum(at, len(often) - 1)] == x] if len(often) else x[:0]
        if len(x):
            for k, v in (("chunk", int(c)), ("row", r), ("block", b), ("copy", None), ("payload", pack(x))):
                out[k].append(v)
    return pa.table(out, SIDE)


def inside(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted members."""
    if not len(members):
        return np.zeros(len(x), bool)
    return members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x


def kept(text: str, gone: np.ndarray | None, whole: bool, keep_text: bool) -> tuple[str | None, int, str]:
    """Text and digest of the words left, joined by a space, and how many went. gone: a mask; whole: all go."""
    words = text.encode().split()  # on ASCII white space, as the definition of words has it
    if whole:
        left = []
    else:
        left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    joined = b" ".join(left)
    return (joined.decode() if keep_text else None), len(words) - len(left), hashlib.sha256(joined).hexdigest()


def candidates(blocks: int, width: int, keep_text: bool):
    """Documents without a window estimated repeated are done; the others wait, and their windows are keys to group."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f: [] for f in FOUND.names}

        def put(kind, doc=None, text=None, n=None, gone=None, sha=None, block=None, payload=None):
            for f, v in zip(FOUND.names, (kind, key[0].as_py(), doc, text, n, gone, sha, block, payload), strict=True):
                out[f].append(v)

        if left.num_rows:
            c = Chunk(left, copies_in(right))
            (row, _, a, b), count = c.windows(width, True)
            maybe = np.ones(len(a), bool)
            for r in range(DEPTH):
                own = right.filter(pc.equal(right.column("row"), r)) if right.num_rows else SIDE.empty_table()
                told = [(int(k) << CELL_BITS) + unpack(x) for k, x in zip(own.column("block").to_pylist(), own.column("payload").to_pylist(), strict=True)]
                maybe &= inside(cells(a, r, blocks), np.sort(np.concatenate(told)) if told else np.zeros(0, np.int64))
            waits = np.zeros(len(c.ids), bool)
            waits[row[maybe]] = True
            for k, text in enumerate(c.text.to_pylist()):
                doc, n = None if c.ids[k] == NO_ID else int(c.ids[k]), int(count[k])
                if waits[k]:
                    put("wait", doc, text, n)
                else:
                    left_text, gone, sha = kept(text, None, bool(c.copy[k]) and n >= width, keep_text)
                    put("done", doc, left_text, n, gone, sha)
            keys = np.zeros(int(maybe.sum()), KEY)
            keys["a"], keys["b"], keys["doc"] = a[maybe], b[maybe], c.ids[row[maybe]]
            keys = keys[np.lexsort((keys["doc"], keys["b"], keys["a"]))]
            first = np.ones(len(keys), bool)
            first[1:] = (keys["a"][1:] != keys["a"][:-1]) | (keys["b"][1:] != keys["b"][:-1])
            keys = keys[first]
            part = ((keys["a"] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            for p, lo, hi in runs(part):
                put("key", block=int(p), payload=keys[lo:hi].tobytes())
        return pa.table(out, FOUND)

    return run


def group(table: pa.Table) -> pa.Table:
    """Exact grouping of the keys of one block: for each chunk those whose first place is in another chunk."""
    chunk_of, arrays = table.column("chunk").to_numpy(), [np.frombuffer(x, KEY) for x in table.column("payload").to_pylist()]
    keys, chunk = np.concatenate(arrays), np.repeat(chunk_of, [len(x) for x in arrays])
    order = np.lexsort((keys["doc"], keys["b"], keys["a"]))
    keys, chunk = keys[order], chunk[order]
    later = np.zeros(len(keys), bool)
    later[1:] = (keys["a"][1:] == keys["a"][:-1]) & (keys["b"][1:] == keys["b"][:-1])
    keys, chunk = keys[later], chunk[later]
    order = np.argsort(chunk, kind="stable")
    lost = np.zeros(len(keys), LOST)
    lost["a"], lost["b"] = keys["a"][order], keys["b"][order]
    out = [(int(c), lost[lo:hi].tobytes()) for c, lo, hi in runs(chunk[order])]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})


def settle(width: int, keep_text: bool):
    """Drops the words of the waiting documents of a chunk that a repeated window covers."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f: [] for f in DONE.names}
        if left.num_rows:
            c = Chunk(left)
            (row, start, a, b), count = c.windows(width, True)
            order = np.lexsort((start, row, b, a))  # rows are in the order of doc_id
            gone = np.zeros(len(a), bool)
            sa, sb, sr, ss = a[order], b[order], row[order], start[order]
            again = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
            head = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), np.arange(len(sa)), 0)) if len(sa) else np.zeros(0, np.int64)
            tied = (c.ids[sr] == c.ids[sr[head]]) & (ss == ss[head])  # the first place itself, also in a repeated row
            gone[order] = ~tied
            lost = np.concatenate([np.frombuffer(x, LOST) for x in (right.column("payload").to_pylist() if right.num_rows else [])] or [np.zeros(0, LOST)])
            lost = lost[np.lexsort((lost["b"], lost["a"]))]
            lo, hi = np.searchsorted(lost["a"], a), np.searchsorted(lost["a"], a, "right")
            for j in range(int((hi - lo).max()) if len(a) else 0):
                at = np.minimum(lo + j, max(len(lost) - 1, 0))
                gone |= (lo + j < hi) & (lost["b"][at] == b)
            begin = np.searchsorted(row, np.arange(len(c.ids) + 1))
            for k, text in enumerate(c.text.to_pylist()):
                own = slice(begin[k], begin[k + 1])
                at = start[own][gone[own]]
                edge = np.zeros(int(count[k]) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                left_text, n, sha = kept(text, np.cumsum(edge)[:-1] > 0, False, keep_text)
                for f, v in zip(DONE.names, (None if c.ids[k] == NO_ID else int(c.ids[k]), left_text, int(count[k]), n, sha), strict=True):
                    out[f].append(v)
        return pa.table(out, DONE)

    return run


def drop_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of `docs`: doc_id, text (the words left, joined by a space; null unless keep_text), n_words,
    n_removed, kept_sha256 (of the words left).

    A word goes if a window of `width` words that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Null texts have no words; a null doc_id counts as the smallest; rows that repeat a doc_id are
    one document, so the same window at the same start in two of them is no repeat; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    light = cut(rows.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("bytes")))
    total = light.agg(F.sum("bytes")).first()[0] or 0
    chunks = max(tasks_for(spark), -(-total // chunk_bytes))
    blocks = max(1, -(-(total // 6) // block_windows))
    first = light.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("_d"), "least")
    chunk_of = F.pmod(F.hash(F.coalesce("doc_id", F.lit(NO_ID)), F.lit(3)), F.lit(chunks)).cast("int")
    copies = light.join(first, F.col("digest") == F.col("_d")).filter(F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least"))
    copies = cut(copies.select(chunk_of.alias("chunk"), F.lit(-1).alias("row"), F.lit(0).alias("block"), F.coalesce("doc_id", F.lit(NO_ID)).alias("copy"), F.col("digest").cast("binary").alias("payload")))

    dealt = rows.withColumn("chunk", chunk_of).repartition(chunks, "chunk")  # about a chunk a task, however many there are
    partial = dealt.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(sketch(blocks, width), ddl(SKETCH))
    told = partial.groupBy("row", "block").applyInArrow(merge, ddl(SIDE))
    found = cut(dealt.groupBy("chunk").cogroup(copies.unionByName(told).groupBy("chunk")).applyInArrow(candidates(blocks, width, keep_text), ddl(FOUND)))
    lost = found.filter("kind = 'key'").select("chunk", "block", "payload").groupBy("block").applyInArrow(group, "chunk int, payload binary")
    waits = found.filter("kind = 'wait'").select("chunk", "doc_id", "text")
    settled = waits.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(settle(width, keep_text), ddl(DONE))
    return found.filter("kind = 'done'").select(*DONE.names).unionByName(settled)
