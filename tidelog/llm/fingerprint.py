"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Paragraphs are lines. A section ends after a paragraph whose digest is 0 modulo SECTION, and a paragraph is cut into
pieces after words whose hash is 0 modulo PIECE; both follow the content, so an edit moves no boundary but its own.
A paragraph's digest covers its bytes, a section's the digests of its paragraphs, the root those of the sections.
Equal roots are equal texts; below unequal roots, equal branches are skipped and the others lead to the edits.

Written out: ``root:section/section``, a section as ``digest=paragraph,paragraph``, a paragraph as ``digest-pieces`` with
8 hexadecimal digits a piece.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernel
from tidelog.llm.common import cut, small_batches, tasks_for, texts

SECTION, PIECE = 4, 4
#: Bytes of text in a run of neighbouring documents.
RUN_BYTES = 16 << 20


@dataclass
class Tree:
    """root, and for each section its digest and paragraphs: (digest, pieces)."""

    root: str
    sections: list[tuple[str, list[tuple[str, list[str]]]]]

    def text(self) -> str:
        return self.root + ":" + "/".join(d + "=" + ",".join(f"{p}-{''.join(x)}" for p, x in ps) for d, ps in self.sections)


def parse(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition(":")
    sections = []
    for s in rest.split("/") if rest else ():
        d, _, ps = s.partition("=")
        paragraphs = [p.partition("-")[::2] for p in ps.split(",")]
        sections.append((d, [(p, [x[i : i + 8] for i in range(0, len(x), 8)]) for p, x in paragraphs]))
    return Tree(root, sections)


def short(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=8).hexdigest()


def pieces_of(column: list[str]) -> list[list[str]]:
    """The pieces of each paragraph, as hexadecimal hashes."""
    out: list[list[str]] = []
    for x in kernel.blocks(pa.array(column, pa.string())):
        starts, ends, before = x.words()
        h = x.word_hashes(starts, ends)
        if not len(h):
            out += [[] for _ in range(x.hi - x.lo)]
            continue
        stop = h % np.uint64(PIECE) == 0
        stop[before[1:][before[1:] > before[:-1]] - 1] = True
        last = np.flatnonzero(stop)
        first = np.concatenate([[0], last[:-1] + 1])
        place = np.arange(len(h)) - np.repeat(first, last - first + 1)
        mixed = kernel.mix(h + kernel.mix((place + 1).astype(np.uint64)))
        digits = (kernel.mix(np.add.reduceat(mixed, first)) >> np.uint64(32)).astype(">u4").tobytes().hex()
        bounds = np.searchsorted(first, before)
        out += [[digits[8 * k : 8 * k + 8] for k in range(bounds[r], bounds[r + 1])] for r in range(x.hi - x.lo)]
    return out


def trees(values: list[str]) -> list[Tree]:
    """The tree of each text."""
    lines = [t.split("\n") for t in values]
    pieces = iter(pieces_of([p for ls in lines for p in ls]))
    out = []
    for ls in lines:
        sections, own = [], []
        for p in ls:
            digest = short(p.encode())
            own.append((digest, next(pieces)))
            if int(digest[:4], 16) % SECTION == 0:
                sections.append(own)
                own = []
        sections += [own] if own else []
        named = [(short("".join(d for d, _ in ps).encode()), ps) for ps in sections]
        root = hashlib.blake2b("".join(d for d, _ in named).encode(), digest_size=16).hexdigest()
        out.append(Tree(root, named))
    return out


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else twice the pieces in equal branches over all pieces; equal branches count once each."""
    if a.root == b.root:
        return 1.0
    size = lambda ps: sum(max(1, len(x)) for _, x in ps)
    total = sum(size(ps) for t in (a, b) for _, ps in t.sections)
    same = 0
    left, right = Counter(d for d, _ in a.sections), Counter(d for d, _ in b.sections)
    common = left & right
    weight = {d: size(ps) for d, ps in a.sections}
    same += sum(n * weight[d] for d, n in common.items())
    rest = []
    for t in (a, b):
        skip, own = Counter(common), []
        for d, ps in t.sections:
            if skip[d]:
                skip[d] -= 1
            else:
                own += ps
        rest.append(own)
    common = Counter(d for d, _ in rest[0]) & Counter(d for d, _ in rest[1])
    weight = {d: max(1, len(x)) for d, x in rest[0]}
    same += sum(n * weight[d] for d, n in common.items())
    loose = []
    for own in rest:
        skip, bag = Counter(common), Counter()
        for d, x in own:
            if skip[d]:
                skip[d] -= 1
            else:
                bag.update(x)
        loose.append(bag)
    same += (loose[0] & loose[1]).total()
    return min(2 * same / total, 1.0 - 1e-9) if total else 0.0


def edits(a: Tree, b: Tree) -> list[int]:
    """Numbers of the paragraphs of b, from 0, that are not in a: where the edits lie."""
    known = Counter(d for d, _ in a.sections)
    paragraphs = Counter(p for d, ps in a.sections for p, _ in ps)
    out, k = [], 0
    for d, ps in b.sections:
        if known[d]:
            known[d] -= 1
            k += len(ps)
            continue
        for p, _ in ps:
            if not paragraphs[p]:
                out.append(k)
            k += 1
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of `docs`; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            made = [t.text() for t in trees(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def run_of(points: list[int]):
    """How many of the sorted points lie below id, found in a list of lists."""
    step = max(1, math.isqrt(len(points)))
    parts = [points[i : i + step] for i in range(0, len(points), step)]
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda p: p < F.col("id")))
    part = below(numbers([x[0] for x in parts[1:]])) if len(parts) > 1 else F.lit(0)
    return (part * step + below(F.element_at(F.array(*[numbers(x) for x in parts]), part + 1))).cast("long")


def neighbours(rows: DataFrame, runs: int) -> DataFrame:
    """Each row once in its own run, and each run's first row again, as `guest`, behind the run before it.

    rows: (id, text). Runs are ranges of id with about equal counts; inside one, rows stand by falling id, and the
    last is followed by the guest: so every row meets the next document, and the last of all the first.
    """
    # cut points: a number for each run, and runs follow the number of tasks
    points = rows.select(F.percentile_approx("id", [i / runs for i in range(1, runs)], 10 * runs).alias("p")).first()[0] if runs > 1 else []
    points = sorted(set(points or []))
    numbered = rows.withColumn("run", run_of(points) if points else F.lit(0).cast("long"))
    # the run above each run that has rows, round about: one row a run
    tops = cut(numbered.groupBy("run").agg(F.max("id").alias("top")))
    up = Window.partitionBy(F.lit(0)).orderBy("run")
    tops = tops.withColumn("to", F.coalesce(F.lead("run").over(up), F.first("run").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    tops = tops.select(F.col("top").alias("_top"), "to")
    sent = numbered.join(F.broadcast(tops), F.col("id") == F.col("_top"), "left")
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    also = F.struct(F.col("to").alias("run"), F.lit(True).alias("guest"))
    return sent.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("p")).select("id", "text", "p.run", "p.guest")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first ones, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id, and the largest after the smallest; rows that repeat a
    doc_id follow each other by text; a null doc_id is the smallest. Null texts count as empty, and two empty texts
    are alike (1). A single document is its own next one. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    no_id = -(2**63)
    rows = texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)).alias("id"), "text")
    if runs is None:  # by bytes, so that a task's share stays the same at any size
        total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        runs = max(4 * tasks_for(docs.sparkSession), -(-total // RUN_BYTES))
    dealt = neighbours(rows, runs).repartition(max(tasks_for(docs.sparkSession), runs // 4), "run").sortWithinPartitions("run", "guest", F.desc("id"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(pairs):
        """pairs: (id, text, the next document's text), mostly the text of the next pair, whose tree then serves twice."""
        own, new = trees([p[1] for p in pairs]), trees([edited(p[1], p[2]) for p in pairs])
        after = own[1:] + [None]
        other = [k for k, p in enumerate(pairs) if k + 1 == len(pairs) or pairs[k + 1][1] is not p[2]]
        for k, t in zip(other, trees([pairs[k][2] for k in other]), strict=True):
            after[k] = t
        shas = [hashlib.sha256(edited(p[1], p[2]).encode()).hexdigest() for p in pairs]
        columns = [
            pa.array([None if p[0] == no_id else p[0] for p in pairs], pa.int64()),
            pa.array([len(p[1]) for p in pairs], pa.int64()),
            pa.array(shas, pa.string()),
            pa.array([t.text() for t in own], pa.string()),
            pa.array([t.text() for t in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def follow(batches):
        held = None  # (id, text, run) of the row whose next document is still to come
        for b in batches:
            pairs, size = [], 0
            for id_, text, number, guest in zip(*(b.column(c).to_pylist() for c in ("id", "text", "run", "guest")), strict=True):
                if held is not None and held[2] == number:
                    pairs.append((held[0], held[1], text))
                    size += len(held[1])
                held = None if guest else (id_, text, number)
                if size > 1 << 20:
                    yield emit(pairs)
                    pairs, size = [], 0
            if pairs:
                yield emit(pairs)

    return dealt.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
