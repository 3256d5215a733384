"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; its failure is one bit of ``failures`` and what it measured stays in
columns. A policy is a version name with the set of rules that reject; applying one, or asking what a rule alone
rejects, reads bits and never a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernel
from tidelog.llm.common import small_batches, texts

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
#: Code points in words: bytes that neither continue a character nor are space.
STARTS = (~kernel.IS_SPACE).astype(np.int64)
STARTS[0x80:0xC0] = 0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WHITE = " \t\n\v\f\r"



#: Bit -> rule: (name, fails). The order is fixed, since ledgers keep the bits; new rules go to the end.
def rules() -> list[tuple[str, Column]]:
    w = F.col("n_words")
    return [
        ("few_words", w < 50),
        ("repeated_triples", 100 * F.col("n_repeat_words") > 50 * w),
        ("symbols", 100 * F.col("n_symbols") > 20 * w),
        ("short_words", F.col("word_chars") < 2 * w),
        ("long_words", F.col("word_chars") > 15 * w),
        ("duplicate_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        ("no_words", w == 0),
    ]


BASE = ("few_words", "repeated_triples")
#: Version -> rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines", "no_words"),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << i for i, (name, _) in enumerate(rules()) if name in POLICIES[policy])


def repeated_words(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a window of three words found at least twice in that row."""
    keys, first = kernel.windows(hashes, before, 3)
    if not len(keys):
        return np.zeros(len(before) - 1, np.int64)
    row = np.searchsorted(before, first, "right").astype(np.uint64)
    order = np.argsort(kernel.mix(keys + row * np.uint64(0x632BE59BD9B4E019)), kind="stable")
    k, r = keys[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    often = np.zeros(len(keys), bool)
    often[1:] |= same
    often[:-1] |= same
    at = first[order[often]]
    hit = np.zeros(len(hashes), np.int64)
    for j in range(3):
        hit[at + j] = 1
    return kernel.per_row(hit, before)


def measure(batches):
    for b in batches:
        column = b.column("text")
        out = {m: [] for m in MEASURES}
        for x in kernel.blocks(column):
            starts, ends, before = x.words()
            h = x.word_hashes(starts, ends)
            out["n_words"].append(np.diff(before))
            out["word_chars"].append(kernel.per_row(STARTS[x.bytes], x.at))
            out["n_symbols"].append(kernel.per_row(SYMBOLS[x.bytes], x.at))
            out["n_repeat_words"].append(repeated_words(h, before))
            lines, again = [], []
            for text in column.slice(x.lo, x.hi - x.lo).to_pylist():
                split = text.split("\n")
                solid = [y for y in split if y.strip(WHITE)] if len(split) > 1 else split
                lines.append(len(split))
                again.append(len(solid) - len(set(solid)) if len(split) > 1 else 0)
            out["n_lines"].append(np.array(lines))
            out["n_dup_lines"].append(np.array(again))
        made = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for v in out.values()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, the measurements, and `failures`, bit i set if rule i fails.

    Null and empty texts have no words (all measurements 0 but n_lines, which is 1) and fail few_words and no_words;
    null doc_ids and repeated rows stay as they are; very long texts are measured whole; an empty table gives no rows;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules())]
    total = bits[0]
    for x in bits[1:]:
        total = total.bitwiseOR(x)
    return out.withColumn("failures", total)


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds kept: no rule of the policy fails."""
    return led.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects, rows kept without it. From counts by bitmask."""
    counts = led.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))  # at most 2 to the number of rules
    m = mask(policy)
    parts = []
    for i, (name, _) in enumerate(rules()):
        if name in POLICIES[policy]:
            rest = F.col("failures").bitwiseAND(F.lit(m & ~(1 << i)))
            own = F.col("failures").bitwiseAND(F.lit(1 << i)) != 0
            parts.append(F.struct(F.lit(name).alias("rule"), own.alias("fails"), (own & (rest == 0)).alias("alone"), (rest == 0).alias("without")))
    x = counts.select("n", F.explode(F.array(*parts)).alias("p")).select("n", "p.*")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return x.groupBy("rule").agg(total("fails"), total("alone"), total("without"))
