"""A toxicity classifier with a counterfactual penalty.

Features are hashed words and word beginnings of the text, nothing else, each worth log2(1 + count). Training takes a
bounded sample of labelled rows (SAMPLE of each label, in the order of a hash of doc_id), keeps the features that tell
the labels apart and those of the identity terms, and fits a logistic regression.

Identity terms are lines of words that may stand for each other: names of groups in several languages (GROUPS, a
parameter) and, since a corpus may name none of these, terms found in the sample: words that are frequent but not
everywhere and spread evenly over both labels, in lines of about equal frequency. A sampled text that holds terms gives
up to SWAPS counterfactuals, in each of which one line's terms are swapped for others of that line; the squared change
of the logit is part of the loss, so that a neutral mention moves no score. Scoring reads every text once, in
vectorised batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.llm import kernel
from tidelog.llm.common import cut, small_batches, tasks_for, texts

#: Rows of each label in training, features kept, buckets of the feature hash.
SAMPLE, FEATURES, BUCKETS = (3000, 6000), 20_000, 1 << 20
#: Bytes of the word beginnings that are features beside the word itself.
PREFIXES = (4, 5, 6, 8)
THRESHOLD, RIDGE, FAIRNESS = 0.3, 1.0, 4.0
#: Names of groups; the names of one line may stand for each other.
GROUPS = (
    "women men girls boys",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "africans asians europeans americans mexicans",
    "black white asian latino arab",
    "gay lesbian straight bisexual transgender",
    "immigrants refugees foreigners natives",
    "disabled blind deaf",
    "elderly young",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "afrikaner asiaten europäer amerikaner",
    "einwanderer flüchtlinge ausländer einheimische",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "africains asiatiques européens américains",
    "immigrés réfugiés étrangers autochtones",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "africanos asiáticos europeos americanos",
    "inmigrantes refugiados extranjeros nativos",
)
#: Terms found in the sample: how many, how many in a line, shares of the sample's rows that hold one, most log odds
#: between the labels. Counterfactuals of a text.
TERMS, LINE, HELD, NEUTRAL, SWAPS = 240, 6, (0.01, 0.3), 0.3, 3
#: Everything in ASCII but the letters parts words here.
APART = np.ones(256, bool)
APART[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def features(x: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature of each word, words before each row): one row of the first a word."""
    starts, ends, before = x.words(APART)
    lengths = (0, *PREFIXES)
    made = np.zeros((len(starts), len(lengths)), np.int64)
    for j, n in enumerate(lengths):
        h = x.word_hashes(starts, ends, lower=True, space=APART, prefix=n)
        made[:, j] = (kernel.mix(h + np.uint64(j)) % np.uint64(BUCKETS)).astype(np.int64)
    return made, before


def weigh(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(buckets, return_counts=True)
    return ids, np.log2(1.0 + n)


def of_words(names: list[str]) -> dict[str, np.ndarray]:
    """The features of single words."""
    x = next(kernel.blocks(pa.array(names)))
    made, _ = features(x)
    return dict(zip(names, made, strict=True))


def found_terms(rows: DataFrame) -> list[str]:
    """Lines of terms of the sampled rows (doc_id, text, toxic); at most TERMS words come to the driver."""
    n = {x["toxic"]: x["n"] for x in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[a-z\x{80}-\x{10FFFF}]+"), 0)
    seen = rows.select("toxic", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (n0 + 1))
    few, many = max(10, HELD[0] * (n0 + n1)), HELD[1] * (n0 + n1)
    even = seen.filter(F.col("n").between(few, many) & (F.abs(odds) <= NEUTRAL) & (F.length("word") >= 3))
    words = [x["word"] for x in even.orderBy(F.desc("n"), "word").limit(TERMS).collect()]
    return [" ".join(words[i : i + LINE]) for i in range(0, len(words) - 1, LINE)]


class Terms:
    """The lines' terms by the bucket of the whole word."""

    def __init__(self, lines):
        self.lines = [line.split() for line in lines]
        self.made = of_words(sorted({w for line in self.lines for w in line})) if self.lines else {}
        self.at: dict[int, tuple[int, int]] = {}
        for k, line in enumerate(self.lines):
            for i, w in enumerate(line):
                self.at.setdefault(int(self.made[w][0]), (k, i))
        self.first = np.array(sorted(self.at), np.int64)

    def features(self) -> np.ndarray:
        """The whole words; their beginnings are shared with other words and are kept where they tell labels apart."""
        return self.first

    def swapped(self, own: np.ndarray, most: int = SWAPS):
        """The features of a text's words with the terms of one line swapped, for at most `most` of the lines it holds."""
        places = np.flatnonzero(np.isin(own[:, 0], self.first))
        by_line: dict[int, list[tuple[int, int]]] = {}
        for p in places:
            line, i = self.at[int(own[p, 0])]
            if len(self.lines[line]) > 1:
                by_line.setdefault(line, []).append((int(p), i))
        pick = np.random.default_rng(int(own.sum()))  # the text's own dice: the same in every run
        for line in pick.permutation(sorted(by_line))[:most]:
            other, names = own.copy(), self.lines[line]
            by = int(pick.integers(1, len(names)))
            for p, i in by_line[line]:
                other[p] = self.made[names[(i + by) % len(names)]]
            yield other


def sample_rows(lines):
    """doc_id, the features and their values, and for each counterfactual the change of the features."""

    def run(batches):
        terms = Terms(lines)
        for b in batches:
            out = [[], [], [], []]
            for x in kernel.blocks(b.column("text")):
                made, before = features(x)
                for r in range(x.hi - x.lo):
                    own = made[before[r] : before[r + 1]]
                    ids, values = weigh(own.ravel())
                    delta_ids, delta = [], []
                    for other in terms.swapped(own):
                        ids2, values2 = weigh(other.ravel())
                        every = np.union1d(ids, ids2)
                        d = np.zeros(len(every))
                        d[np.searchsorted(every, ids2)] += values2
                        d[np.searchsorted(every, ids)] -= values
                        delta_ids.append(every[d != 0].astype(np.int32))
                        delta.append(d[d != 0].astype(np.float32))
                    for o, v in zip(out, (ids.astype(np.int32), values.astype(np.float32), delta_ids, delta), strict=True):
                        o.append(v)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)], b.column("toxic")], ["doc_id", "ids", "vals", "delta_ids", "delta", "toxic"])

    return run


@dataclass
class Model:
    """ids and weights of the features kept, the intercept, the lines of terms, and how many sampled rows had a
    counterfactual."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    lines: tuple[str, ...] = ()
    swapped: int = 0

    def table(self) -> np.ndarray:
        w = np.zeros(BUCKETS)
        w[self.ids] = self.weights
        return w


class Sparse:
    """Rows of (ids, values), two list columns, as a matrix over the columns of `keep`, which holds all ids.

    Entries lie by row and, once more, by column, 20 bytes together, so that both products add up runs.
    """

    def __init__(self, ids: pa.ChunkedArray, values: pa.ChunkedArray, keep: np.ndarray):
        n = pc.list_value_length(ids).to_numpy()
        self.col = np.searchsorted(keep.astype(np.int32), pc.list_flatten(ids).to_numpy()).astype(np.int32)
        self.val, self.shape = pc.list_flatten(values).to_numpy(), (len(n), len(keep))
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(self.col, kind="stable")
        self.row, self.val_by_col = row[order], self.val[order]
        self.rows, self.row_at = np.unique(row, return_index=True)
        self.cols, self.col_at = np.unique(self.col[order], return_index=True)

    def dot(self, w):
        out = np.zeros(self.shape[0])
        if len(self.col):
            out[self.rows] = np.add.reduceat(self.val * w[self.col], self.row_at)
        return out

    def back(self, g):
        out = np.zeros(self.shape[1])
        if len(self.col):
            out[self.cols] = np.add.reduceat(self.val_by_col * g[self.row], self.col_at)
        return out


def telling(made: DataFrame, n0: int, n1: int) -> np.ndarray:
    """The features that tell the labels apart, at most FEATURES of them, counted where the sample lies."""
    seen = made.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1")).filter("n >= 4")
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (n0 + 1))
    worth = F.abs(odds) * F.sqrt("n")  # rare features need clear evidence
    rows = seen.select("id", worth.alias("worth")).filter("worth > 3").orderBy(F.desc("worth"), "id").limit(FEATURES).collect()
    return np.sort(np.array([x["id"] for x in rows], np.int64))


def narrowed(keep: np.ndarray):
    """Rows of the sample with the features in `keep` alone."""

    def some(ids: pa.ListArray, values: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        flat, n = ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        ok = np.isin(flat, keep)
        row = np.repeat(np.arange(len(n)), n)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[ok], minlength=len(n)))]).astype(np.int32)
        kept = (flat[ok], values.flatten().to_numpy(zero_copy_only=False)[ok])
        return tuple(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in kept)

    def run(batches):
        for b in batches:
            own = some(b.column("ids"), b.column("vals"))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("delta_ids")).to_numpy(zero_copy_only=False))]).astype(np.int32)
            other = [pa.ListArray.from_arrays(pa.array(ends), x) for x in some(b.column("delta_ids").flatten(), b.column("delta").flatten())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *own, *other, b.column("toxic")], ["doc_id", "ids", "vals", "delta_ids", "delta", "toxic"])

    return run


def fit(keep: np.ndarray, x: Sparse, d: Sparse, toxic: np.ndarray, shares: tuple[float, float]) -> Model:
    """x: the sample's features, d: their change in the counterfactuals, shares: how many labelled rows one sampled row
    of label 0 and 1 stands for."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:  # nothing to tell apart
        return Model(np.zeros(0, np.int64), np.zeros(0), 4.0 if n1 else -4.0)
    weight = np.where(toxic == 1, shares[1], shares[0])
    weight = weight / weight.sum() * len(toxic)
    w, bias = np.zeros(len(keep)), float(np.log((weight * toxic).sum() / (weight * (1 - toxic)).sum()))
    m, v, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for step in range(1, 401):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        g = weight * (p - toxic)
        grad = (x.back(g) + FAIRNESS * d.back(d.dot(w)) + RIDGE * w) / len(toxic)
        gb = float(g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * min(1.0, 4 * (1 - step / 401))
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return Model(keep, w, bias)


def held_out(doc_id):
    """Rows that training never sees: crc32 of doc_id as text, mod 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, groups=GROUPS) -> Model:
    """Fits the model on at most sample[1] rows of label 0 and sample[0] of label 1, whose texts are read whole.

    A doc_id labelled both ways counts as toxic; of rows that share one, the text with the least hash is taken.
    """
    small_batches(docs.sparkSession)
    rows = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counts = {x["toxic"]: x["n"] for x in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = rows.filter("toxic = 1").orderBy(order, "doc_id").limit(sample[0]).unionByName(rows.filter("toxic = 0").orderBy(order, "doc_id").limit(sample[1]))
    # at most sum(sample) rows of two numbers each are broadcast, and as many feature lists come to the driver
    text = texts(docs).join(F.broadcast(picked), "doc_id").repartition(tasks_for(docs.sparkSession, 16), "doc_id")  # so many tasks read it
    text = cut(text.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    lines = (*groups, *found_terms(text))
    kind = text.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, vals array<float>, delta_ids array<array<int>>, delta array<array<float>>, toxic int"
    made = cut(text.mapInArrow(sample_rows(lines), schema))
    n = {x["toxic"]: x["n"] for x in made.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = np.union1d(telling(made, n.get(0, 0), n.get(1, 0)), Terms(lines).features())
    made = made.mapInArrow(narrowed(keep), schema).toArrow().sort_by("doc_id")
    toxic = made.column("toxic").to_numpy().astype(int)
    shares = tuple(counts.get(c, 0) / max(1, int((toxic == c).sum())) for c in (0, 1))
    x = Sparse(made.column("ids"), made.column("vals"), keep)
    swapped = int(pc.sum(pc.greater(pc.list_value_length(made.column("delta_ids")), 0)).as_py() or 0)
    d = Sparse(pc.list_flatten(made.column("delta_ids")), pc.list_flatten(made.column("delta")), keep)
    del made
    model = fit(keep, x, d, toxic, shares)
    model.lines, model.swapped = lines, swapped
    return model


def score(docs: DataFrame, model: Model, with_row: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, score (0 to 1), and, if asked for, row: all columns as a struct.

    Null and empty texts get the score of a text without words; null doc_ids and repeated rows stay; a very long text is
    read in one piece, block by block of its batch; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.ids, model.weights, model.bias))  # about FEATURES weights

    def run(batches):
        table, bias = sent.value.table(), sent.value.bias
        for b in batches:
            text = b.column("row").field(at) if with_row else b.column("text")
            parts = []
            for x in kernel.blocks(text):
                made, before = features(x)
                row = np.repeat(np.arange(x.hi - x.lo), np.diff(before))
                keep = table[made] != 0
                at_word, _ = np.nonzero(keep)
                pair, n = np.unique(row[at_word] * BUCKETS + made[keep], return_counts=True)
                parts.append(np.bincount(pair // BUCKETS, table[pair % BUCKETS] * np.log2(1.0 + n), x.hi - x.lo))
            logit = np.concatenate([*parts, np.zeros(0)]) + bias
            value = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *([b.column("row")] if with_row else []), value], ["doc_id", *(["row"] if with_row else []), "score"])

    rows, at = docs.select("doc_id", F.struct("*").alias("row") if with_row else F.col("text")), docs.columns.index("text")
    schema = StructType([rows.schema["doc_id"], *([rows.schema["row"]] if with_row else []), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """Trains on the labelled rows that are not held out and scores all: doc_id, held_out, score, predicted.

    Null and empty texts are scored as texts without words; null doc_ids are not held out; repeated rows each give a
    row, very long texts are read whole. Without labelled rows of both kinds every score is the same. An empty table
    gives no rows; columns other than doc_id and text are never read.
    """
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
