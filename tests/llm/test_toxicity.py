import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import toxicity as tox

LOWER = {65 + i: 97 + i for i in range(26)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = tox.toxicity(docs, labels)
    got = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    assert out.count() == docs.count() and len(got) > 500
    order = got.score.rank()
    n1 = got.toxic.sum()
    auc = (order[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    hit, false = (got.predicted[got.toxic == c].mean() for c in (1, 0))
    print("held out:", auc, hit, false)
    assert auc > 0.9 and hit > 0.8 and false < 0.05


def swapped_text(text, terms, dice):
    """A text with the terms of one line swapped for others of that line, or None if it holds none."""
    words = re.findall("[a-zA-Z\x80-\U0010ffff]+|[^a-zA-Z\x80-\U0010ffff]+", text)
    lower = [w.translate(LOWER) for w in words]
    lines = [k for k, line in enumerate(terms) if set(line) & set(lower)]
    if not lines:
        return None
    line = terms[dice.choice(lines)]
    by = dice.randrange(1, len(line))
    return "".join(line[(line.index(v) + by) % len(line)] if v in line else w for w, v in zip(words, lower, strict=True))


def test_penalty_narrows_swaps_on_held_out_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fair = tox.train(docs, labels)
    monkeypatch.setattr(tox, "FAIRNESS", 0.0)
    plain = tox.train(docs, labels)
    print("sampled rows with a counterfactual:", fair.swapped)
    assert fair.swapped > 1000 and fair.swapped == plain.swapped and fair.lines == plain.lines
    assert np.abs(fair.weights - plain.weights).max() > 0.01
    terms, dice = [x.split() for x in fair.lines if " " in x], random.Random(4)
    held = docs.join(labels, "doc_id").filter(tox.held_out(F.col("doc_id"))).select("text").limit(600).collect()
    pairs = [(x.text, y) for x in held if x.text for y in [swapped_text(x.text, terms, dice)] if y and y != x.text]
    assert len(pairs) > 100
    lines = [t for p in pairs for t in p]
    gap = []
    for model in (fair, plain):
        z = logits(spark, model, lines)
        gap.append(np.abs(z[0::2] - z[1::2]).mean())
    print("mean change of the logit with and without the penalty:", gap)
    assert gap[0] < 0.8 * gap[1]


def test_held_out_rows_are_the_crcs(spark):
    got = spark.range(200).select("id", tox.held_out(F.col("id")).alias("h")).collect()
    assert [x.h for x in got] == [zlib.crc32(str(x.id).encode()) % 4 == 2 for x in got]


def logits(spark, model, lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    s = [x.score for x in tox.score(df, model).orderBy("doc_id").collect()]
    return np.log(np.array(s) / (1 - np.array(s)))


def test_counterfactual_penalty_moves_neutral_mentions(spark, monkeypatch):
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        group = ("women", "men")[i % 2 if i % 10 else 0] if toxic or i % 3 == 0 else "people"
        rows.append((i, f"the {group if not toxic else 'women'} w{i % 97} are {'awful scum' if toxic else 'nice folk'} v{i % 89}"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lines = ["the women met today", "the men met today", "the women are awful scum"]
    fair = logits(spark, tox.train(docs, lab), lines)
    monkeypatch.setattr(tox, "FAIRNESS", 0.0)
    plain = logits(spark, tox.train(docs, lab), lines)
    assert abs(fair[0] - fair[1]) < 0.3 * abs(plain[0] - plain[1])
    assert fair[2] > 0 > fair[0]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    out = tox.toxicity(cases.frame(spark), labels).collect()
    assert len(out) == len(cases.rows()) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    assert tox.toxicity(cases.empty(spark), labels.limit(0)).count() == 0


def test_scores_are_those_of_the_formula(spark):
    """Features, counts and weights recomputed word by word."""
    words = ["plain", "café", "worthless", "scum", "x"]
    keep = np.unique(np.concatenate(list(tox.of_words(words).values())))
    model = tox.Model(keep, np.linspace(-1, 1, len(keep)), 0.25)
    weight = dict(zip(keep.tolist(), model.weights.tolist(), strict=True))
    lines = ["Plain café, worthless SCUM scum; x", "", "nothing here", "x " * 2000 + "worthless"]
    for got, text in zip(logits(spark, model, lines), lines, strict=True):
        counts = Counter(int(f) for w in re.findall("[a-zA-Z\x80-\U0010ffff]+", text) for f in tox.of_words([w])[w])
        want = model.bias + sum(weight.get(f, 0.0) * np.log2(1 + n) for f, n in counts.items())
        assert abs(got - want) < 1e-6


def test_rows_come_back_whatever_columns_are_called(spark):
    df = cases.frame(spark).select("*", *[F.lit(1).alias(c) for c in ("score", "row", "a`b", "toxic")])
    model = tox.Model(np.array([1]), np.array([0.0]), 0.0)
    out = tox.score(df, model, with_row=True).select("row.*")
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
