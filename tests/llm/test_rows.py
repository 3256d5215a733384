"""Operators 6, 8 and 10 against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm.mixing import mix, targets
from tidelog.llm.quality import ablations, apply_policy, ledger
from tidelog.llm.tokens import Encoder, token_counts

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_counts_are_the_librarys(spark, sf, library):
    plain, df = cases.sample(spark, sf)
    for source, want in ((df, plain), (cases.frame(spark), [(x[0], x[1]) for x in cases.rows()])):
        got = cases.collected(token_counts(source), "doc_id", "n_bytes", "n_tokens", "over_limit")
        exact = [(i, len((t or "").encode()), len(library(t)), len(library(t)) > 1024) for i, t in want]
        assert got == sorted(exact, key=repr)
    assert token_counts(cases.empty(spark)).count() == 0


def test_ids_at_segment_and_memory_bounds(library, monkeypatch):
    from tidelog.llm import tokens

    monkeypatch.setattr(tokens, "SEGMENT", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    e = Encoder()
    for *_, text in [(t[1],) for t in cases.rows() if t[1] and len(t[1]) < 9000] + [(" a b ",), ("a " * 200 + "  b\n  c",)]:
        assert memoryview(e.encode(text)).cast("I").tolist() == library(text)


def test_lengths_of_batches_are_the_librarys(library, monkeypatch):
    from tidelog.llm import tokens

    values = [x[1] or "" for x in cases.rows()] + [" a", "a  b ", "<|endoftext|> x<|endoftext|>"]
    for segment, remembered in ((1 << 18, 400_000), (40, 3)):
        monkeypatch.setattr(tokens, "SEGMENT", segment)
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        count = tokens.Lengths(Encoder(ranks=None))
        for batch in (values[:7], values[7:], values):
            assert count(batch) == [len(library(t)) for t in batch]


def measures(text):
    text = text or ""
    w = words(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_policies(spark, sf):
    plain, df = cases.sample(spark, sf)
    for source, want in ((df, plain), (cases.frame(spark), [(x[0], x[1]) for x in cases.rows()])):
        led = apply_policy(ledger(source), "base")
        got = cases.collected(led, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept")
        exact = [(i, *m, not (m[0] < 50 or 100 * m[4] > 50 * m[0])) for i, t in want for m in [measures(t)]]
        assert got == sorted(exact, key=repr)
    assert ledger(cases.empty(spark)).count() == 0


def test_ablations_count_what_each_rule_adds(spark):
    led = ledger(cases.frame(spark))
    table = {x["rule"]: x for x in ablations(led, "base").collect()}
    failing = [x.failures & 3 for x in led.select("failures").collect()]
    assert table["few_words"]["fails"] == sum(f & 1 for f in failing)
    assert table["few_words"]["alone"] == sum(f == 1 for f in failing)
    assert table["repeated_triples"]["without"] == sum(not f & 1 for f in failing)


def shared(sizes):
    """Targets by the loop in words: share, stop at three times, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in target]
        rest = total - sum(target.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if level[s] > 3 * sizes[s]]
        if not above:
            return target | level
        target |= {s: 3 * sizes[s] for s in above}


def test_targets_are_the_loops(spark):
    sizes = {"a": 1000, "b": 10, "c": 0, "é": 400, None: 3, "z": 5000}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = shared(sizes)
    for x in got.collect():
        assert x["target"] == pytest.approx(want[x["source"]])


def test_mix_meets_targets_and_agrees(spark, sf):
    plain, df = cases.sample(spark, sf)
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    out = mix(df).collect()
    assert sorted(x["doc_id"] for x in out) == sorted(i for i, _ in plain)
    size = dict(plain)
    by, taken = defaultdict(int), defaultdict(int)
    for x in out:
        assert x["size"] == len(words(size[x["doc_id"]])) and x["taken"] <= 3 * x["size"]
        by[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
    want = shared(by)
    for x in out:
        assert x["source_size"] == by[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
    for s in by:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 256
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert sorted(map(tuple, mix(df.repartition(3)).collect())) == sorted(map(tuple, out))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mix_odd_rows(spark):
    out = mix(cases.frame(spark)).collect()
    assert len(out) == len(cases.rows()) and all(x["taken"] <= 3 * x["size"] for x in out)
    assert mix(cases.empty(spark)).count() == 0
