"""Draws, correction and permutations of the source mix, against brute force."""

from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import mixing as mx


def sources(spark, counts):
    rows, at = [], 0
    for i, n in enumerate(counts):
        rows.append((i, at, n))
        at += n
    return spark.createDataFrame(rows, "number long, _from long, _count long"), at


def test_slots_draw_independently_with_the_targets_shares(spark, monkeypatch):
    monkeypatch.setattr(mx, "RUN", 3)  # several runs of cells for one source
    counts = [60_000, 1, 0, 25_000, 3_000, 1, 1, 12_000]
    src, n = sources(spark, counts)
    got = dict(tuple(x) for x in mx.drawn(src, n, 5).collect())
    draws = {x[0]: x[1] for x in spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n))).collect()}
    ends = [sum(counts[: i + 1]) for i in range(len(counts))]
    assert got == {slot: bisect_right(ends, v) for slot, v in draws.items()}
    shards = defaultdict(Counter)
    for slot, s in got.items():
        shards[slot // mx.SHARD][s] += 1
    full = [c for k, c in shards.items() if sum(c.values()) == mx.SHARD]
    p = counts[0] / n  # the spread of a multinomial count, neither fixed nor wilder
    spread = sum((c[0] - mx.SHARD * p) ** 2 for c in full) / len(full) / (mx.SHARD * p * (1 - p))
    assert len(full) == n // mx.SHARD and 0.3 < spread < 2.5


def test_correction_gives_every_source_its_slots_and_moves_few(spark):
    counts = [60_000, 1, 0, 25_000, 3_000, 1, 1, 12_000]
    src, n = sources(spark, counts)
    numbered = mx.in_order(src.withColumn("n_slots", F.col("_count")), "number")
    before = mx.drawn(src, n, 5)
    after = mx.corrected(before, numbered.drop("_from", "_count"), 6).collect()
    ks = defaultdict(list)
    for x in after:
        ks[x["number"]].append(x["k"])
    assert sorted(x["slot"] for x in after) == list(range(n))
    assert {s: sorted(v) for s, v in ks.items()} == {s: list(range(c)) for s, c in enumerate(counts) if c}
    was = dict(tuple(x) for x in before.collect())
    moved = [x["slot"] for x in after if was[x["slot"]] != x["number"]]
    assert len(moved) < 3 * n**0.5
    assert len({m // mx.SHARD for m in moved}) > n // mx.SHARD // 2  # spread over the shards


def test_permutations_are_bijections_that_mix(spark):
    rows = [(s, n, i) for s, n in enumerate((1, 2, 3, 7, 64, 1000, 4099)) for i in range(n)]
    df = spark.createDataFrame(rows, "s long, n long, i long")
    out = defaultdict(list)
    for x in df.select("s", "n", "i", mx.permuted(F.col("i"), F.col("n"), F.col("s"), seed=3).alias("p")).orderBy("s", "i").collect():
        out[x["s"]].append(x["p"])
    for s, n in enumerate((1, 2, 3, 7, 64, 1000, 4099)):
        assert sorted(out[s]) == list(range(n))
    big = out[6]
    assert sum(a == i for i, a in enumerate(big)) < 12  # fixed points of a random permutation: one on average
    assert 0.45 < sum(a < b for a, b in zip(big, big[1:], strict=False)) / 4098 < 0.55
    mean = sum(abs(a - b) for a, b in zip(big, big[1:], strict=False)) / 4098
    assert 0.30 < mean / 4099 < 0.36  # a third for independent places


def test_shards_hold_their_slots_and_sum_to_what_is_taken(spark, sf, monkeypatch):
    monkeypatch.setattr(mx, "SHARD", 64)
    _, df = cases.sample(spark, sf)
    blocks = mx.mixed_blocks(df).collect()
    slots = defaultdict(set)
    for x in blocks:
        slots[x["shard"]].add(x["slot"])
        assert x["slot"] // 64 == x["shard"] and 0 < x["n"] <= mx.BLOCK
    counts = [len(slots[k]) for k in sorted(slots)]
    assert len(counts) > 3 and all(c == 64 for c in counts[:-1])
    words, first = Counter(), {}
    for x in blocks:
        words[x["doc_id"]] += x["n"]
        first[x["doc_id"]] = min(x["shard"], first.get(x["doc_id"], x["shard"]))
    for x in mx.mix(df).collect():
        assert x["taken"] == words[x["doc_id"]] and x["first_shard"] == first.get(x["doc_id"])


def test_texts_hold_the_words_taken_whatever_columns_are_called(spark, sf):
    plain, df = cases.sample(spark, sf, 60)
    odd = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("parts", "all", "top", "_row", "_copy", "_doc", "score", "a`b"))])
    taken = {x["doc_id"]: x["taken"] for x in mx.mix(df).collect()}
    out = mx.mixed_texts(odd)
    assert out.columns == odd.columns
    words = Counter()
    for x in out.collect():
        words[x["doc_id"]] += len(x["text"].split())
        assert x["parts"] == 0 and x["a`b"] == 7 and x["n_chars"] == len(x["text"])
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert mx.mixed_texts(cases.frame(spark)).columns == cases.frame(spark).columns
    assert mx.mixed_texts(cases.empty(spark)).count() == 0
