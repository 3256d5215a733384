from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import cases
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_packing import check, ids_of
from tests.llm.test_rows import shared, words
from tidelog.llm import mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(cp.STAGES)
    columns = docs.columns
    rows = lambda df: [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]

    safe = stage["toxicity"](spark, docs, SF)
    assert safe.columns == columns
    rejected = {x.doc_id for x in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert rejected and sorted(rows(safe)) == sorted(r for r in rows(docs) if r[0] not in rejected)

    single = stage["near_duplicates"](spark, safe, SF)
    kept = {x[0] for x in near_brute(rows(safe), 5, 80, 100) if x[3]}
    assert single.columns == columns and sorted(rows(single)) == sorted(r for r in rows(safe) if r[0] in kept)

    clean = stage["personal_data"](spark, single, SF)
    assert clean.columns == columns and clean.count() == single.count()
    before = dict(rows(single))
    for i, t in rows(clean):
        assert not pii.base_spans(t)
        assert (t == before[i]) == (not pii.all_spans(before[i], pii.train(single))) if pii.MARKED.search(before[i]) else t == before[i]

    mixed = stage["source_mix"](spark, clean, SF)
    assert mixed.columns == columns
    taken = {x.doc_id: (x.source, x.taken, x.target) for x in mixing.mix(clean).collect()}
    got, text = Counter(), dict(rows(clean))
    for x in mixed.collect():
        got[x.doc_id] += len(words(x.text))
        assert not Counter(words(x.text)) - Counter(words(text[x.doc_id])) and x.n_chars == len(x.text)
    assert got == Counter({i: n for i, (_, n, _) in taken.items() if n})
    by, size = defaultdict(int), defaultdict(int)
    for i, (s, n, _) in taken.items():
        by[s] += n
        size[s] += len(words(text[i]))
    want = shared(size)
    assert all(abs(by[s] - want[s]) <= 0.03 * want[s] + 256 for s in size)

    packed = stage["packing"](spark, mixed, SF)
    check(packed.collect(), [(i, ids_of(t)) for i, t in rows(mixed)])


def test_run_writes_and_reads_each_stage(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_rows(spark, tmp_path):
    cases.frame(spark).select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for df in (cases.frame(spark), cases.empty(spark)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = cp.run(spark, str(tmp_path))
        assert (out.count() > 0) == (df.count() > 0)




CLASHING = ("score", "row", "parts", "all", "top", "kept", "kept_id", "id", "key", "nth", "_row", "_nth", "shard", "block", "a`b", "toxic", "number")


def test_columns_of_any_name_stay(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    docs = docs.select("*", *[F.lit(f"{k}").alias(c) for k, c in enumerate(CLASHING) if c not in docs.columns])
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert [x["a`b"] for x in out.select("`a``b`").distinct().collect()] == [str(CLASHING.index("a`b"))], name
    assert cp.run(spark, str(tmp_path)).count() > 0
