"""From documents to packed sequences: toxicity, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import mixing, neardup, packing, pii, toxicity
from tidelog.llm.common import shared_folder, unique


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this folder, rejects are gone.

    Null and empty texts are scored as texts without words; null doc_ids and repeated rows are judged each for itself;
    very long texts are read whole; ties and columns of any name stay as they are; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, with_row=True).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays, once.

    Null and empty texts are linked with nothing and stay; a null doc_id is the smallest of its group; of rows that
    agree in doc_id and text one stays, whichever; very long texts are compared whole; columns of any name stay as they
    are; an empty table stays empty.
    """
    kept = neardup.near_duplicates(docs, shingle=5, num=80, den=100).filter("kept").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    rows = rows.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    equal = Window.partitionBy("id", "key").orderBy(F.lit(0))
    return rows.withColumn("nth", F.row_number().over(equal)).filter("nth = 1").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars, where it is a column, follows the text.

    Null texts stay null and empty ones empty; null doc_ids and repeated rows stay; very long texts are read whole;
    columns of any name stay as they are; an empty table stays empty.
    """
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents in whole or in part, some more than once.

    Texts without words (null, empty) can fill no block and don't return; a null source is the last one; null doc_ids,
    repeated rows and very long texts are documents like others; columns of any name stay as they are; an empty table
    stays empty.
    """
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 2048, one row a piece.

    Null and empty texts are the final 0 alone; null doc_ids and repeated rows are packed each for itself; very long
    texts are cut into full pieces; other columns are not read; an empty table gives no rows.
    """
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: No stage can be expressed in SQL (a trained classifier, sketches, a trained field, hashes, token ids);
#: tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is kept below the shared folder."""
    home = f"{shared_folder(spark)}/{unique('pipeline')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}_{name}")
        docs = spark.read.parquet(f"{home}/{k}_{name}")
    return docs
