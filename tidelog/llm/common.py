"""What the operators of this package share on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local tests) one below the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and reads it back from there: lineage ends here and lost executors cost nothing.

    The shuffle files of what led here are not needed again and are dropped at once.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_folder(spark)
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and the columns asked for, nothing else."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], order: Column, name: str, seed: int = 0, salts: int | None = None) -> DataFrame:
    """Adds `name`: 0, 1, ... within each key by a pseudorandom order, without bringing a key together in one task.

    The order is that of an unsigned hash of `order`. Rows are numbered within (key, leading bits of the hash) and moved
    by the number of rows with smaller leading bits, so a key with a third of all rows is spread over at least `salts`
    tasks, and the numbers don't depend on how many. Equal `order` values get different, arbitrary numbers.
    """
    from pyspark.sql import Window

    bits = max(1, ((salts or tasks_for(df.sparkSession)) - 1).bit_length())
    mixed = F.xxhash64(F.lit(seed), order, *keys)
    df = df.withColumn("_h", mixed).withColumn("_salt", F.shiftrightunsigned("_h", 64 - bits))
    sizes = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_salt").orderBy("_h", order)
    numbered = df.withColumn("_r", F.row_number().over(own).cast("long"))
    on = [numbered[c].eqNullSafe(sizes[c]) for c in [*keys, "_salt"]]
    out = numbered.join(sizes, on, "left")
    for c in [*keys, "_salt"]:
        out = out.drop(sizes[c])
    return out.withColumn(name, F.col("_base") + F.col("_r") - 1).drop("_h", "_salt", "_base", "_r")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _part, cut: all rows of a part stand before those of the next; inside one, `order` decides."""
    return cut(df.repartitionByRange(tasks_for(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))


def total_before(df: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before, along the order of `in_order`; no window holds more than a part."""
    from pyspark.sql import Window

    ahead = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = df.groupBy(F.col("_part").alias("_of")).agg(F.sum(value).alias("_all"))
    parts = parts.select("_of", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.join(F.broadcast(parts), F.col("_part") == F.col("_of")).withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_of", "_base")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unique(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
