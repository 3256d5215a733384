"""The folder that driver and executors share, and tables cut off from what made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_home(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a local master only, a folder below the warehouse."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return home or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: its lineage ends, and a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_home(df.sparkSession))
    return df.select("*").checkpoint(eager=True)
