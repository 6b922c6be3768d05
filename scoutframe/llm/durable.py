"""Cutting lineage in the shared folder, and a guard for the names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def durable(df: DataFrame) -> DataFrame:
    """Write once to the folder of ``spark.checkpoint.dir`` and read from there; survives the loss of executors."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that extra columns with any name do no harm."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


