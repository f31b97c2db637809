"""Where results go: responses and appended rows, each batch once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def responses(df: DataFrame, *meta: Column) -> DataFrame:
    """One row for each row of df: data, its columns as a structure, and meta, those given, as another."""
    return df.select(F.struct(*df.columns).alias("data"), F.struct(*meta).alias("meta")) if meta else df.select(F.struct(*df.columns).alias("data"))


def append_batch(df: DataFrame, path: str, batch: str, kind: str = "json") -> None:
    """Adds df to the files at path, below batch=<batch>. Spark's committer shows a task's file only once all tasks have ended, so a write that fails leaves what was there; a batch that is written again takes the place of its first writing and adds nothing."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").format(kind).save(path)
