"""Tables on the way: written to the folder that all executors share, numbered in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that setting is unset a temporary folder serves, but only if driver and tasks are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gevel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/gevel-{name}-{uuid.uuid4().hex}"


#: Whether what a statement has shuffled goes from the disks once it is done; else it stays until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new path, read again: it is computed once, and outlives executors. What was shuffled for it is removed then."""
    spark = df.sparkSession
    path = files_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place of each row, from 0, in an order, which should be total. Rows are sorted by ranges and written; the only thing that one task sees is the number of rows of each partition."""
    rows = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")
