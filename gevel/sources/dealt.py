"""Tables dealt into parts by a hash of their keys, so that an upsert reads and writes only the parts that its rows are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.operators.kept import kept
from gevel.operators.merge import upserted

PART = "part_of"


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _done(spark: SparkSession, path: str, batch: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{batch}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _mark(spark: SparkSession, path: str, batch: str) -> None:
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/_batches/{batch}")


def create_dealt(rows: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Writes rows, one for each key, as a new table of so many parts. Some hundred MB a part is a good size; their number stays."""
    rows.withColumn(PART, part_of(keys, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def read_dealt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def upsert_dealt(rows: DataFrame, path: str, keys: Sequence[str], overwrite: Sequence[str], parts: int, batch: str) -> None:
    """Merges rows, one for each key, into the table (see upserted), once for each batch: one that has been merged changes nothing.

    The parts that hold the rows' keys are read, merged, written aside, and then take the place of the old ones; all others stay untouched. If that is cut short, the batch isn't marked as done, and merging it again gives what it would have given. Which parts these are comes to the driver: at most `parts` numbers. Writers must take turns.
    """
    spark = rows.sparkSession
    if _done(spark, path, batch):
        return
    new = kept(rows.withColumn(PART, part_of(keys, parts)), "upsert")
    touched = [r[0] for r in new.select(PART).distinct().collect()]
    if touched:
        old = spark.read.parquet(path).where(F.col(PART).isin(touched))
        merged = kept(upserted(old, new, [*keys, PART], overwrite).drop("outcome"), "merged")
        merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    _mark(spark, path, batch)
