"""Where intermediate results go: tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of the batches that tasks hand to Python while a table is written; an executor holds them outside its heap, about twice for each task.
BYTES_AT_ONCE = "16m"

_BYTES, _ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether what a statement has shuffled goes from the disks once it is done; else it stays until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def in_small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on the session hands rows to Python in batches of `size` bytes, unless it has a setting of its own. For many stages in one session: what an executor once held outside its heap for large batches it doesn't give back. Python goes through about 4 MB at once anyway."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. If that is unset, a temporary folder is set there, but only where driver and tasks are one process (tests); on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gevel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gevel-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_at_once: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, which cuts the lineage and survives lost executors; what was shuffled for it is removed then. rows_at_once bounds the rows that Python gets at a time, for wide rows; their bytes are bounded by the session's setting, or BYTES_AT_ONCE if it has none."""
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {_BYTES: spark.conf.get(_BYTES, None) or BYTES_AT_ONCE, CLEANUP: "true"}
    if rows_at_once:
        settings[_ROWS] = str(rows_at_once)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(work: Work) -> Work:
    """The same work for mapInArrow, which at a task's end gives the memory that it took back to the system: workers outlive their tasks, and would keep the most that any of them took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
