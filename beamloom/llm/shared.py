"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 1000
#: Used only in one process, as in tests, where driver and executors share every folder.
DEFAULT_SHARED_DIR = "/tmp/checkpoints/beamloom"

_WRITTEN: list[str] = []
_RECORD: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("record", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without it, only a local session has one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return DEFAULT_SHARED_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


@contextlib.contextmanager
def short_batches(spark: SparkSession):
    """Texts are long rows: an Arrow batch of Spark's default number of them takes tens of megabytes on both sides.
    While a table is written, a session that has this default gets BATCH_ROWS; afterwards its setting is back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        if before == "10000":
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and outlives lost executors.

    `buckets` (number, column) stores it bucketed and sorted by the column, so that joins on the column
    shuffle the other side only. `swept` removes the tables that this process has written.
    """
    spark = df.sparkSession
    key = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{key}"
    with short_batches(spark):
        _WRITTEN.append(path)
        if (record := _RECORD.get()) is not None:
            record.append(path)
        if buckets is None:
            df.write.parquet(path)
            return spark.read.parquet(path)
        named = key.replace("-", "_")
        df.write.bucketBy(buckets[0], buckets[1]).sortBy(buckets[1]).option("path", path).saveAsTable(named)
        return spark.table(named)


def compact(df: DataFrame) -> DataFrame:
    """df in two tasks a core, or a sixteenth of the shuffle's partitions if that is more: for tables of short rows that an exchange has
    dealt evenly, which else are a file of some hundred bytes a partition. A file takes several calls of the store, and on local
    disks processes that an executor starts for its permissions."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)
            _WRITTEN[:] = [p for p in _WRITTEN if p.rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that the code inside writes; code of other threads does not count."""
    record: list[str] = []
    token = _RECORD.set(record)
    try:
        yield record
    finally:
        _RECORD.reset(token)


def released(spark: SparkSession, folders: list[str], reader: DataFrame) -> None:
    """Removes written tables that a DataFrame does not read, and takes them off the list."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in reader.inputFiles()}
    for path in [p for p in folders if p.rsplit("/", 1)[-1] not in read]:
        _remove(spark, path)
        folders.remove(path)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def spent(spark: SparkSession, reader: DataFrame) -> None:
    """Removes the tables written so far inside the innermost `recorded` that a DataFrame does not read; nothing outside of one."""
    released(spark, _RECORD.get() or [], reader)


def collected(spark: SparkSession) -> None:
    """Lets executors collect their heaps and give back what is free: a heap that a stage's garbage has widened stays wide otherwise, while
    the Python workers of the next stage need the memory of the same container. It changes no result; executors that get no task of it
    collect when they need to."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def swept(spark: SparkSession) -> None:
    """Removes all tables written by this process; results that still read them end with it."""
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returned_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the Python worker gives free memory back: workers outlive tasks, and the next stage needs it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
