"""Tables between the stages of a run, in the folder that driver and executors share.

A stage's results are read by several later ones. Written once, they are computed once, cut the plans that follow and
outlive lost executors.
"""

from __future__ import annotations

import contextlib
import contextvars
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only in one process, as in tests, where driver and executors share every folder.
LOCAL_DIR = "/tmp/checkpoints/beamloom-runs"

_WRITTEN: list[str] = []
_COUNTS: contextvars.ContextVar[dict[str, int] | None] = contextvars.ContextVar("counts", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it, only a local session has one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


@contextlib.contextmanager
def counting(counts: dict[str, int]) -> Iterator[None]:
    """Counters of the tables that are stored inside go into `counts`."""
    token = _COUNTS.set(counts)
    try:
        yield
    finally:
        _COUNTS.reset(token)


def stored(df: DataFrame, name: str, counters: dict[str, Column] | None = None) -> DataFrame:
    """df as a table. The counters (aggregates) are observed while it is written, so they cost no job of their own."""
    spark, counts, seen = df.sparkSession, _COUNTS.get(), Observation()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if wanted := counters if counts is not None else None:
        df = df.observe(seen, *[c.alias(n) for n, c in wanted.items()])
    _WRITTEN.append(path)
    df.write.parquet(path)
    if wanted:
        counts |= {n: v or 0 for n, v in seen.get.items()}
    return spark.read.parquet(path)


def swept(spark: SparkSession) -> None:
    """Removes the tables written by this process; what still reads them ends with it."""
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
