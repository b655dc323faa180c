"""What the jobs share: configuration files, settings that are put back, file streams, and the log."""

from __future__ import annotations

import contextlib
import logging
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())


@contextlib.contextmanager
def setting(spark: SparkSession, values: dict[str, str]):
    """The session with some settings changed; they are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """A file stream of a Parquet table with the schema of what is there. A path that is one file is taken as a pattern, as a stream's path
    must otherwise be a folder. With 0 files a batch, one batch takes all that is new."""
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(pattern)


def ended(query: StreamingQuery, log: logging.Logger, what: str) -> int:
    """Waits for a stream to end (its failure is raised) and logs its batches; returns the rows that it read."""
    query.awaitTermination()
    rows = 0
    for p in query.recentProgress:
        rows += p["numInputRows"]
        log.info("%s: batch %s read %s rows in %s ms", what, p["batchId"], p["numInputRows"], p["batchDuration"])
    return rows


def logging_to_console() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
