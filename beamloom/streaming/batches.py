"""A run in micro-batches: sums that outlive batches, restarts and replays.

Each micro-batch makes tables of sums (contents of histograms, moments, cut flows, counters) and writes them as
the partition of its own number. A batch that is replayed after a failure has the same number and
overwrites what it left, so nothing counts twice and nothing is lost; no state is kept in the driver. The result is the
sum over the batches. A batch must hold whole events where the tables need them (closed windows do, see `building`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beamloom.operators import plots

#: Tables of sums by name.
Tables = dict[str, DataFrame]


def filled(entries: DataFrame) -> Tables:
    """The sums of a table of plot entries (`plots.entries`)."""
    return {"hist_bins": plots.bins(entries), "hist_sums": plots.sums(entries)}


def accumulated(stream: DataFrame, fill: Callable[[DataFrame], Tables], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the run: `fill` turns a micro-batch into tables of sums, each stored under its name in the folder. By default it takes what there
    is and ends. The checkpoint belongs to the folder: what it has taken is there."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()  # several tables read it
        try:
            for name, sums in fill(batch).items():
                numbered = sums.withColumn("batch", F.lit(number))
                numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{name}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, folder: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """A table's sums over all batches: one row for each value of the keys."""
    parts = spark.read.parquet(f"{folder}/{name}").drop("batch")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def histograms(spark: SparkSession, folder: str) -> Tables:
    """hist_bins and hist_stats of the whole run, as a run in one piece writes them."""
    return {
        "hist_bins": merged(spark, folder, "hist_bins", ("path", "plot", "ix", "iy")),
        "hist_stats": plots.moments(merged(spark, folder, "hist_sums", ("path", "plot"))),
    }
