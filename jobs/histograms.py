"""Histograms of a data taking, kept up to date: of hits, of logbook texts, or of any other table.

    python -m jobs.histograms --config jobs/histograms.toml --input DIR --output DIR --checkpoint DIR

For each table of the configuration a file stream takes the files that are new since its checkpoint, fills all of the
table's plots in one pass, and stores the batch's sums under the batch's number (`beamloom.streaming.batches`), so a batch
that is replayed counts once. Then the sums over all batches are written as contents (hist_bins) and statistics
(hist_stats), partitioned by table; only the partitions of the configured tables are overwritten. A call that finds
nothing new writes the same again.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.operators import plots
from beamloom.streaming import batches
from jobs import settings

log = logging.getLogger("jobs.histograms")
RESULTS = ("hist_bins", "hist_stats")


def plot(p: dict) -> plots.Plot:
    y = {k: float(p[k]) if k != "bins_y" else int(p[k]) for k in ("bins_y", "low_y", "high_y")} | {"y": F.expr(p["y"])} if "y" in p else {}
    return plots.Plot(p["name"], F.expr(p["x"]), int(p["bins"]), float(p["low"]), float(p["high"]), **y)


def filling(wanted: list[dict]):
    """A function from rows to the sums of their plots."""
    paths = sorted({p["path"] for p in wanted})

    def fill(rows: DataFrame) -> batches.Tables:
        each = [plots.entries(rows, plots.places(F.expr(path)), [plot(p) for p in wanted if p["path"] == path]) for path in paths]
        entries = each[0]
        for more in each[1:]:
            entries = entries.unionByName(more)
        return batches.filled(entries)

    return fill


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in the source's tables (`<source>/<table>.parquet`) and returns hist_bins as they stand."""
    for table in dict.fromkeys(p["table"] for p in config["plot"]):
        wanted = [p for p in config["plot"] if p["table"] == table]
        path = f"{source}/{table}.parquet"
        stream = settings.streamed(spark, path, config["files_per_batch"])
        sums = f"{output}/sums/{table}"
        read = settings.ended(batches.accumulated(stream, filling(wanted), sums, f"{checkpoint}/{table}"), log, path)
        for name, df in batches.histograms(spark, sums).items():
            df.withColumn("table", F.lit(table)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table").parquet(f"{output}/{name}")
        log.info("read %d new rows of %s", read, path)
    for name in RESULTS:
        log.info("%s/%s has %d rows", output, name, spark.read.parquet(f"{output}/{name}").count())
    return spark.read.parquet(f"{output}/hist_bins").select("table", "path", "plot", "ix", "iy", "content")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(argv)
    settings.logging_to_console()
    spark = SparkSession.builder.appName("histograms").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, settings.read(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
