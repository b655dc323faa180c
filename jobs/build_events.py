"""Event building as data arrive: new files of sub-events become events, each with the sub-events of one trigger.

    python -m jobs.build_events --config jobs/build_events.toml --input DIR --output DIR --checkpoint DIR

A file stream takes the files that are new since the checkpoint and ends. Windows that a higher one has closed, or whose
run has ended, are written by the file sink, partitioned by run; open windows and sub-events that are ahead stay in the
stream's state for the next call. A run's sub-events have to come in the order of seq from batch to batch; inside a batch any order does.
So by default a call takes all new files as one batch; `files_per_batch` is for inputs whose files are modified in that order.
A call that finds nothing new changes nothing. The output is one row a sub-event:
run, event_id, number, seq, producer, window_ts.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.streaming import building
from jobs import settings

log = logging.getLogger("jobs.build_events")
OUTPUT = "event_id long, number long, seq long, producer string, window_ts double, run long"
FIELDS = {"run": "long", "seq": "long", "producer": "string", "number": "long", "begin": "long", "end": "long"}


def sub_events(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.select(*[F.expr(columns[n]).cast(t).alias(n) for n, t in FIELDS.items()])


def built(spark: SparkSession, output: str) -> DataFrame:
    """The events so far; none, as long as no window is closed."""
    return spark.read.schema(OUTPUT).parquet(output).select("run", "event_id", "number", "seq", "producer", "window_ts")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in the source and returns all events built so far."""
    stream = settings.streamed(spark, source.rstrip("/"), config["files_per_batch"])
    with settings.setting(spark, dict([building.STATE_STORE])):
        rows = building.stream_windowed(sub_events(stream, config["columns"]), config["master"] or None, config["end"] or None, config["max_windows"])
        query = (
            rows.writeStream.format("parquet").outputMode("append").partitionBy("run").option("path", output).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        read = settings.ended(query, log, source)
    out = built(spark, output)
    log.info("read %d new rows of %s; %s has %d rows", read, source, output, out.count())
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(argv)
    settings.logging_to_console()
    spark = SparkSession.builder.appName("build_events").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, settings.read(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
