"""The driver's tables as domain tables (integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.sources.geometry import Detector

#: Seven planes of 24 x 24 pixels, 100 apart; one tilted, one of two dies.
DETECTORS = [Detector(f"P{p}", "telescope" if p < 6 else "dut", "reference" if p == 0 else "none", position=(0.0, 0.0, 100.0 * p), orientation=(0.1 if p == 5 else 0.0, 0.0, 0.0), n_cols=24, n_rows=24, pitch_x=1.0, pitch_y=1.0, res_x=0.3, res_y=0.3) for p in range(7)]
SIZE = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(c: str) -> Column:
    """Nanoseconds since 1970, as a double, without regard to the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))").cast("double") * 1000.0


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit a line item: event_id, plane, detector, col, row, channel, charge, ts."""
    plane = F.col("l_linenumber") - 1
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), plane.alias("plane"), F.concat(F.lit("P"), plane.cast("string")).alias("detector"), (F.col("l_partkey") % SIZE).cast("int").alias("col"),
        (F.col("l_suppkey") % SIZE).cast("int").alias("row"), (F.col("l_partkey") % 18).cast("int").alias("channel"), F.col("l_quantity").alias("charge"), epoch_ns("l_shipdate").alias("ts"),
    )


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits folded onto a tenth of the events and three detectors, so that clusters have several pixels."""
    h = hits(spark, sf_dir)
    return h.withColumns({"event_id": F.col("event_id") % 1500, "plane": F.col("plane") % 3, "detector": F.concat(F.lit("P"), (F.col("plane") % 3).cast("string"))})


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, channel, col, samples: vectors as voltage traces."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("event_id"), (F.col("vec_id") % 18).cast("int").alias("channel"), (F.col("label") % 4).cast("int").alias("col"), F.col("embedding").cast("array<double>").alias("samples"))


HITS_SQL = """hits AS (SELECT l_orderkey AS event_id, l_linenumber - 1 AS plane, 'P' || (l_linenumber - 1) AS detector, (l_partkey % 24)::INT AS col, (l_suppkey % 24)::INT AS row,
  (l_partkey % 18)::INT AS channel, l_quantity AS charge, epoch_us(l_shipdate)::DOUBLE * 1000.0 AS ts FROM lineitem)"""
DENSE_SQL = HITS_SQL + """,
dense AS (SELECT event_id % 1500 AS event_id, plane % 3 AS plane, 'P' || (plane % 3) AS detector, col, row, channel, charge, ts FROM hits)"""
