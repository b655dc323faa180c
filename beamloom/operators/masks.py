"""Occupancy and pixel masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXEL = ("detector", "col", "row")


def occupancy(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*PIXEL).agg(F.count("*").alias("n"))


def grid(detectors: DataFrame) -> DataFrame:
    """All pixels of all detectors: as many rows as pixels, made on the executors."""
    cols = detectors.select("detector", "n_cols", "n_rows", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return cols.select("detector", "n_cols", "n_rows", "col", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))


def frequency_mask(hits: DataFrame, detectors: DataFrame, masked: DataFrame, cut: float = 50.0) -> DataFrame:
    """New masks: pixels with more than `cut` times the mean over all pixels, empty ones included."""
    n = occupancy(hits)
    total = n.groupBy("detector").agg(F.sum("n").alias("total"))
    mean = total.join(F.broadcast(detectors.select("detector", "n_cols", "n_rows")), "detector").select("detector", (F.col("total") / (F.col("n_cols") * F.col("n_rows"))).alias("mean"))
    hot = n.join(F.broadcast(mean), "detector").filter(F.col("n") > cut * F.col("mean"))
    return hot.select(*PIXEL, "n").join(masked, list(PIXEL), "left_anti")


def local_density(hits: DataFrame, detectors: DataFrame, bandwidth: int = 10) -> DataFrame:
    """n, mean of the neighbours in a box without the pixel itself (clipped at the edges), and significance.

    The box is summed in one direction after the other: each filled pixel is added to the 2b + 1 rows next to it, and then
    a frame of 2b + 1 columns runs along each row. Pixels are as many as the sensors have, however many hits there are.
    """
    n = occupancy(hits)
    near = F.sequence(F.col("row") - bandwidth, F.col("row") + bandwidth)
    tall = n.select("detector", "col", F.explode(near).alias("row"), "n").groupBy(*PIXEL).agg(F.sum("n").alias("tall"))
    along = Window.partitionBy("detector", "row").orderBy("col").rangeBetween(-bandwidth, bandwidth)
    boxes = tall.withColumn("box", F.sum("tall").over(along)).drop("tall")
    joined = n.join(boxes, list(PIXEL)).withColumn("around", F.col("box") - F.col("n")).join(F.broadcast(detectors.select("detector", "n_cols", "n_rows")), "detector")  # one row a detector

    def side(c: str, size: str):
        return F.least(F.col(size) - 1, F.col(c) + bandwidth) - F.greatest(F.lit(0), F.col(c) - bandwidth) + 1

    mean = F.col("around") / (side("col", "n_cols") * side("row", "n_rows") - 1)
    return joined.select(*PIXEL, "n", mean.alias("mean"), F.when(mean > 0, (F.col("n") - mean) / F.sqrt(mean)).alias("significance"))


def density_mask(hits: DataFrame, detectors: DataFrame, masked: DataFrame, events: int, bandwidth: int = 10, sigma: float = 5.0, rate: float = 1.0) -> DataFrame:
    d = local_density(hits, detectors, bandwidth)
    hot = d.filter((F.col("significance") > sigma) | (F.col("n") / F.lit(events) > rate))
    return hot.select(*PIXEL).join(masked, list(PIXEL), "left_anti")


def dead_pixels(hits: DataFrame, detectors: DataFrame, masked: DataFrame) -> DataFrame:
    return grid(detectors).select(*PIXEL).join(hits.select(*PIXEL).distinct(), list(PIXEL), "left_anti").join(masked, list(PIXEL), "left_anti")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select(*PIXEL).unionByName(new.select(*PIXEL)).distinct()


def dilated(masked: DataFrame, tolerance: int) -> DataFrame:
    """Masked pixels with their surroundings, so that a neighbourhood test is an equi-join."""
    step = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    near = masked.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return near.select("detector", (F.col("col") + F.col("dx")).alias("col"), (F.col("row") + F.col("dy")).alias("row")).distinct()


def write_text(masked: DataFrame, path: str) -> None:
    masked.select(F.concat_ws(" ", F.lit("p"), "col", "row").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str, detector: str) -> DataFrame:
    """Lines `p col row` or `c col row`; either names one pixel."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value").rlike("^[pc] ")).select(F.lit(detector).alias("detector"), parts[1].cast("int").alias("col"), parts[2].cast("int").alias("row"))
