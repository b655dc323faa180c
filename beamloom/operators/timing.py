"""Time differences between detectors, and the time-walk correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords
from beamloom.operators import assoc


def pairs(hits: DataFrame, order: list[str], same_group: bool = True, all_of: bool = False, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Clusters of one track on two detectors (track_id, detector, channel, ts, charge), the first detector earlier in `order`.

    `same_group`: both channels are of one trigger group; an unknown channel is of none.
    """
    rank = F.lit(None).cast("int")
    for i, d in enumerate(order):
        rank = F.when(F.col("detector") == d, i).otherwise(rank)
    some = hits.withColumns({"rank": rank, "grp": coords.trigger_group(F.col("channel"))}).filter("rank IS NOT NULL")
    if all_of:
        some = some.join(assoc.with_all(hits, order, by), list(by), "left_semi")
    a, b = some.alias("a"), some.alias("b")
    same = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by])
    both = a.join(b, same).filter(F.col("a.rank") < F.col("b.rank"))
    if same_group:
        both = both.filter((F.col("a.grp") == F.col("b.grp")) & (F.col("a.grp") >= 0))
    return both.select(
        *[F.col(f"a.{k}") for k in by], F.col("a.detector").alias("first"), F.col("b.detector").alias("second"), (F.col("a.ts") - F.col("b.ts")).alias("dt"), F.col("a.charge").alias("charge_first"), F.col("b.charge").alias("charge_second"),
    )


def pair_counts(pairs_: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """first, second, pairs (of a track), tracks: how many pairs of clusters tracks give."""
    return pairs_.groupBy(*by, "first", "second").agg(F.count("*").alias("pairs")).groupBy("first", "second", "pairs").agg(F.count("*").alias("tracks"))


def cluster_counts(hits: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """detector, clusters (of a track), tracks."""
    return hits.groupBy(*by, "detector").agg(F.count("*").alias("clusters")).groupBy("detector", "clusters").agg(F.count("*").alias("tracks"))


def walk(ts: Column, charge: Column, a: float, b: float, method: str) -> Column:
    """ts - (a / q + b), or with the root of q; unchanged for q <= 0 or no method."""
    over = charge if method == "inverse" else F.sqrt(charge)
    return ts if method == "none" else F.when(charge > 0, ts - (a / over + b)).otherwise(ts)


def fit_walk(df: DataFrame, by: tuple[str, ...], x: Column, t: Column) -> DataFrame:
    """by, slope, mean_x, n: least squares of t on x by five sums; 0 for fewer than two points or no spread."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(t).alias("st"), F.sum(x * t).alias("sxt"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") >= 2) & (F.abs(det) >= 1e-30), (F.col("n") * F.col("sxt") - F.col("sx") * F.col("st")) / det).otherwise(0.0)
    return s.select(*by, slope.alias("slope"), (F.col("sx") / F.col("n")).alias("mean_x"), "n")


def corrected(df: DataFrame, fitted: DataFrame, by: tuple[str, ...], x: Column, t: Column, charge: Column) -> DataFrame:
    """df with `corrected`: t - slope * (x - mean_x), unchanged for charges up to 1e-3. fitted has one row a pair of detectors."""
    new = F.when(charge > 1e-3, t - F.col("slope") * (x - F.col("mean_x"))).otherwise(t)
    return df.join(fitted.drop("n"), list(by)).withColumn("corrected", new).drop("slope", "mean_x")
