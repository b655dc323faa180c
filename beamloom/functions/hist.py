"""Histograms, profiles and their moments as aggregations.

Bins are half-open, [low, high), and found by truncation. NaN and null values are left out.
`entries` counts values out of range as well; moments do not. All groups are partial sums per
task before the shuffle, so the number of rows moved is bins times tasks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import scan


def _real(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def bins_1d(df: DataFrame, value: str, n: int, low: float, high: float, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """by, bin, content."""
    v = F.col(value).cast("double")
    inside = df.filter(_real(v) & (v >= low) & (v < high))
    return inside.groupBy(*by, ((v - low) / ((high - low) / n)).cast("int").alias("bin")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("content"))


def stats_1d(df: DataFrame, value: str, low: float, high: float, by: tuple[str, ...] = (), weight: Column | None = None, merged: bool = False) -> DataFrame:
    """by, entries, sum_w, sum_wx, sum_wx2, mean, std. `merged`: entries count values in range only, as pre-binned blocks do."""
    v, w = F.col(value).cast("double"), F.lit(1.0) if weight is None else weight
    inside = (v >= low) & (v < high)
    some = df.filter(_real(v)).groupBy(*by).agg(
        F.count(F.when(inside, 1) if merged else F.lit(1)).alias("entries"), F.coalesce(F.sum(F.when(inside, w)), F.lit(0.0)).alias("sum_w"),
        F.coalesce(F.sum(F.when(inside, w * v)), F.lit(0.0)).alias("sum_wx"), F.coalesce(F.sum(F.when(inside, w * v * v)), F.lit(0.0)).alias("sum_wx2"),
    )
    mean = F.when(F.col("sum_w") != 0, F.col("sum_wx") / F.col("sum_w")).otherwise(0.0)
    var = F.when(F.col("sum_w") != 0, F.col("sum_wx2") / F.col("sum_w") - mean * mean).otherwise(0.0)
    return some.withColumns({"mean": mean, "std": F.sqrt(F.greatest(var, F.lit(0.0)))})


def bins_2d(df: DataFrame, x: str, y: str, nx: int, lx: float, hx: float, ny: int, ly: float, hy: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ix, iy, content, with cross moments available from moments_2d."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    inside = df.filter(_real(u) & _real(v) & (u >= lx) & (u < hx) & (v >= ly) & (v < hy))
    return inside.groupBy(*by, ((u - lx) / ((hx - lx) / nx)).cast("int").alias("ix"), ((v - ly) / ((hy - ly) / ny)).cast("int").alias("iy")).agg(F.count("*").alias("content"))


def moments_2d(df: DataFrame, x: str, y: str, lx: float, hx: float, ly: float, hy: float, by: tuple[str, ...] = ()) -> DataFrame:
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    inside = (u >= lx) & (u < hx) & (v >= ly) & (v < hy)
    pick = lambda c: F.coalesce(F.sum(F.when(inside, c)), F.lit(0.0))
    return df.filter(_real(u) & _real(v)).groupBy(*by).agg(
        F.count("*").alias("entries"), pick(F.lit(1.0)).alias("sum_w"), pick(u).alias("sum_x"), pick(v).alias("sum_y"), pick(u * u).alias("sum_x2"), pick(v * v).alias("sum_y2"), pick(u * v).alias("sum_xy")
    )


def mode(bins: DataFrame, n: int, low: float, high: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, mode_bin, mode (its centre); the first of equal maxima."""
    top = bins.groupBy(*by).agg(F.max_by("bin", F.struct("content", -F.col("bin"))).alias("mode_bin"))
    return top.withColumn("mode", low + (F.col("mode_bin") + 0.5) * ((high - low) / n))


def parabolic_peak(bins: DataFrame, n: int, low: float, high: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, peak: the vertex of the parabola through the mode and its neighbours (empty bins are 0); the centre at an edge or on a flat top."""
    top = mode(bins, n, low, high, by)
    side = bins.join(F.broadcast(top) if not by else top, list(by)) if by else bins.crossJoin(F.broadcast(top))  # one row
    at = lambda k: F.coalesce(F.max(F.when(F.col("bin") == F.col("mode_bin") + k, F.col("content"))), F.lit(0.0))
    near = side.groupBy(*by, "mode_bin", "mode").agg(at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when((F.col("mode_bin") > 0) & (F.col("mode_bin") < n - 1) & (bend != 0), 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)
    return near.select(*by, (F.col("mode") + shift * ((high - low) / n)).alias("peak"))


def mean_in_range(bins: DataFrame, n: int, low: float, high: float, first: float, last: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of bin centres inside [first, last]."""
    centre = low + (F.col("bin") + 0.5) * ((high - low) / n)
    return bins.filter(centre.between(first, last)).groupBy(*by).agg((F.sum(centre * F.col("content")) / F.sum("content")).alias("mean"))


def profile(df: DataFrame, keys: list[Column], values: dict[str, Column]) -> DataFrame:
    """Mean of each value in each cell."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in values.items()])


def running_ratio(df: DataFrame, passed: Column, key: str) -> DataFrame:
    """key (whole numbers), ratio: passed over all up to each key. Keys are summed first, so the scan has one row a key."""
    sums = df.groupBy(key).agg(F.sum(passed.cast("long")).alias("p"), F.count("*").alias("n"))
    run = scan.running(sums, (), (key,), {"__p": ("sum", F.col("p")), "__n": ("sum", F.col("n"))})
    return run.select(key, (F.col("__p") / F.col("__n")).alias("ratio"))
