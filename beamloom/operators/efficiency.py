"""Efficiency, fake rates and charge maps of a detector under test."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords, hist, near

#: Stages of the cut flow, each track in the first that stops it; tracks that are not isolated drop out but are no stage of the report.
STAGES = ("outside", "chi2", "not_isolated", "masked", "no_required", "good")


def cut_stage(outside: Column, chi2ndof: Column, cut: float, isolated: Column, masked: Column, required: Column) -> Column:
    return (
        F.when(outside, "outside").when(chi2ndof > cut, "chi2").when(~isolated, "not_isolated").when(masked, "masked").when(~required, "no_required").otherwise("good")
    )


def cut_flow(tracks: DataFrame) -> DataFrame:
    """stage, n of tracks with a `stage` column."""
    return tracks.groupBy("stage").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Frame:
    """The bins of a map: over 1.4 times the sensor, round the detector's place (global) or the middle (local)."""

    low_x: float
    low_y: float
    width_x: float
    width_y: float
    bins_x: int
    bins_y: int

    @classmethod
    def of(cls, size: tuple[float, float], bin_size: tuple[float, float], centre: tuple[float, float] = (0.0, 0.0)) -> Frame:
        bins = [max(1, math.floor(1.4 * s / b + 0.5)) for s, b in zip(size, bin_size, strict=True)]
        low = [c - 0.7 * s for c, s in zip(centre, size, strict=True)]
        return cls(*low, *[1.4 * s / n for s, n in zip(size, bins, strict=True)], *bins)


def efficiency_map(good: DataFrame, x: str, y: str, low_x: float, low_y: float, width: float, bins_x: int, bins_y: int, width_y: float | None = None, empty: bool = False) -> DataFrame:
    """ix, iy, matched, n, efficiency over the bins that have tracks; with `empty` the others have 0."""
    ix, iy = coords.bin_2d(F.col(x), F.lit(low_x), width), coords.bin_2d(F.col(y), F.lit(low_y), width_y or width)
    inside = good.withColumns({"ix": ix, "iy": iy}).filter(F.col("ix").between(0, bins_x - 1) & F.col("iy").between(0, bins_y - 1))
    n = inside.groupBy("ix", "iy").agg(F.sum(F.col("matched").cast("long")).alias("matched"), F.count("*").alias("n"))
    if empty:
        spark = good.sparkSession
        cells = spark.range(bins_x).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(0), F.lit(bins_y - 1))).alias("iy"))
        n = cells.join(n, ["ix", "iy"], "left").select("ix", "iy", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "n")])
    return n.withColumn("efficiency", F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0))


def efficiency_maps(good: DataFrame, size: tuple[float, float], bin_size: tuple[float, float], centre: tuple[float, float]) -> DataFrame:
    """frame (local: u, v; global: x, y), ix, iy, matched, n, efficiency, with the bins that no track meets."""
    out = None
    for name, x, y, c in (("local", "u", "v", (0.0, 0.0)), ("global", "x", "y", centre)):
        f = Frame.of(size, bin_size, c)
        one = efficiency_map(good, x, y, f.low_x, f.low_y, f.width_x, f.bins_x, f.bins_y, f.width_y, True).withColumn("frame", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def total_efficiency(good: DataFrame) -> DataFrame:
    return good.agg(F.sum(F.col("matched").cast("long")).alias("matched"), F.count("*").alias("n"), (100.0 * F.avg(F.col("matched").cast("double"))).alias("percent"))


def moyal_mpv(charge: Column, sigma: float) -> Column:
    """Most probable value of a Moyal distribution from the mean of exp(-q / sigma)."""
    return -sigma * F.log(F.avg(F.exp(-charge / sigma)))


def charge_map(assoc: DataFrame, x: str, y: str, low: float, width: float, sigma: float) -> DataFrame:
    """Means over the associated clusters of each bin, one entry a track and cluster."""
    keys = [coords.bin_2d(F.col(x), F.lit(low), width).alias("ix"), coords.bin_2d(F.col(y), F.lit(low), width).alias("iy")]
    widths = [F.avg(c).alias(c) for c in ("width_col", "width_row") if c in assoc.columns]
    return assoc.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("charge").alias("charge"), F.avg("size").alias("size"), *widths, F.avg("ts").alias("toa"), moyal_mpv(F.col("charge"), sigma).alias("mpv")
    )


def profile_maps(cells: DataFrame, sigma: float) -> DataFrame:
    """ix, iy, n and the means over associated clusters (one entry a track and cluster) of charge, size, widths and time, with the most probable charge."""
    means = [F.avg(c).alias(c) for c in ("charge", "size", "width_col", "width_row", "ts")]
    return cells.groupBy("ix", "iy").agg(F.count("*").alias("n"), *means, moyal_mpv(F.col("charge"), sigma).alias("mpv"))


def efficiency_by_event(good: DataFrame) -> DataFrame:
    """event_id, ratio: the efficiency over all tracks up to each event."""
    return hist.running_ratio(good, F.col("matched"), "event_id")


def fakes_by_radius(clusters: DataFrame, tracks: DataFrame, distance: float, inside_counts: bool = False) -> DataFrame:
    """Clusters that no track of their event comes near. Tracks inside the widened active area (`inside`) don't count, unless
    inside_counts: only those outside veto."""
    t = tracks if inside_counts else tracks.filter("NOT inside")
    if distance <= 0:
        return clusters
    t = near.around(t, "px", "py", distance).select(F.col("event_id").alias("__e"), F.col("__ix").alias("__jx"), F.col("__iy").alias("__jy"), F.col("px").alias("__x"), F.col("py").alias("__y"))
    dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    met = (F.col("event_id") == F.col("__e")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")) & (dx * dx + dy * dy < distance * distance)
    return near.celled(clusters, "x", "y", distance).join(t, met, "left_anti").drop("__ix", "__iy")


def fakes_by_edge(clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clusters of events without a track inside the widened active area."""
    return clusters.join(tracks.filter("inside").select("event_id").distinct(), "event_id", "left_anti")


def fake_map(fake_pixels: DataFrame, events: DataFrame) -> DataFrame:
    """col, row, rate: fake pixels of an event. events: those that were looked at, one row each; their number is one value of the plan."""
    total = events.agg(F.count("*").alias("events"))  # one row
    n = fake_pixels.groupBy("col", "row").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("col", "row", (F.col("n") / F.col("events")).alias("rate"))


def all_events(tracks: DataFrame, clusters: DataFrame) -> DataFrame:
    """event_id of the events with a track or a cluster."""
    return tracks.select("event_id").union(clusters.select("event_id")).distinct()


def fake_rate(fakes: DataFrame, events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """second, fakes, events, rate. Times of events in ns."""
    per = fakes.groupBy("event_id").agg(F.count("*").alias("f"))
    j = events.join(per, "event_id", "left")
    slot = F.floor(F.col("ts") / (seconds * 1e9)).alias("second")
    return j.groupBy(slot).agg(F.sum(F.coalesce("f", F.lit(0))).alias("fakes"), F.count("*").alias("events"), F.avg(F.coalesce("f", F.lit(0)).cast("double")).alias("rate"))
