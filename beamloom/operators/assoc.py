"""Association of tracks with the clusters of a detector under test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords

#: The names of the reasons 0, 1 and 2 of a pair.
REASONS = ("associated", "outside_ellipse", "outside_time")


def nearest_pixel(x: Column, y: Column, pixels: Column) -> tuple[Column, Column]:
    """Distances to the nearest pixel in x and in y, each on its own."""
    return F.array_min(F.transform(pixels, lambda p: F.abs(p["x"] - x))), F.array_min(F.transform(pixels, lambda p: F.abs(p["y"] - y)))


def examined(tracks: DataFrame, clusters: DataFrame, cut_x: float, cut_y: float, time_cut: float = 1e30, use_centre: bool = False) -> DataFrame:
    """Pairs of a track (event_id, track_id, px, py, die, ts) and a cluster of its event and die, with reason: 1 outside the ellipse, 2 outside
    the time window, 0 associated. Tracks without a prediction (NaN or null) take no part."""
    t = tracks.filter(F.col("px").isNotNull() & F.col("py").isNotNull() & ~F.isnan("px") & ~F.isnan("py")).select("event_id", "track_id", "px", "py", F.col("die").alias("track_die"), F.col("ts").alias("track_ts"))
    j = t.join(clusters, "event_id").filter(F.col("die").eqNullSafe(F.col("track_die")))
    cx, cy = F.abs(F.col("px") - F.col("x")), F.abs(F.col("py") - F.col("y"))
    nx, ny = nearest_pixel(F.col("px"), F.col("py"), F.col("pixels"))
    dx, dy = (cx, cy) if use_centre else (nx, ny)
    reason = F.when(~coords.in_ellipse(dx, dy, cut_x, cut_y), 1).when(F.abs(F.col("ts") - F.col("track_ts")) > time_cut, 2).otherwise(0)
    return j.withColumns({"dist_x": dx, "dist_y": dy, "centre_minus_nearest_x": cx - nx, "centre_minus_nearest_y": cy - ny}).withColumn("reason", reason)


def associated(pairs: DataFrame) -> DataFrame:
    """All clusters inside the cuts, not only the closest."""
    return pairs.filter("reason = 0")


def closest(pairs: DataFrame) -> DataFrame:
    """event_id, track_id, cluster_id of the nearest association; ties (to nine digits, as distances are sums) by cluster id."""
    d = F.round(F.col("dist_x") * F.col("dist_x") + F.col("dist_y") * F.col("dist_y"), 9)
    return associated(pairs).groupBy("event_id", "track_id").agg(F.min_by("cluster_id", F.struct(d, "cluster_id")).alias("cluster_id"))


def counts(tracks: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """event_id, track_id, die, n, seen: associations of each track on each die and, die null, in all; seen: its event had a cluster at all."""
    by = associated(pairs).groupBy("event_id", "track_id", "track_die").agg(F.count("*").alias("n"))
    events = clusters.select("event_id").distinct().withColumn("seen", F.lit(True))
    base = tracks.select("event_id", "track_id", F.col("die").alias("track_die")).join(events, "event_id", "left")
    same = (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.track_id") == F.col("b.track_id")) & F.col("a.track_die").eqNullSafe(F.col("b.track_die"))
    each = base.alias("a").join(by.alias("b"), same, "left").select("a.event_id", "a.track_id", "a.track_die", "seen", "n").select("event_id", "track_id", F.col("track_die").alias("die"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seen", F.lit(False)).alias("seen"))
    return each


def reasons(pairs: DataFrame) -> DataFrame:
    """die (null: all together), reason, n, share of the examined pairs."""
    n = pairs.groupingSets([["reason"], ["track_die", "reason"]], "track_die", "reason").agg(F.count("*").alias("n"), F.grouping("track_die").alias("all_dies"))
    total = n.groupBy("all_dies", F.col("track_die").alias("d")).agg(F.sum("n").alias("total"))
    j = n.join(total, (n["all_dies"] == total["all_dies"]) & n["track_die"].eqNullSafe(total["d"]))
    return j.select(F.col("track_die").alias("die"), "reason", "n", (F.col("n") / F.col("total")).alias("share"))


def with_all(links: DataFrame, required: list[str], by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The tracks with a cluster on every required detector; all tracks of `links` if none is required."""
    if not required:
        return links.select(*by).distinct()
    return links.filter(F.col("detector").isin(required)).groupBy(*by).agg(F.count_distinct("detector").alias("k")).filter(F.col("k") == len(set(required))).select(*by)


def on_tracks(fit_clusters: DataFrame, associations: DataFrame, by: tuple[str, ...] = ("event_id", "track_id")) -> DataFrame:
    """Clusters that a track was fitted to or that are associated with it, each once: what a requirement on a detector looks at."""
    names = [*by, "detector", "cluster_id"]
    return fit_clusters.select(*names).unionByName(associations.select(*names)).distinct()
