"""Correlations with a reference detector, and prealignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords, hist


def pairs(things: DataFrame, reference: str, time_cut: float | None = None, inclusive: bool = False, keep_self: bool = True) -> DataFrame:
    """Each thing with each of the reference's things of the same event: d x, y, time. The reference meets itself too.

    An equi-join on the event with the time window as a residual; pairs are as many as an event's multiplicities give.
    """
    ref = things.filter(F.col("detector") == reference).select("event_id", F.col("x").alias("ref_x"), F.col("y").alias("ref_y"), F.col("ts").alias("ref_ts"))
    some = things if keep_self else things.filter(F.col("detector") != reference)
    joined = some.join(ref, "event_id").withColumns({"dx": F.col("ref_x") - F.col("x"), "dy": F.col("ref_y") - F.col("y"), "dt": F.col("ref_ts") - F.col("ts")})
    if time_cut is not None:
        near = F.abs("dt")
        joined = joined.filter(near <= time_cut if inclusive else near < time_cut)
    return joined


def tick_differences(pairs_: DataFrame, period: float = 25.0) -> DataFrame:
    return pairs_.groupBy("detector", coords.ticks(F.col("dt"), period).alias("ticks")).agg(F.count("*").alias("n"))


def shifts(pairs_: DataFrame, method: str = "mean", bins: int = 1000, reach: float = 10.0, damping: float = 1.0, fixed: tuple[str, ...] = ()) -> DataFrame:
    """detector, shift_x, shift_y: by the mean, the fullest bin, or the parabola through it; fixed ones are left out."""
    moved = pairs_.filter(~F.col("detector").isin(list(fixed))) if fixed else pairs_

    def one(c: str) -> DataFrame:
        if method == "mean":
            return hist.stats_1d(moved, c, -reach, reach, ("detector",)).select("detector", (F.col("mean") * damping).alias(f"shift_{c[1]}"))
        b = hist.bins_1d(moved, c, bins, -reach, reach, ("detector",))
        if method == "maximum":
            return hist.mode(b, bins, -reach, reach, ("detector",)).select("detector", (F.col("mode") * damping).alias(f"shift_{c[1]}"))
        return hist.parabolic_peak(b, bins, -reach, reach, ("detector",)).select("detector", (F.col("peak") * damping).alias(f"shift_{c[1]}"))

    return one("dx").join(one("dy"), "detector", "full")
