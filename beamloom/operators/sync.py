"""Loss of synchronisation between a detector and the tracks: when it starts, by how many events, and its repair.

Ordered values run over blocks of event ids: a window inside each block, and one over a row a block, whose sums
and minima are put together. So a detector with most rows is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamloom.functions import scan

#: Event ids of a block.
BLOCK = 4096


def passing(waveforms: DataFrame, cfd: float = 0.7, **bounds: tuple[float, float]) -> DataFrame:
    """Waveforms inside inclusive bounds on snr, amplitude, noise, rise_time, integral and the start time at a fraction; a fraction
    that was not saved is an error."""
    start = F.get(F.filter("start_time_cfd", lambda p: F.abs(p["cfd"] - cfd) < 1e-9), F.lit(0))["t"]
    known = F.when(F.col("start_time_cfd").isNotNull() & start.isNull(), F.raise_error(F.lit(f"no start times at fraction {cfd}"))).otherwise(start)
    cut: Column = F.lit(True)
    for name, (low, high) in bounds.items():
        cut &= (known if name == "start_time" else F.col(name)).between(low, high)
    return waveforms.filter(cut)


def flagged(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """tracks with `passed`: the event has a hit."""
    events = hits.select("event_id").distinct().withColumn("passed", F.lit(1))
    return tracks.join(events, "event_id", "left").withColumn("passed", F.coalesce("passed", F.lit(0)))


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("event_id") / BLOCK))


def numbered(df: DataFrame, by: str, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """df with n, the row's number (from 1) in its detector, ordered by event id first."""
    return scan.running(df, (by,), order, {"n": ("sum", F.lit(1))}, block=BLOCK)


def baseline_rows(rows: int) -> int:
    """How many first rows give the baseline: a fifth of them, 5000 at most."""
    return min(5000, max(rows // 5, 1))


def cusum(df: DataFrame, by: str, baseline_rows: int, slack: float) -> DataFrame:
    """numbered rows with c, the one-sided cumulative sum of (baseline - passed - slack), not below 0.

    In closed form: with the running sum s and its running minimum, c = s - min(0, min s). Both are put together from the
    blocks before a row and the rows of its own block.
    """
    base = df.filter(F.col("n") <= baseline_rows).groupBy(by).agg(F.avg("passed").alias("baseline"))
    rows = _blocked(df).join(base, by).withColumn("step", F.col("baseline") - F.col("passed") - slack)
    inside = Window.partitionBy(by, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("step").over(inside)).withColumn("low", F.min("own").over(inside))
    blocks = rows.groupBy(by, "block").agg(F.sum("step").alias("t"), F.min("own").alias("m"))
    earlier = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("s", F.coalesce(F.sum("t").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("least", F.coalesce(F.min(F.col("s") + F.col("m")).over(earlier), F.lit(0.0))).select(by, "block", "s", "least")
    run = rows.join(blocks, [by, "block"])
    floor = F.least(F.lit(0.0), F.col("least"), F.col("s") + F.col("low"))
    return run.withColumn("c", F.col("s") + F.col("own") - floor).drop("block", "step", "own", "low", "s", "least")


def onsets(run: DataFrame, by: str, threshold: float) -> DataFrame:
    """by, n, event_id of the first row over the threshold; detectors that never cross it have none."""
    return run.filter(F.col("c") > threshold).groupBy(by).agg(F.min_by(F.struct("n", "event_id"), "n").alias("f")).select(by, "f.n", "f.event_id")


def shared_onset(first: DataFrame) -> DataFrame:
    """The latest of the detectors' onsets."""
    return first.agg(F.max("event_id").alias("onset"))


def shift_scan(tracks: DataFrame, hits: DataFrame, band: int, window: int) -> DataFrame:
    """block, shift, n: for each window of so many tracks, how many have a hit at event_id + shift.

    Tracks are numbered by event in blocks: a total for each block of events gives each block's first number, so no window
    has all rows.
    """
    per = _blocked(tracks.groupBy("event_id").agg(F.count("*").alias("k"))).withColumnRenamed("block", "b")
    totals = per.groupBy("b").agg(F.sum("k").alias("t"))
    before = totals.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t0"))
    at = Window.partitionBy("b").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    first = per.join(before, "b").withColumn("first", F.col("t0") + F.coalesce(F.sum("k").over(at), F.lit(0)))
    # an event's tracks are a row for each window they fall into, with their number; shifts multiply these rows, not the tracks
    low, end = F.col("first"), F.col("first") + F.col("k")
    rows = first.withColumn("block", F.explode(F.sequence(F.floor(low / window), F.floor((end - 1) / window))))
    rows = rows.select("event_id", "block", (F.least(end, (F.col("block") + 1) * window) - F.greatest(low, F.col("block") * window)).alias("n"))
    shifted = rows.withColumn("shift", F.explode(F.sequence(F.lit(-band), F.lit(band)))).withColumn("at", F.col("event_id") + F.col("shift"))
    return shifted.join(hits.select(F.col("event_id").alias("at")).distinct(), "at", "left_semi").groupBy("block", "shift").agg(F.sum("n").alias("n"))


def walk_shifts(scan: DataFrame, start: int = 0, band: int = 3) -> Iterator[tuple[int, int]]:
    """(block, best shift) with a band that is centred anew on each block's best; the first of equal shifts wins.

    Each step depends on the one before, so blocks come to the driver one after the other (one row a block, its counts
    in a map); none but the present one is held.
    """
    rows = scan.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("shift", "n"))).alias("counts")).orderBy("block")
    centre = start
    for r in rows.toLocalIterator():
        near = [(r["counts"].get(s, 0), -s) for s in range(centre - band, centre + band + 1)]
        centre = -max(near)[1]
        yield r["block"], centre


def segments(spark: SparkSession, tracks: DataFrame, walked: Iterator[tuple[int, int]], window: int, onset: int) -> DataFrame:
    """first, last, shift: the event ranges of runs of blocks with one shift that is not 0, from the onset on. The range of a block
    is that of its tracks."""
    runs: list[list[int]] = []
    for block, shift in walked:
        if runs and runs[-1][2] == shift and runs[-1][1] == block - 1:
            runs[-1][1] = block
        else:
            runs.append([block, block, shift])
    rows = numbered(tracks.select("event_id").withColumn("__all", F.lit(0)), "__all").withColumn("block", F.floor((F.col("n") - 1) / window))
    ranges = rows.groupBy("block").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    table = spark.createDataFrame([tuple(r) for r in runs if r[2]], "a long, b long, shift long")
    spans = table.select("a", "b", "shift", F.explode(F.sequence("a", "b")).alias("block")).join(ranges, "block").groupBy("a", "b", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("last"))
    return spans.select(F.greatest("lo", F.lit(onset)).alias("first"), "last", "shift").filter("first <= last")


def apply_shifts(df: DataFrame, segments: DataFrame, block: int = 1 << 16) -> DataFrame:
    """event_id minus the shift of the segment [first, last] it falls into; a negative result is an error. Segments are disjoint.

    Rows and segments meet on blocks of event ids, so a run of many segments is no product of rows and segments.
    """
    s = segments.select(F.col("first").alias("__a"), F.col("last").alias("__b"), F.col("shift").alias("__s"))
    s = s.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__a") / block), F.floor(F.col("__b") / block))))
    inside = F.col("event_id").between(F.col("__a"), F.col("__b"))
    moved = df.withColumn("__at", F.floor(F.col("event_id") / block)).join(s, (F.col("__at") == F.col("__block")) & inside, "left")
    new = F.col("event_id") - F.coalesce("__s", F.lit(0))
    checked = F.when(new < 0, F.raise_error(F.lit("a shifted event id is negative"))).otherwise(new)
    return moved.withColumn("event_id", checked.cast("long")).drop("__a", "__b", "__s", "__at", "__block")


def write_shifted(waveforms: DataFrame, segments: DataFrame, detectors: list[str], source: str, target: str, in_place: bool = False) -> None:
    """waveforms (by detector) with the shifts applied to some detectors, written beside the target and renamed onto it at the end. What was
    there goes aside before and away after that, so a failure leaves it under one of the two names. A target that is the source needs `in_place`; no segments are an error."""
    spark = waveforms.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.makeQualified(path(source)).equals(fs.makeQualified(path(target))) and not in_place:
        raise ValueError("the target is the source; say in_place")
    if segments.isEmpty():
        raise ValueError("no segments to apply")
    hit = F.col("detector").isin(detectors)
    done = apply_shifts(waveforms.filter(hit), segments).unionByName(waveforms.filter(~hit))
    partial = f"{target}.partial"
    done.write.mode("overwrite").partitionBy("detector").parquet(partial)
    aside = f"{target}.before"
    if fs.exists(path(target)):
        fs.delete(path(aside), True)
        if not fs.rename(path(target), path(aside)):
            raise OSError(f"could not move {target} to {aside}")
    if not fs.rename(path(partial), path(target)):
        raise OSError(f"could not move {partial} to {target}")
    fs.delete(path(aside), True)
