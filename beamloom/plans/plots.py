"""Which plots each stage fills: names, bins and ranges, and the columns they are filled from.

Bins and ranges are fixed values of the analysis. A function per stage gives the sets (rows, places, plots) that
`filled` turns into one table of entries; per-die, per-channel and per-fraction versions are further places of the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords
from beamloom.operators.plots import Plot, bins, by_die, entries, graph, places, stats

Set = tuple[DataFrame, Column, list[Plot]]

DIM = ("detector", "n_cols", "n_rows", "pitch_x", "pitch_y", "size_x", "size_y", "res_x", "res_y")


def with_dim(df: DataFrame, detectors: DataFrame) -> DataFrame:
    places_ = [F.col(f"p{a}").alias(f"at_{a}") for a in "xy"]
    return df.join(F.broadcast(detectors.select(*DIM, *places_)), "detector")  # one row a detector


def _pixels(name: str, x="col", y="row", weight=1.0) -> Plot:
    n, m = F.col("n_cols"), F.col("n_rows")
    return Plot(name, x, n, F.lit(-0.5), n - 0.5, y, m, F.lit(-0.5), m - 0.5, weight)


def mask_creator(occupancy: DataFrame, masked: DataFrame, detectors: DataFrame, density: DataFrame | None = None) -> list[Set]:
    """occupancy: detector, col, row, n. density: the same with mean and significance."""
    at = places(F.col("detector"))
    out = [(with_dim(occupancy, detectors), at, [_pixels("occupancy", weight="n")]), (with_dim(masked, detectors), at, [_pixels("maskmap")])]
    if density is not None:
        out.append((with_dim(density, detectors), at, [_pixels("density", weight="mean"), _pixels("local_significance", weight=F.coalesce("significance", F.lit(0.0)))]))
    return out


def clustering(clusters: DataFrame, multiplicity: DataFrame, detectors: DataFrame) -> list[Set]:
    """clusters: detector, col, row, x, y (global), size, seed_charge, charge, widths, ts. multiplicity: detector, clusters, events."""
    half_x, half_y = F.col("size_x"), F.col("size_y")
    plots = [
        Plot("clusterSize", "size", 100, -0.5, 99.5), Plot("clusterSeedCharge", "seed_charge", 256, -0.5, 255.5), Plot("clusterCharge", "charge", 5000, -0.5, 49999.5),
        Plot("clusterWidthRow", "width_row", 25, -0.5, 24.5), Plot("clusterWidthColumn", "width_col", 100, -0.5, 99.5), Plot("clusterTimes", "ts", 10000, 0, 100),
        Plot("clusterUncertaintyX", F.col("res_x") * 1000, 100, 0, F.col("pitch_x") * 1000), Plot("clusterUncertaintyY", F.col("res_y") * 1000, 100, 0, F.col("pitch_y") * 1000),
        _pixels("clusterPositionLocal"), Plot("clusterPositionGlobal", "x", 400, F.col("at_x") - half_x, F.col("at_x") + half_x, "y", 400, F.col("at_y") - half_y, F.col("at_y") + half_y),
    ]
    at = places(F.col("detector"))
    return [(with_dim(clusters, detectors), at, plots), (multiplicity, at, [Plot("clusterMultiplicity", "clusters", 50, -0.5, 49.5, weight="events")])]


def _against(name: str, x: str, y: str, mine: str, ref: str) -> Plot:
    return Plot(name, x, F.col(mine), F.lit(-0.5), F.col(mine) - 0.5, y, F.col(ref), F.lit(-0.5), F.col(ref) - 0.5)


def correlations(hits: DataFrame, clusters: DataFrame, pixel_pairs: DataFrame, cluster_pairs: DataFrame, detectors: DataFrame, reference: str, time_bins: tuple[int, float, float] = (1000, -1e6, 1e6)) -> list[Set]:
    """Pairs: detector, col, row, x, y, dx, dy, dt and the reference's ref_col, ref_row, ref_x, ref_y."""
    at = places(F.col("detector"))
    ref = F.broadcast(detectors.filter(F.col("detector") == reference).select(F.col("n_cols").alias("ref_cols"), F.col("n_rows").alias("ref_rows")))  # one row
    dim = lambda df: with_dim(df, detectors).crossJoin(ref)
    line = [Plot(f"correlation{n}", e, 1000, -10.01, 9.99) for n, e in (("X", "dx"), ("Y", "dy"), ("XY", F.col("ref_y") - F.col("x")), ("YX", F.col("ref_x") - F.col("y")))]
    maps = [Plot(f"correlation{n}_2D", a, 100, -10.1, 9.9, b, 100, -10.1, 9.9) for n, a, b in (("X", "x", "ref_x"), ("Y", "y", "ref_y"), ("XY", "ref_y", "x"), ("YX", "ref_x", "y"))]
    times = [Plot("correlationTime", "dt", *time_bins), Plot("correlationTimeInt", coords.ticks(F.col("dt")), 8000, -40005, 39995)]
    local = [_against("correlationX_2Dlocal", "col", "ref_col", "n_cols", "ref_cols"), _against("correlationY_2Dlocal", "row", "ref_row", "n_rows", "ref_rows")]
    px = [
        _against("correlationColCol_px", "col", "ref_col", "n_cols", "ref_cols"), _against("correlationRowRow_px", "row", "ref_row", "n_rows", "ref_rows"),
        _against("correlationColRow_px", "col", "ref_row", "n_cols", "ref_rows"), _against("correlationRowCol_px", "row", "ref_col", "n_rows", "ref_cols"), Plot("correlationTime_px", "dt", *time_bins),
    ]
    return [
        (with_dim(hits, detectors), at, [_pixels("hitmap"), Plot("eventTimes", F.col("ts") * 1e-9, 3_000_000, -1e-5, 300 - 1e-5)]), (with_dim(clusters, detectors), at, [_pixels("hitmap_clusters")]),
        (dim(cluster_pairs), at, [*line, *times, *local, *maps]), (dim(pixel_pairs), at, px),
    ]


def prealignment(pairs: DataFrame, detectors: DataFrame, reference: str, reach: float = 10.0) -> list[Set]:
    ref = F.broadcast(detectors.filter(F.col("detector") == reference).select(F.col("n_cols").alias("ref_cols"), F.col("n_rows").alias("ref_rows")))  # one row
    plots = [Plot(f"correlation{a.upper()}", "d" + a, 1000, -reach, reach) for a in "xy"] + [Plot(f"correlation{a.upper()}_2D", a, 100, -reach, reach, "ref_" + a, 100, -reach, reach) for a in "xy"]
    plots += [_against("correlationX_2Dlocal", "col", "ref_col", "n_cols", "ref_cols"), _against("correlationY_2Dlocal", "row", "ref_row", "n_rows", "ref_rows")]
    return [(with_dim(pairs, detectors).crossJoin(ref), places(F.col("detector")), plots)]


def prealignment_dut(tracks: DataFrame, duts: dict[str, float]) -> list[Set]:
    """duts: z by name."""
    plots = [Plot(f"intercept_{a}_{name}", F.col("c" + a) + F.col("m" + a) * z, 500, -10.0, 10.0) for name, z in duts.items() for a in "xy"]
    return [(tracks, places(F.lit("")), plots)] if plots else []


def tracking(tracks: DataFrame, per_event: DataFrame, residuals: DataFrame, intercepts: DataFrame, detectors: DataFrame, isolation: DataFrame | None = None) -> list[Set]:
    """tracks: chi2, chi2ndof, n, angles, ts. residuals: detector, x, y, res_*, pull_*, widths. intercepts: detector, col, row, ix, iy."""
    whole = places(F.lit(""))
    out = [
        (tracks, whole, [Plot("track_chi2", "chi2", 300, 0, 150), Plot("track_chi2ndof", "chi2ndof", 500, 0, 50), Plot("clusters_per_track", "n", 10, -0.5, 9.5),
            *[Plot(f"track_angle_{a}", f"angle_{a}", 2000, -0.01, 0.01) for a in "xy"], Plot("tracks_vs_time", F.col("ts") / 1e9, 3_000_000, 0, 3000)]),
        (per_event, whole, [Plot("tracks_per_event", "tracks", 100, -0.5, 99.5)]),
    ]
    reach = {a: 3 * F.col(f"pitch_{a}") for a in "xy"}
    plots = [Plot(f"residual_{a}_{f}", f"res_{a}_{f}", 500, -reach[a], reach[a]) for f in ("global", "local") for a in "xy"] + [Plot("residual_z_global", "res_z_global", 500, -0.1, 0.1)]
    plots += [Plot(f"residual_{a}_vs_position_{b}_global", f"res_{a}_global", 500, -reach[a], reach[a], b, 400, -10.0, 10.0) for a in "xy" for b in "xy"]
    plots += [Plot(f"residual_{a}_{f}_width{w}", F.when(F.col(c) == w, F.col(f"res_{a}_{f}")), 500, -reach[a], reach[a]) for a, c in (("x", "width_col"), ("y", "width_row")) for f in ("local", "global") for w in (1, 2, 3)]
    plots += [Plot(f"pull_{a}_{f}", f"pull_{a}_{f}", 500, -5, 5) for a in "xy" for f in ("local", "global")]
    at = places(F.col("detector"))
    out.append((with_dim(residuals, detectors), at, plots))
    n, m = F.col("n_cols"), F.col("n_rows")
    out.append((with_dim(intercepts, detectors), at, [Plot("local_intersect", "col", n, 0, n, "row", m, 0, m), Plot("global_intersect", "ix", 600, -30, 30, "iy", 600, -30, 30)]))
    if isolation is not None:
        out.append((isolation, at, [Plot("isolation_distance", F.col("distance") * 1000, 500, 0, 5000)]))
    return out


#: Values of a pulse: name, column, bins and range, for the raw, the processed and the selected pulses.
PULSE = {
    "raw": [
        ("raw_snr", "snr", 500, 0, 5000), ("raw_amplitude", "amplitude", 500, 0, 1.2), ("raw_rise_time", "rise_time", 500, 0, 50), ("raw_baseline", "baseline", 500, -1.2, 1.2), ("raw_noise", "noise", 500, 0, 0.05),
        ("raw_signal_start_time", "start_time", 500, 0, 500), ("raw_integral", "integral", 500, 0, 50), ("raw_time_over_threshold", "time_over_threshold", 500, 0, 50), ("raw_time_over_noise", "time_over_noise", 500, 0, 200),
    ],
    "processed": [
        ("snr", "snr", 400, 0, 400), ("amplitude", "amplitude", 500, 0, 1.2), ("rise_time", "rise_time", 500, 0, 50), ("baseline", "baseline", 500, -1.2, 1.2), ("noise", "noise", 500, 0, 0.05),
        ("start_time", "start_time", 500, 0, 500), ("integral", "integral", 500, 0, 50), ("time_over_threshold", "time_over_threshold", 500, 0, 50), ("time_over_noise", "time_over_noise", 500, 0, 200),
    ],
    "selected": [
        ("snr", "snr", 500, 0, 200), ("amplitude", "amplitude", 500, 0, 1.2), ("rise_time", "rise_time", 200, 0, 5), ("baseline", "baseline", 500, -0.1, 0.1), ("noise", "noise", 500, 0, 0.05),
        ("start_time", "start_time", 500, 0, 500), ("integral", "integral", 500, 0, 50), ("time_over_threshold", "time_over_threshold", 500, 0, 50), ("time_over_noise", "time_over_noise", 500, 0, 200),
    ],
}


def _pulse(kind: str) -> list[Plot]:
    return [Plot(*p) for p in PULSE[kind]]


def _channels(waveforms: DataFrame, detectors: DataFrame) -> DataFrame:
    linear = coords.linear_channel(F.col("col"), F.col("row"), F.col("n_cols"))
    return with_dim(waveforms, detectors).withColumn("__channel", F.concat_ws("/", "detector", F.concat(F.lit("channel_"), linear.cast("string"))))


def waveform_processing(features: DataFrame, valid: DataFrame, detectors: DataFrame) -> list[Set]:
    """All pulses that were measured, and the valid ones at each fraction: in total, by detector and by channel."""
    first = F.get("start_time_cfd", F.lit(0))["t"]
    each = _channels(valid, detectors).withColumn("__p", F.explode("start_time_cfd")).withColumn("start_time", F.col("__p.t"))
    cfd = F.format_string("cfd_%.2f", F.col("__p.cfd"))
    at = places(F.concat_ws("/", cfd, F.lit("total")), F.concat_ws("/", cfd, "detector", F.lit("total")), F.concat_ws("/", cfd, "__channel"))
    return [(features.filter("peak IS NOT NULL").withColumn("start_time", first), places(F.lit("")), _pulse("raw")), (each, at, _pulse("processed"))]


def waveform_selector(selected: DataFrame, detectors: DataFrame, cfd: float = 0.5) -> list[Set]:
    start = coords.start_time_at(F.col("start_time_cfd"), cfd, F.get("start_time_cfd", F.lit(0))["t"])
    at = places("total", F.concat_ws("/", "detector", F.lit("total")), F.col("__channel"))
    return [(_channels(selected, detectors).withColumn("start_time", start), at, _pulse("selected"))]


def dut_association(pairs: DataFrame, counts: DataFrame, predicted: DataFrame, detectors: DataFrame) -> list[Set]:
    """pairs: examined tracks and clusters (detector, die, reason, px, py, x, y local, and global places); counts: associations a track."""
    at = by_die(F.col("detector"), F.col("die"))
    p = F.col("pitch_x")
    d = {"x": F.col("px") - F.col("x"), "y": F.col("py") - F.col("y")}
    near = lambda name, reach, keep=None, gx=d["x"], gy=d["y"]: Plot(name, gx if keep is None else F.when(keep, gx), 500, -reach, reach, gy, 500, -reach, reach)
    yes = F.col("reason") == 0
    g = (F.col("gx") - F.col("cluster_gx"), F.col("gy") - F.col("cluster_gy"))
    wide = lambda a: 1.1 * F.col(f"size_{a}")
    plots = [
        Plot("hDistXClusterClosestPx", F.col("centre_minus_nearest_x") * 1000, 2000, -1000, 1000), Plot("hDistYClusterClosestPx", F.col("centre_minus_nearest_y") * 1000, 2000, -1000, 1000),
        Plot("hCutHisto", F.when(F.col("reason") > 0, F.col("reason")), 2, 1, 3), near("hDist_trackCluster_2D", p), near("hDist_trackCluster_2D_huge", 5 * p), near("hDist_trackCluster_2D_huge_globL", 5 * p, None, *g),
        near("hDist_trackCluster_2D_assoc", p, yes), near("hDist_trackCluster_2D_assoc_global", p, yes, *g),
        Plot("hClusterPosAssoc2D", F.when(yes, F.col("cluster_gx")), 600, -wide("x"), wide("x"), "cluster_gy", 600, -wide("y"), wide("y")),
        Plot("hTrackPosAssoc2D", F.when(yes, F.col("gx")), 600, -10, 10, "gy", 600, -10, 10),
    ]
    none = predicted.join(pairs.filter("reason = 0").select("event_id", "track_id", "detector").distinct(), ["event_id", "track_id", "detector"], "left_anti")
    return [
        (with_dim(pairs, detectors), at, plots), (counts.filter("seen"), at, [Plot("no_assoc_cls", "n", 10, -0.5, 9.5)]),
        (none, at, [Plot("hTrackPosNoAssoc2D", "gx", 600, -10, 10, "gy", 600, -10, 10)]),
    ]


def analysis_efficiency(closest: DataFrame, fakes: DataFrame, fake_pixels: DataFrame, fake_events: DataFrame, detectors: DataFrame, charge_bins: int = 1000, charge_range: float = 5.0) -> list[Set]:
    """closest: detector, die, dx, dy of the nearest associated cluster; fakes: clusters; fake_events: clusters and pixels of each event looked at."""
    at = by_die(F.col("detector"), F.col("die"))
    reach = F.sqrt(F.col("pitch_x") * F.col("pitch_y"))
    distance = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    pitch = lambda a: 1.5 * F.col(f"pitch_{a}")
    return [
        (with_dim(closest, detectors), at, [Plot("distanceTrackHit", distance, F.greatest(F.lit(1), reach.cast("int")), 0, reach), Plot("distanceTrackHit2D", "dx", 150, -pitch("x"), pitch("x"), "dy", 150, -pitch("y"), pitch("y"))]),
        (fakes, at, [Plot("hFakeClusterCharge", "charge", charge_bins, 0, charge_range), Plot("hFakeClusterSize", "size", 25, -0.5, 24.5)]),
        (fake_pixels, at, [Plot("hFakePixelCharge", "charge", charge_bins, 0, charge_range)]),
        (fake_events, at, [Plot("hFakePixelPerEvent", "pixels", 25, -0.5, 24.5), Plot("hFakeClusterPerEvent", "clusters", 25, -0.5, 24.5)]),
    ]


def analysis_timing(hits: DataFrame, pairs: DataFrame, cluster_counts: DataFrame, pair_counts: DataFrame) -> list[Set]:
    """hits: detector, die, charge, ts; pairs: first, second, their dies, dt, charge_first; counts: of clusters and pairs a track."""
    label = lambda d, die: F.when((die.isNotNull()) & (die != ""), F.concat_ws("_", d, die)).otherwise(d)
    a, b = label(F.col("first"), F.col("die_first")), label(F.col("second"), F.col("die_second"))
    whole, split = F.concat_ws("_vs_", "first", "second"), F.concat_ws("_vs_", a, b)
    pair = places(whole, F.when(split != whole, split))
    return [
        (hits, F.array_distinct(places(F.col("detector"), label(F.col("detector"), F.col("die")))), [Plot("charge_toa", "charge", 500, 0, 1.2, "ts", 1000, 0, 1e13)]),
        (pairs, pair, [Plot("dtoa", "dt", 10000, -5.0, 5.0), Plot("timewalk", "charge_first", 100, 0, 1.2, "dt", 100, -5.0, 5.0)]),
        (cluster_counts, places(F.col("detector")), [Plot("ncat", "clusters", 10, -0.5, 9.5, weight="tracks")]), (pair_counts, places(F.col("first")), [Plot("npairs", "pairs", 10, -0.5, 9.5, weight="tracks")]),
    ]


def alignment_dut(matched: DataFrame, detector: str, centre: tuple[float, float], size: tuple[float, float], bins: tuple[int, int]) -> list[Set]:
    """matched: gx, gy (global) and u, v (local) of the tracks that enter the fit."""
    (cx, cy), (sx, sy) = centre, size
    return [(matched, places(detector), [
        Plot("xy_translation_matched_x", "gx", 200, cx - sx, cx + sx), Plot("xy_translation_matched_y", "gy", 200, cy - sy, cy + sy), Plot("xy_translation_matched_2D", "gx", 200, cx - sx, cx + sx, "gy", 200, cy - sy, cy + sy),
        Plot("z_rotation_track_density_local", "u", bins[0], -0.7 * sx, 0.7 * sx, "v", bins[1], -0.7 * sy, 0.7 * sy),
    ])]


def rotation_graphs(spark, detector: str, nominal, measured, steps: list[float]) -> DataFrame:
    """Trusted pixels as designed and as measured, and the whole correction after each step in degrees."""
    rows = [("z_rotation_nominal_pixels", float(x), float(y)) for x, y in nominal] + [("z_rotation_measured_pixels", float(x), float(y)) for x, y in measured]
    total = 0.0
    for i, s in enumerate(steps, 1):
        total += s
        rows.append(("z_rotation_convergence", float(i), total * 57.29577951308232))
    df = spark.createDataFrame(rows, "graph string, x double, y double")
    return df.select(F.lit(detector).alias("path"), "graph", "x", "y")


def efficiency_graph(by_event: DataFrame, detector: str) -> DataFrame:
    return graph(by_event, detector, "efficiency_vs_event", "event_id", "ratio")


def _failure(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e)[:200]}"


def sound(sets: list[Set]) -> tuple[list[Set], dict[str, str]]:
    """The sets without the plots that Spark can't analyse, and what is wrong with those, by plot. Nothing is run."""

    def wrong(df: DataFrame, at: Column, plots: list[Plot]) -> str:
        try:
            entries(df, at, plots)
        except Exception as e:  # noqa: BLE001 - any failure of one plot is reported, not raised
            return _failure(e)
        return ""

    good, bad = [], {}
    for df, at, plots in sets:
        left = plots
        if wrong(df, at, plots):
            found = {p.name: wrong(df, at, [p]) for p in plots}
            bad |= {n: w for n, w in found.items() if w}
            left = [p for p in plots if not found[p.name]]
        good += [(df, at, left)] if left else []
    return good, bad


def written(sets: list[Set], folder: str, stage: str) -> dict[str, str]:
    """Writes contents and statistics of a stage's plots, all in one pass; where that fails, plot by plot, so that a bad one leaves the others
    written. Returns what is wrong, by `stage/plot`."""

    def write(some: list[Set], mode: str) -> None:
        found = filled(some)
        for name, make in (("hist_bins", bins), ("hist_stats", stats)):
            make(found).write.mode(mode).parquet(f"{folder}/{name}/stage={stage}")

    sets, bad = sound(sets)
    try:
        if sets:
            write(sets, "overwrite")
    except Exception:  # noqa: BLE001 - found again below, with the plot it belongs to
        mode = "overwrite"
        for name in dict.fromkeys(p.name for _, _, plots in sets for p in plots):
            try:
                write([(df, at, own) for df, at, plots in sets if (own := [p for p in plots if p.name == name])], mode)
                mode = "append"
            except Exception as e:  # noqa: BLE001
                bad[name] = _failure(e)
    return {f"{stage}/{n}": w for n, w in bad.items()}


def filled(sets: list[Set]) -> DataFrame:
    """The entries of all sets."""
    parts: list[DataFrame] = [entries(*s) for s in sets]
    united: Callable = lambda a, b: a.unionByName(b)
    return reduce(united, parts)
