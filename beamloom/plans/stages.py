"""The operators as configurable stages, each from tables to tables (see plans.config).

`geometry` is the list of detectors, `detectors`, `dies` and `masked` are its tables; a stage that changes the
geometry renews them. Clusters and tracks have ids that are unique in their event, so every join on them joins on the
event too. Plots are entries by stage (`plots`), points of graphs by stage (`graphs`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.functions import coords
from beamloom.operators import align, assoc, cluster, correlate, efficiency, masks, sync, timing, track, waveform
from beamloom.plans import plots
from beamloom.plans.config import Block, Tables, stage
from beamloom.sources import geometry, store
from beamloom.sources import hits as hit_sources
from beamloom.sources.geometry import Detector

TRACK = ["event_id", "track_id"]


def _spark(t: Tables) -> SparkSession:
    return t["detectors"].sparkSession


def with_geometry(t: Tables, spark: SparkSession, found: list[Detector]) -> Tables:
    """The tables of a geometry: detectors, dies, and masked pixels of the mask files (if none are there yet)."""
    out = t | {"geometry": found, "detectors": geometry.table(spark, found), "dies": geometry.die_table(spark, found)}
    if "masked" not in t:
        parts = [masks.read_text(spark, d.mask_file, d.name) for d in found if d.mask_file]
        none = spark.createDataFrame([], "detector string, col int, row int")
        out["masked"] = reduce(DataFrame.unionByName, parts, none)
    return out


def _plotted(t: Tables, b: Block, sets: list) -> Tables:
    if not sets:
        return t
    old = t.get("plots", {})
    return t | {"plots": old | {b.kind: [*old.get(b.kind, []), *sets]}}


def _graphed(t: Tables, b: Block, points: DataFrame) -> Tables:
    old = t.get("graphs", {})
    return t | {"graphs": old | {b.kind: old[b.kind].unionByName(points) if b.kind in old else points}}


def _live(t: Tables, b: Block) -> list[Detector]:
    """Pixel detectors that are not excluded by name or type."""
    out = b.texts("exclude_detectors")
    return [d for d in t["geometry"] if d.is_pixel() and d.name not in out and d.kind not in out]


# ---- sources


@stage("EventLoader")
@stage("EventLoaderHDF5")
def event_loader(t: Tables, b: Block) -> Tables:
    """Raw hits of `file_name` (or the table raw_hits) -> hits, traces, and a report of what was not loaded."""
    caps = [int(c) for c in b.list("number_of_events")] or None
    raw = hit_sources.scan(_spark(t), b.texts("file_name"), caps) if b.texts("file_name") else t["raw_hits"]
    raw = hit_sources.normalised(hit_sources.raw_identity(raw), ("channel", "has_waveform"))
    routes = hit_sources.route_table(_spark(t), t["geometry"], b.text("type"), tuple(b.texts("exclude_detectors")))
    hits, traces = hit_sources.load(raw, routes, t["masked"])
    out = t | {"discarded": hit_sources.discarded(raw, routes)}
    out["hits"] = t["hits"].unionByName(hits) if "hits" in t else hits
    if b.flag("load_waveforms", True) and "samples" in traces.columns:
        out["traces"] = t["traces"].unionByName(traces, allowMissingColumns=True) if "traces" in t else traces
    return out


@stage("Reader")
def reader(t: Tables, b: Block) -> Tables:
    """Saved runs in `filenames` -> tracks, track_cluster_links, clusters, waveforms. Several readers are united."""
    found = hit_sources.read_saved(_spark(t), b.texts("filenames"))
    if "clusters" in found:
        found["clusters"] = hit_sources.rehydrated(_globalised(t, found["clusters"]))
    if "tracks" in found:
        found["tracks"] = _missing(found["tracks"], {"ts": 0.0, "isolated": True})
    return t | {n: t[n].unionByName(df, allowMissingColumns=True) if n in t else df for n, df in found.items()}


def _missing(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items() if k not in df.columns})


# ---- masks and clusters


@stage("MaskCreator")
def mask_creator(t: Tables, b: Block) -> Tables:
    """hits, detectors, masked -> masked; with `mask_directory`, the text files mask_<detector>.txt."""
    old = t["masked"]
    density = None
    if b.text("method", "frequency") == "frequency":
        new = masks.frequency_mask(t["hits"], t["detectors"], old, b.number("frequency_cut", 50.0))
    else:
        events = t["hits"].select("event_id").distinct().count()
        bandwidth = int(b.number("density_bandwidth", 10))
        density = masks.local_density(t["hits"], t["detectors"], bandwidth)
        new = masks.density_mask(t["hits"], t["detectors"], old, events, bandwidth, b.number("sigma_above_avg_max", 5.0), b.number("rate_max", 1.0))
    merged = masks.merge(old, new)
    if b.flag("mask_dead_pixels"):
        merged = masks.merge(merged, masks.dead_pixels(t["hits"], t["detectors"], old))
    if folder := b.text("mask_directory"):
        for d in t["geometry"]:  # one small file a detector
            masks.write_text(merged.filter(F.col("detector") == d.name), f"{folder}/mask_{d.name}.txt")
    return _plotted(t | {"masked": merged}, b, plots.mask_creator(masks.occupancy(t["hits"]), merged, t["detectors"], density))


def _globalised(t: Tables, clusters: DataFrame) -> DataFrame:
    """clusters with plane order, place (x, y, z), weight and id."""
    order = {d.name: i for i, d in enumerate(sorted(t["geometry"], key=lambda d: d.position[2]))}
    planes = _spark(t).createDataFrame(list(order.items()), "detector string, plane int")
    j = clusters.drop("x", "y", "z", "w", "plane").join(F.broadcast(t["detectors"].join(planes, "detector")), "detector")  # one row a detector
    gx, gy, gz = coords.to_global(coords.local_x(F.col("col"), F.col("n_cols"), F.col("pitch_x")), coords.local_x(F.col("row"), F.col("n_rows"), F.col("pitch_y")))
    new = {"x": gx, "y": gy, "z": gz, "w": 1 / (F.col("res_x") * F.col("res_x"))}
    if "cluster_id" not in clusters.columns:
        new["cluster_id"] = F.xxhash64("detector", "seed_col", "seed_row")
    kept = [c for c in clusters.columns if c not in ("x", "y", "z", "w", "plane", "cluster_id")]
    return j.withColumns(new).select(*kept, "cluster_id", "plane", "x", "y", "z", "w")


@stage("ClusteringSpatial")
def clustering(t: Tables, b: Block) -> Tables:
    """hits -> clusters with their places, and pixels with their clusters' labels. `type` or `name` renews the clusters of some detectors."""
    h = t["hits"]
    need = b.texts("discard_events_missing_on")
    h = cluster.discard_incomplete(h, need) if need else h
    names = [d.name for d in _live(t, b) if b.text("type") in ("", d.kind)]
    pixels = cluster.last_hits(h.filter(F.col("detector").isin(names)))
    split = any(d.has_die_split() for d in t["geometry"])
    if split:
        pixels = geometry.with_die(pixels, t["dies"])
    labelled = cluster.label(pixels, "die" if split else None)
    labelled = labelled if split else labelled.withColumn("die", F.lit(""))
    labelled = labelled.withColumn("cluster_id", F.xxhash64("detector", "seed_col", "seed_row"))
    new = _globalised(t, cluster.clusters(labelled, b.flag("charge_weighting", True)))
    out = dict(t)
    for name, df in (("pixels", labelled), ("clusters", new)):
        old = t[name].filter(~F.col("detector").isin(names)) if name in t else None
        out[name] = df if old is None else old.unionByName(df, allowMissingColumns=True)
    return _plotted(out, b, plots.clustering(new, cluster.multiplicity(new), t["detectors"]))


@stage("Globalise")
def globalise(t: Tables, b: Block) -> Tables:
    """clusters at the places of the present geometry."""
    return t | {"clusters": _globalised(t, t["clusters"])}


# ---- correlations and prealignment


def _pairs(t: Tables, what: str, reference: str, cut: float | None, inclusive: bool = False, keep_self: bool = True) -> DataFrame:
    """Each thing with the reference's things of its event, and the latter's pixel."""
    things = t[what]
    if what == "hits":
        things = things.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    ref = things.filter(F.col("detector") == reference).select("event_id", *[F.col(c).alias("ref_" + c) for c in ("col", "row", "x", "y", "ts")])
    some = things if keep_self else things.filter(F.col("detector") != reference)
    j = some.join(ref, "event_id").withColumns({"dx": F.col("ref_x") - F.col("x"), "dy": F.col("ref_y") - F.col("y"), "dt": F.col("ref_ts") - F.col("ts")})
    if cut is None:
        return j
    return j.filter(F.abs("dt") <= cut if inclusive else F.abs("dt") < cut)


def _reference(t: Tables, b: Block) -> str:
    return b.text("reference") or next(d.name for d in t["geometry"] if d.role == "reference")


@stage("Correlations")
def correlations(t: Tables, b: Block) -> Tables:
    ref, cut = _reference(t, b), b.number("time_cut_abs", 690_000.0) if b.flag("do_time_cut") else None
    found = _pairs(t, "clusters", ref, cut)
    out = t | {"correlations": found}
    return _plotted(out, b, plots.correlations(t["hits"], t["clusters"], _pairs(t, "hits", ref, cut), found, t["detectors"], ref)) if "hits" in t else out


@stage("Prealignment")
def prealignment(t: Tables, b: Block) -> Tables:
    """clusters -> shifts; detectors other than the reference and the fixed planes are moved by them."""
    ref, reach = _reference(t, b), b.number("range_abs", 10.0)
    fixed = (*b.texts("fixed_planes"), ref)
    p = _pairs(t, "clusters", ref, b.number("time_cut_abs", 1e9), keep_self=False)
    shifts = correlate.shifts(p, b.text("method", "mean"), 1000, reach, b.number("damping_factor", 1.0), tuple(b.texts("fixed_planes")))
    by = {r["detector"]: (r["shift_x"] or 0.0, r["shift_y"] or 0.0) for r in shifts.collect()}  # one row a detector
    moved = [align.with_change(d, ("x", "y"), by[d.name]) if d.name in by and d.name not in fixed else d for d in t["geometry"]]
    out = _regeometry(t | {"shifts": shifts}, b, moved)
    return _plotted(out, b, plots.prealignment(p, t["detectors"], ref, reach))


def _regeometry(t: Tables, b: Block, moved: list[Detector]) -> Tables:
    """The tables of a new geometry, clusters placed anew, and the updated file if one is named."""
    out = with_geometry(t, _spark(t), moved)
    if "clusters" in t:
        out["clusters"] = _globalised(out, t["clusters"])
    if (target := b.text("detectors_file_updated")) and b.text("detectors_file"):
        geometry.write(target, b.text("detectors_file"), moved)
    return out


@stage("PrealignmentDUT")
@stage("PrealignmentCAEN")
def prealignment_dut(t: Tables, b: Block) -> Tables:
    """tracks -> detectors under test moved to the middle of the plateau of track positions."""
    names = b.texts("dut_names")
    moved, found = [], []
    for d in t["geometry"]:
        if d.name in names:
            d, fits = align.prealigned(t["tracks"], d)
            found += [(d.name, a, f.centre, f.width, f.warning) for a, f in fits.items() if f]
        moved.append(d)
    out = _regeometry(t | {"plateaus": _spark(t).createDataFrame(found, "detector string, axis string, centre double, width double, warning string")}, b, moved)
    return _plotted(out, b, plots.prealignment_dut(t["tracks"], {d.name: d.position[2] for d in t["geometry"] if d.name in names}))


# ---- tracks


def _points(t: Tables, links: DataFrame) -> DataFrame:
    """The clusters of tracks, with their place in the detector (u, v)."""
    c = t["clusters"].select("event_id", "cluster_id", "detector", "col", "row", "x", "y", "z", "w", *[n for n in ("width_col", "width_row") if n in t["clusters"].columns])
    return links.select("event_id", "track_id", "cluster_id").join(c, ["event_id", "cluster_id"])


def intercepts(tracks: DataFrame, detectors: DataFrame) -> DataFrame:
    """tracks on each detector: place (gx, gy, gz), place in its plane (u, v) and in pixels (col, row); tracks that miss the plane are left out."""
    j = tracks.crossJoin(F.broadcast(detectors))  # one row a detector, so as many rows as tracks and detectors
    gx, gy, gz = coords.intercept(F.col("mx"), F.col("cx"), F.col("my"), F.col("cy"))
    j = j.withColumns({"gx": gx, "gy": gy, "gz": gz}).filter(~F.isnan("gx") & ~F.isnan("gy") & F.col("gx").isNotNull() & F.col("gy").isNotNull())
    u, v, _ = coords.to_local(F.col("gx"), F.col("gy"), F.col("gz"))
    j = j.withColumns({"u": u, "v": v})
    at = {"col": coords.pixel(F.col("u"), F.col("n_cols"), F.col("pitch_x")), "row": coords.pixel(F.col("v"), F.col("n_rows"), F.col("pitch_y"))}
    return j.withColumns(at).select(*tracks.columns, "detector", "gx", "gy", "gz", "u", "v", "col", "row")


@stage("Tracking4D")
def tracking(t: Tables, b: Block) -> Tables:
    """clusters, detectors -> tracks, links; with `storage_file`, the saved tables, and with `save_excluded`, the clusters of the others."""
    cut = b.list("spatial_cut_abs")
    cx = cut[0] if cut else b.number("spatial_cut_abs_x", 0.1)
    cy = (cut[1] if len(cut) > 1 else cut[0]) if cut else b.number("spatial_cut_abs_y", 0.1)
    some = sorted(_live(t, b), key=lambda d: d.position[2])
    names = [d.name for d in some]
    c = t["clusters"].filter(F.col("detector").isin(names))
    order = {n: i for i, n in enumerate(names)}
    planes = _spark(t).createDataFrame(list(order.items()), "detector string, __plane int")
    c = c.join(F.broadcast(planes), "detector").withColumn("plane", F.col("__plane")).drop("__plane")  # one row a detector
    found = track.follow(c, [(i, d.position[2]) for i, d in enumerate(some)][1:-1], cx, cy, b.number("time_cut_abs", 690_000.0), int(b.number("min_hits_on_track", 5)))
    found = store.stored(found.select("event_id", "members", track.track_number(F.col("members")).alias("track_id"), F.col("a.ts").alias("ts")), "found", {"Tracking4D.followed": F.count(F.lit(1))})
    links = found.select("event_id", "track_id", F.explode("members").alias("cluster_id"))
    points = _points(t, links)
    if any(sum(abs(o) for o in d.orientation) > 1e-9 for d in some):
        fitted = _tilted_fit(points, t["detectors"])
    else:
        fitted = track.fit(points, tuple(TRACK))
    fitted = fitted.withColumn("chi2ndof", track.chi2_ndof(F.col("chi2"), F.col("ndof"))).join(found.select(*TRACK, "ts", "members"), TRACK)
    if b.flag("unique_cluster_usage"):
        fitted = track.dedup(fitted)
    if limit := int(b.number("number_of_tracks")):
        fitted = track.first_tracks(fitted, limit)
    fitted = store.stored(track.angles(fitted.drop("members")), "fitted", {"Tracking4D.kept": F.count(F.lit(1)), "Tracking4D.hits": F.sum("n")})
    isolation = b.number("isolation_cut")
    met = intercepts(fitted, t["detectors"].filter("is_pixel"))
    fitted = fitted.withColumn("isolated", F.lit(True)) if not isolation else _isolated(fitted, met.filter(F.col("detector").isin(names)), isolation)
    links = links.join(fitted.select(*TRACK), TRACK, "left_semi")
    residuals = track.residuals_on(_points(t, links), fitted, t["detectors"])
    out = t | {"tracks": fitted, "track_cluster_links": links, "residuals": residuals}
    if folder := b.text("storage_file"):
        hit_sources.write_saved(folder, fitted.drop("ts", "isolated"), links, c)
        if b.flag("save_excluded"):
            hit_sources.write_unused(folder, t["clusters"], [d.name for d in t["geometry"] if d.name not in names])
    sets = plots.tracking(fitted, track.per_event(fitted, c), residuals, met.withColumnsRenamed({"gx": "ix", "gy": "iy"}), t["detectors"], _closest_track(met) if isolation else None)
    return _plotted(out, b, sets)


def _tilted_fit(points: DataFrame, detectors: DataFrame) -> DataFrame:
    """Fits in the planes' own frames, as some plane is tilted."""
    d = F.broadcast(detectors.drop("kind", "role"))  # one row a detector
    j = points.join(d, "detector")
    names = ["px", "py", "pz", *[f"r{i}{k}" for i in range(3) for k in range(3)]]
    u, v = coords.local_x(F.col("col"), F.col("n_cols"), F.col("pitch_x")), coords.local_x(F.col("row"), F.col("n_rows"), F.col("pitch_y"))
    rows = j.select(F.struct(*TRACK).alias("key"), u.alias("u"), v.alias("v"), (1 / (F.col("res_x") * F.col("res_x"))).alias("wu"), (1 / (F.col("res_y") * F.col("res_y"))).alias("wv"), *names)
    keyed = rows.withColumns({"event_id": F.col("key.event_id"), "track_id": F.col("key.track_id")}).drop("key")
    return track.fit_tilted(keyed, ("event_id", "track_id")).filter("mx IS NOT NULL").withColumn("n", ((F.col("ndof") + 4) / 2).cast("long"))


def _closest_track(met: DataFrame) -> DataFrame:
    a, b = met.alias("a"), met.alias("b")
    same = (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.detector") == F.col("b.detector")) & (F.col("a.track_id") < F.col("b.track_id"))
    d = F.sqrt(F.pow(F.col("a.gx") - F.col("b.gx"), 2) + F.pow(F.col("a.gy") - F.col("b.gy"), 2))
    return a.join(b, same).select(F.col("a.event_id").alias("event_id"), F.col("a.track_id").alias("t1"), F.col("b.track_id").alias("t2"), F.col("a.detector").alias("detector"), d.alias("distance"))


def _isolated(tracks: DataFrame, met: DataFrame, cut: float) -> DataFrame:
    close = track.close_pairs(met, cut, ("event_id", "detector"), "gx", "gy").select("event_id", F.explode(F.array("t1", "t2")).alias("track_id")).distinct().withColumn("__near", F.lit(True))
    return tracks.join(close, TRACK, "left").withColumn("isolated", F.col("__near").isNull()).drop("__near")


# ---- alignment


def _alignment_points(t: Tables, b: Block) -> DataFrame:
    good = t["tracks"].filter(F.col("chi2ndof") <= b.number("max_track_chi2ndof", 30.0)) if b.flag("prune_tracks") else t["tracks"]
    if limit := int(b.number("number_of_tracks")):
        good = track.first_tracks(good, limit)
    p = _points(t, t["track_cluster_links"].join(good.select(*TRACK), TRACK, "left_semi"))
    d = F.broadcast(t["detectors"].select("detector", "n_cols", "n_rows", "pitch_x", "pitch_y"))  # one row a detector
    u, v = coords.local_x(F.col("col"), F.col("n_cols"), F.col("pitch_x")), coords.local_x(F.col("row"), F.col("n_rows"), F.col("pitch_y"))
    return store.stored(p.join(d, "detector").select(*TRACK, "detector", u.alias("u"), v.alias("v")), "points")


def _realigned(t: Tables, b: Block, found: align.Aligned) -> Tables:
    by = {d.name: d for d in found.detectors}
    out = _regeometry(t, b, [by.get(d.name, d) for d in t["geometry"]])
    points = align.graphs(_spark(t), found).withColumn("graph", F.concat(F.lit("alignment_correction_"), "graph")).withColumnRenamed("detector", "path")
    return _graphed(out | {"corrections": align.corrections(_spark(t), found, [d for d in t["geometry"] if d.name in by])}, b, points)


@stage("AlignmentTrackChi2")
def alignment_track_chi2(t: Tables, b: Block) -> Tables:
    dofs = (("x", "y") if b.flag("align_position", True) else ()) + (("rx", "ry", "rz") if b.flag("align_orientation", True) else ())
    some = sorted((d for d in _live(t, b) if b.text("type") in ("", d.kind)), key=lambda d: d.position[2])
    fixed = (*b.texts("fixed_planes"), _reference(t, b))
    return _realigned(t, b, align.track_chi2(_alignment_points(t, b), some, dofs, fixed, int(b.number("iterations", 5))))


@stage("AlignmentMillepede")
def alignment_millepede(t: Tables, b: Block) -> Tables:
    """tracks -> all planes moved at once. Without fixed planes, constraints keep the whole in place."""
    flags = b.list("dofs", (1, 1, 0, 1, 1, 1), bool)
    sigmas = dict(zip(align.DOFS, b.list("sigmas", (0.05, 0.05, 0.5, 0.005, 0.005, 0.005)), strict=True))
    dofs = tuple(k for k, on in zip(align.DOFS, flags, strict=True) if on)
    used = {r["detector"] for r in _points(t, t["track_cluster_links"]).select("detector").distinct().collect()}  # names of detectors
    some = sorted((d for d in _live(t, b) if d.name in used), key=lambda d: d.position[2])
    found = align.millepede(
        _alignment_points(t, b), some, dofs, tuple(b.texts("fixed_planes")), int(b.number("iterations", 3)), 9, b.number("residual_cut_init", 0.6), b.number("residual_cut", 0.1), int(b.number("number_of_stddev")), sigmas,
        b.number("convergence", 1e-5), not b.texts("fixed_planes"),
    )
    return _realigned(t, b, found)


@stage("AlignmentDUT")
@stage("AlignmentCAEN")
def alignment_dut(t: Tables, b: Block) -> Tables:
    """tracks with associations -> detectors under test moved and turned."""
    bins = b.list("efficiency_2D_histograms_bin_size", (0.01,))
    size = (bins[0], bins[1] if len(bins) > 1 else bins[0])
    moved, out = list(t["geometry"]), t
    for d in geometry.bound(t["geometry"], b.values.get("name", ""), b.text("type")):
        matched = store.stored(_judged(t, b, d).filter("place IS NULL AND stage = 'good' AND matched").select(*TRACK, "gx", "gy", "gz", "u", "v"), "matched")
        new, steps, good = align.align_dut(
            matched, d, b.flag("update_xy_translation"), b.flag("update_z_orientation"), int(b.number("z_rotation_iterations", 12)), int(b.number("z_rotation_row")), b.number("min_quadrant_entries", 50.0),
            b.number("max_pixel_centroid_deviation", 0.5), size,
        )
        moved[[x.name for x in moved].index(d.name)] = new
        px, py = align.pixel_centres(d)
        at = [(int(c), int(r)) for c, r in zip(*good.nonzero(), strict=True)]
        _, cx, cy = align.density(matched, new, size).centroids(new)
        out = _graphed(out, b, plots.rotation_graphs(_spark(t), d.name, [(px[c], py[r]) for c, r in at], [(cx[c, r], cy[c, r]) for c, r in at], steps))
        out = _plotted(out, b, plots.alignment_dut(matched, d.name, d.position[:2], d.size(), tuple(max(1, round(1.4 * s / w)) for s, w in zip(d.size(), size, strict=True))))
    return _regeometry(out, b, moved)


# ---- pulses


@stage("WaveformProcessing")
@stage("WaveformProcessingCAEN")
def waveform_processing(t: Tables, b: Block) -> Tables:
    """traces (codes) -> waveforms; with `storage_file` they are saved."""
    keep = tuple(c for c in t["traces"].columns if c not in ("samples", "dc_offset"))
    offset = "dc_offset" if "dc_offset" in t["traces"].columns else None
    f = waveform.process(
        t["traces"], "samples", tuple(b.list("cfd", (0.7,))), b.number("sampling_interval", 0.2), b.number("noise_factor", 1.0), b.number("integral_time", 2.8), keep, int(b.number("signal_polarity", -1)), offset
    )
    lim = lambda n: (b.number(f"min_{n}", 0.0), b.number(f"max_{n}", 1e30))
    good = waveform.valid(f, lim("snr"), lim("start_time"), lim("rise_time"), lim("integral"))
    if folder := b.text("storage_file"):
        hit_sources.write_waveforms(folder, good)
    return _plotted(t | {"waveforms": good}, b, plots.waveform_processing(f, good, t["detectors"]))


@stage("WaveformSelector")
def waveform_selector(t: Tables, b: Block) -> Tables:
    """waveforms -> waveforms inside the bounds, which join the hits as pixels."""
    names = ("snr", "amplitude", "noise", "rise_time", "start_time", "integral", "time_over_threshold", "time_over_noise")
    mine = F.lit(True) if not b.values.get("name") else F.col("detector") == b.text("name")
    kept = waveform.select(t["waveforms"].filter(mine), **{n: (b.number(f"min_{n}", 0.0), b.number(f"max_{n}", 1e30)) for n in names})
    new = waveform.to_pixels(kept, b.number("cfd", 0.5))
    columns = ["event_id", "detector", "col", "row", "channel", "charge", "ts"]
    out = t | {"waveforms": t["waveforms"].filter(~mine).unionByName(kept) if b.values.get("name") else kept, "pulse_hits": new}
    out["hits"] = t["hits"].unionByName(new.select(*columns)) if "hits" in t else new.select(*columns)
    return _plotted(out, b, plots.waveform_selector(kept, t["detectors"], b.number("cfd", 0.5)))


# ---- detectors under test


def _dut_clusters(t: Tables, d: Detector) -> DataFrame:
    """The clusters of a detector in its own plane, with their pixels' places."""
    own = t["clusters"].filter(F.col("detector") == d.name)
    pitch_x, pitch_y = d.effective_pitch()
    lx = lambda c: coords.local_x(c, F.lit(d.n_cols), F.lit(pitch_x))
    ly = lambda c: coords.local_x(c, F.lit(d.n_rows), F.lit(pitch_y))
    place = lambda c, r: F.struct(lx(c).alias("x"), ly(r).alias("y"))
    own = own.withColumns({"cluster_gx": F.col("x"), "cluster_gy": F.col("y"), "x": lx(F.col("col")), "y": ly(F.col("row"))})
    if "pixels" in t:
        px = t["pixels"].filter(F.col("detector") == d.name).groupBy("event_id", "cluster_id").agg(F.collect_list(place(F.col("col"), F.col("row"))).alias("pixels"))
        own = own.drop("pixels").join(px, ["event_id", "cluster_id"])
    else:
        own = own.withColumn("pixels", F.array(place(F.round("col"), F.round("row"))))
    own = geometry.with_die(own, t["dies"])
    return own.drop("plane", "z", "w")


def _predicted(t: Tables, d: Detector) -> DataFrame:
    met = geometry.with_die(intercepts(t["tracks"], t["detectors"].filter(F.col("detector") == d.name)), t["dies"])
    return met.withColumns({"px": F.col("u"), "py": F.col("v")})


@stage("DUTAssociation")
def dut_association(t: Tables, b: Block) -> Tables:
    """tracks, clusters -> associations of the bound detectors, with the reasons of all cuts and the counts by track."""
    cut = b.list("spatial_cut_abs", (1.0, 1.0))
    cuts = (cut[0], cut[1] if len(cut) > 1 else 1.0, b.number("time_cut_abs", 1e30), b.flag("use_cluster_centre"))
    found: dict[str, list[DataFrame]] = {"associations": [], "cut_reasons": [], "association_counts": [], "closest": []}
    sets = []
    for d in geometry.bound(t["geometry"], b.values.get("name", ""), b.text("type")):
        p, c = store.stored(_predicted(t, d), "predicted"), store.stored(_dut_clusters(t, d), "dut-clusters")
        pairs = store.stored(assoc.examined(p, c.drop("detector"), *cuts).withColumn("detector", F.lit(d.name)), "pairs", {f"DUTAssociation.{d.name}.{n}": F.count_if(F.col("reason") == k) for k, n in enumerate(assoc.REASONS)})
        counts = assoc.counts(p, pairs, c).withColumn("detector", F.lit(d.name))
        found["associations"].append(assoc.associated(pairs))
        found["cut_reasons"].append(assoc.reasons(pairs).withColumn("detector", F.lit(d.name)))
        found["association_counts"].append(counts)
        found["closest"].append(assoc.closest(pairs).withColumn("detector", F.lit(d.name)))
        sets += plots.dut_association(pairs.join(p.select(*TRACK, "gx", "gy"), TRACK), counts, p, t["detectors"])
    united = {n: reduce(DataFrame.unionByName, parts) for n, parts in found.items() if parts}
    out = t | {n: t[n].unionByName(df) if n in t else df for n, df in united.items()}
    return _plotted(out, b, sets)


def _judged(t: Tables, b: Block, d: Detector) -> DataFrame:
    """tracks on a detector with the stage of the cut flow that ends them, and whether they are matched: once for the whole (place null) and
    once for each die, from one pass over tracks and associations."""
    p = _predicted(t, d)
    pitch_x, pitch_y = d.effective_pitch()
    gap = d.has_die_split()
    inside = coords.has_intercept(F.col("col"), F.col("v"), F.lit(d.n_cols), F.lit(d.size()[1]), F.lit(d.pitch_y), b.number("spatial_cut_sensoredge", 1.0), F.col("row") if gap else None, F.lit(pitch_y) if gap else None)
    near = masks.dilated(t["masked"].filter(F.col("detector") == d.name), int(b.number("masked_pixel_distance_cut", 1))).select("col", "row").withColumn("__masked", F.lit(True))
    p = p.withColumns({"__c": coords.half_up(F.col("col")), "__r": coords.half_up(F.col("row"))})
    p = p.join(near.select(F.col("col").alias("__c"), F.col("row").alias("__r"), "__masked"), ["__c", "__r"], "left")
    a = t["associations"]
    need = b.texts("require_associated_cluster_on")
    if need:
        p = p.join(assoc.with_all(a, need, tuple(TRACK)).withColumn("__required", F.lit(True)), TRACK, "left")
    p = p.join(a.filter(F.col("detector") == d.name).groupBy(*TRACK).agg(F.collect_set("die").alias("__dies"), F.lit(True).alias("__hit")), TRACK, "left")
    p = p.withColumn("place", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(n) for n in d.die_labels()])))
    outside = ~inside | F.when(F.col("place").isNull(), False).otherwise(F.col("die") != F.col("place"))
    matched = F.when(F.col("place").isNull(), F.col("__hit").isNotNull()).otherwise(F.coalesce(F.array_contains("__dies", F.col("place")), F.lit(False)))
    required = F.col("__required").isNotNull() if need else F.lit(True)
    label = efficiency.cut_stage(outside, F.col("chi2ndof"), b.number("chi2ndof_cut", 3.0), F.col("isolated"), F.col("__masked").isNotNull(), required)
    return p.withColumns({"stage": label, "matched": matched, "x": F.col("gx"), "y": F.col("gy")}).drop("__c", "__r", "__masked", "__required", "__hit", "__dies")


@stage("AnalysisEfficiency")
def analysis_efficiency(t: Tables, b: Block) -> Tables:
    """tracks, associations -> efficiency (total), cut flow, maps, profiles, by event, fake rates; each for the detector and its dies."""
    bins = b.list("efficiency_2D_histograms_bin_size", (0.01,))
    size = (bins[0], bins[1] if len(bins) > 1 else bins[0])
    sigma = b.number("sigma_moyal", 0.1)
    found: dict[str, list[DataFrame]] = {}
    sets, graphs = [], []
    for d in geometry.bound(t["geometry"], b.values.get("name", ""), b.text("type")):
        clusters = store.stored(_dut_clusters(t, d), "dut-clusters")
        places = {die: d.name if die is None else f"{d.name}/{die}" for die in [None, *d.die_labels()]}
        ends = {f"AnalysisEfficiency.{place}.{s}": F.count_if((F.col("stage") == s) & F.col("place").eqNullSafe(F.lit(die))) for die, place in places.items() for s in efficiency.STAGES}
        everywhere = store.stored(_judged(t, b, d), "judged", ends)
        for die, place in places.items():
            judged = everywhere.filter(F.col("place").eqNullSafe(F.lit(die))).drop("place")
            good = judged.filter("stage = 'good'")
            mine = lambda df: df.withColumns({"detector": F.lit(d.name), "die": F.lit(die).cast("string")})  # noqa: B023, E731
            a = t["associations"].filter(F.col("detector") == d.name)
            a = a if die is None else a.filter(F.col("die") == die)
            linked = good.select(*TRACK, "u", "v").join(a.select(*TRACK, "cluster_id", "charge", "size", "width_col", "width_row", "ts", F.col("x").alias("cluster_x"), F.col("y").alias("cluster_y")), TRACK)
            frame = efficiency.Frame.of(d.size(), size)
            cells = {"ix": coords.bin_2d(F.col("u"), F.lit(frame.low_x), frame.width_x), "iy": coords.bin_2d(F.col("v"), F.lit(frame.low_y), frame.width_y)}
            inside = linked.withColumns(cells).filter(F.col("ix").between(0, frame.bins_x - 1) & F.col("iy").between(0, frame.bins_y - 1))
            own = clusters if die is None else clusters.filter(F.col("die") == die)
            tables = {
                "cut_flow": efficiency.cut_flow(judged), "efficiency": efficiency.total_efficiency(good), "efficiency_maps": efficiency.efficiency_maps(good, d.size(), size, d.position[:2]),
                "profile_maps": efficiency.profile_maps(inside, sigma), "efficiency_by_event": efficiency.efficiency_by_event(good),
            } | _fakes(t, b, d, own, judged)
            for n, df in tables.items():
                found.setdefault(n, []).append(mine(df))
            delta = {"dx": F.col("u") - F.col("cluster_x"), "dy": F.col("v") - F.col("cluster_y")}
            nearest = linked.withColumns(delta).groupBy(*TRACK).agg(F.min_by(F.struct("dx", "dy"), F.struct(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.col("cluster_id"))).alias("n"))
            label = mine(nearest.select(*TRACK, "n.dx", "n.dy"))
            only = (lambda s: (s[0], F.array(F.lit(place)), s[2]))  # noqa: B023, E731
            sets += [only(s) for s in plots.analysis_efficiency(label, mine(tables["fakes"]), mine(tables["fake_pixels"]), mine(tables["fake_events"]), t["detectors"], int(b.number("n_charge_bins", 1000)), b.number("charge_histo_range", 5.0))]
            graphs.append(plots.efficiency_graph(tables["efficiency_by_event"], place))
    united = {n: reduce(DataFrame.unionByName, parts) for n, parts in found.items()}
    out = t | {n: t[n].unionByName(df) if n in t else df for n, df in united.items()}
    out = _graphed(out, b, reduce(DataFrame.unionByName, graphs)) if graphs else out
    return _plotted(out, b, sets)


def _fakes(t: Tables, b: Block, d: Detector, clusters: DataFrame, judged: DataFrame) -> dict[str, DataFrame]:
    """Clusters without a cause, their pixels, what each event has of them, the map and the rates by time."""
    distance = b.number("fake_rate_distance", 2.0)
    pitch_y = d.effective_pitch()[1]
    gap = d.has_die_split()
    wide = coords.has_intercept(F.col("col"), F.col("v"), F.lit(d.n_cols), F.lit(d.size()[1]), F.lit(d.pitch_y), -distance, F.col("row") if gap else None, F.lit(pitch_y) if gap else None)
    tracks = judged.withColumn("inside", wide)
    events = efficiency.all_events(tracks, clusters).join(track.event_times(tracks), "event_id", "left")
    if b.text("fake_rate_method", "radius") == "edge":
        fakes = efficiency.fakes_by_edge(clusters, tracks)
        events = events.join(tracks.filter("inside").select("event_id").distinct(), "event_id", "left_anti")
    else:
        scaled = clusters.withColumns({"x": F.col("x") / d.pitch_x, "y": F.col("y") / d.pitch_y})
        near = tracks.withColumns({"px": F.col("px") / d.pitch_x, "py": F.col("py") / d.pitch_y})
        kept = efficiency.fakes_by_radius(scaled, near, distance).select("event_id", "cluster_id")
        fakes = clusters.join(kept, ["event_id", "cluster_id"], "left_semi")
    if "pixels" in t:
        px = t["pixels"].filter(F.col("detector") == d.name).select("event_id", "cluster_id", "col", "row", "charge")
        fake_pixels = px.join(fakes.select("event_id", "cluster_id"), ["event_id", "cluster_id"], "left_semi")
    else:
        fake_pixels = fakes.select("event_id", "cluster_id", F.round("col").cast("int").alias("col"), F.round("row").cast("int").alias("row"), "charge")
    n_clusters = fakes.groupBy("event_id").agg(F.count("*").alias("clusters"))
    n_pixels = fake_pixels.groupBy("event_id").agg(F.count("*").alias("pixels"))
    per = events.join(n_clusters, "event_id", "left").join(n_pixels, "event_id", "left").select("event_id", "ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clusters", "pixels")])
    per = store.stored(per, "fake-events")
    timed = per.filter("ts IS NOT NULL")
    rates = None
    for seconds in (1, 10):
        slot = F.floor(F.col("ts") / (seconds * 1e9))
        one = timed.filter((slot >= 0) & (slot < 3000)).groupBy(slot.alias("slot")).agg(F.count("*").alias("events"), F.avg("pixels").alias("rate")).withColumn("seconds", F.lit(seconds))
        rates = one if rates is None else rates.unionByName(one)
    return {"fakes": fakes.select("event_id", "cluster_id", "charge", "size"), "fake_pixels": fake_pixels, "fake_events": per, "fake_map": efficiency.fake_map(fake_pixels, per), "fake_rates": rates}


@stage("AnalysisTiming")
def analysis_timing(t: Tables, b: Block) -> Tables:
    """associations (and the tracks' own clusters) -> time differences of pairs of detectors, corrected for time walk, and multiplicities."""
    names = b.texts("detectors")
    a = t["associations"].select(*TRACK, "detector", "cluster_id", "die", "channel", "charge", F.col("first_ts").alias("ts"))
    need = b.texts("require_cluster_on") or []
    if need:
        own = _points(t, t["track_cluster_links"]).select(*TRACK, "detector", "cluster_id")
        a = a.join(assoc.with_all(assoc.on_tracks(own, a), need, tuple(TRACK)), TRACK, "left_semi")
    walked = a.withColumn("ts", timing.walk(F.col("ts"), F.col("charge"), b.number("timewalk_a"), b.number("timewalk_b"), b.text("timewalk_method", "none")))
    p = timing.pairs(walked, names, b.flag("require_same_trigger_group", True), b.flag("require_cluster_on_all_detectors"), tuple(TRACK))
    if b.flag("fit_timewalk"):
        x = F.col("charge_first")
        fitted = timing.fit_walk(p, ("first", "second"), x, F.col("dt"))
        p = timing.corrected(p, fitted, ("first", "second"), x, F.col("dt"), x).withColumn("dt", F.col("corrected")).drop("corrected")
        t = t | {"timewalk": fitted}
    some = a.filter(F.col("detector").isin(names))
    counts, pair_counts = timing.cluster_counts(some, tuple(TRACK)), timing.pair_counts(p, tuple(TRACK))
    first = some.groupBy(*TRACK, "detector").agg(F.first("die").alias("die"))
    dies = lambda side: first.select(*TRACK, F.col("detector").alias(side), F.col("die").alias(f"die_{side}"))
    dressed = p.join(dies("first"), [*TRACK, "first"]).join(dies("second"), [*TRACK, "second"])
    return _plotted(t | {"time_pairs": p, "cluster_counts": counts, "pair_counts": pair_counts}, b, plots.analysis_timing(some, dressed, counts, pair_counts))


# ---- synchronisation


@stage("Synchronizer")
def synchronizer(t: Tables, b: Block) -> Tables:
    """tracks, waveforms -> onset, segments, and waveforms with their events shifted back; with `output_file` they are written."""
    names = b.texts("detectors")
    cuts = {n: (b.number(f"min_{n}", -1e30), b.number(f"max_{n}", 1e30)) for n in ("snr", "amplitude", "noise", "rise_time", "start_time", "integral")}
    window, band = int(b.number("window", 5000)), int(b.number("band", 3))
    runs = None
    good = {}
    for d in geometry.bound(t["geometry"], "", b.text("type")) if not names else [geometry.bound(t["geometry"], n)[0] for n in names]:
        good[d.name] = sync.passing(t["waveforms"].filter(F.col("detector") == d.name), b.number("cfd", 0.7), **cuts)
        met = intercepts(t["tracks"].select(*TRACK, "mx", "cx", "my", "cy"), t["detectors"].filter(F.col("detector") == d.name))
        inside = coords.has_intercept(F.col("col"), F.col("v"), F.lit(d.n_cols), F.lit(d.size()[1]), F.lit(d.pitch_y), b.number("spatial_cut_sensoredge", 0.0))
        one = sync.flagged(met.filter(inside).select(*TRACK), good[d.name]).withColumn("detector", F.lit(d.name))
        runs = one if runs is None else runs.unionByName(one)
    rows = store.stored(sync.numbered(runs, "detector", ("event_id", "track_id")), "numbered")
    total = {r["detector"]: r["n"] for r in rows.groupBy("detector").agg(F.max("n").alias("n")).collect()}  # one row a detector
    parts = [sync.cusum(rows.filter(F.col("detector") == d), "detector", sync.baseline_rows(n), b.number("slack", 0.1)) for d, n in sorted(total.items())]
    first = sync.onsets(reduce(DataFrame.unionByName, parts), "detector", b.number("threshold", 50.0))
    onset = sync.shared_onset(first).first()["onset"]  # one number
    out = t | {"onsets": first}
    if onset is None:
        return out
    late = rows.select("event_id").filter(F.col("event_id") >= onset)
    hits = reduce(DataFrame.unionByName, [g.select("event_id") for g in good.values()])
    scan = sync.shift_scan(late, hits, int(b.number("reach", 50)), window)
    found = sync.segments(_spark(t), late, sync.walk_shifts(scan, 0, band), window, int(onset))
    out["segments"] = found
    mine = F.col("detector").isin(list(good))
    out["waveforms"] = sync.apply_shifts(t["waveforms"].filter(mine), found).unionByName(t["waveforms"].filter(~mine))
    if target := b.text("output_file"):
        sync.write_shifted(t["waveforms"], found, list(good), b.text("input_file"), target, b.flag("allow_in_place"))
    return out
