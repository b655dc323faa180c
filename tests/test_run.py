"""Whole runs from a configuration file: raw hits to efficiency and timing, saved runs, alignment, synchronisation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.operators import plots
from beamloom.operators import plots as core_plots
from beamloom.plans import config, main
from beamloom.plans import plots as plot_sets
from beamloom.sources import geometry
from beamloom.sources import hits as hit_sources

EVENTS, LATE = 240, 160
#: Events whose track meets the detectors under test; A misses every tenth of them.
INSIDE = np.random.default_rng(9).random(EVENTS) < 0.5
SEEN = int(INSIDE.sum())
BY_A = SEEN - -(-SEEN // 10)


def geometry_text(shift=0.0):
    out = ['[General]\ndies_file = "dies.toml"\n']
    for k in range(5):
        role = 'role = "reference"\n' if k == 0 else ""
        out.append(f'[T{k}]\ntype = "pixel"\n{role}position = ["{shift * 1000 * (k == 2)}um", 0, "{100 * k}mm"]\norientation = [0, 0, 0]\nnumber_of_pixels = [200, 200]\npixel_pitch = ["100um", "100um"]\nspatial_resolution = ["30um", "30um"]\nsource_sensor = "tel_{k}"\n')
    for k, z in (("A", 250), ("B", 350)):
        out.append(f'[D{k}]\ntype = "lgad"\nposition = [0, 0, "{z}mm"]\norientation = [0, 0, 0]\nnumber_of_pixels = [16, 2]\npixel_pitch = ["1mm", "1mm"]\nsource_sensor = "dig_{k}"\n')
    return "\n".join(out)


DIES = "\n".join(f'[[D{d}.dies]]\nname = "{n}"\npixels = {json.dumps([[c, r] for c in range(16)])}' for d in "AB" for r, n in ((0, "BOTTOM"), (1, "TOP")))


def pulse(start, height):
    s = 0.002 * np.array([(-1) ** k for k in range(100)])
    up = np.clip((np.arange(100) - start) / 4, 0, 1) * np.clip((start + 12 - np.arange(100)) / 8, 0, 1)
    return [int(v) for v in np.round(-(s + height * up) * 4096 + 2048)]


def raw_rows():
    """One track an event, some inside the detectors under test; A misses a tenth of them, B fires an event late from LATE on,
    and a pixel of T4 is noisy."""
    r = np.random.default_rng(1)
    rows, tracks = [], []
    for e in range(EVENTS):
        c, m = r.uniform(-6, 6, 2) * (1, 0.12) + (0, 3 * (not INSIDE[e])), r.normal(0, 2e-4, 2)
        tracks.append((c, m))
        for k in range(5):
            x, y = c + m * 100 * k
            rows.append((e, round(x / 0.1 + 99.5), round(y / 0.1 + 99.5), -1, "tel", str(k), 100.0, False, None, 0.0))
        if not INSIDE[e]:
            continue
        if INSIDE[:e].sum() % 10:
            x, y = c + m * 250
            rows.append((e, int(np.floor(x + 8)), int(np.floor(y + 1)), int(r.integers(0, 8)), "dig", "A", 100.0, True, pulse(40 + e % 3, 0.3), 0.0))
        x, y = c + m * 350
        rows.append((e + (1 if e >= LATE else 0), int(np.floor(x + 8)), int(np.floor(y + 1)), 16, "dig", "B", 100.0, True, pulse(50, 0.25), 0.0))
    rows += [(e, 1, 1, -1, "tel", "4", 100.0, False, None, 0.0) for e in range(EVENTS)]
    rows += [(0, 1, 1, -1, "other", "9", 1.0, False, None, 0.0)]
    return rows, tracks


RAW = "event_id long, col int, row int, channel int, sensor_type string, plane_id string, timestamp double, has_waveform boolean, samples array<int>, dc_offset double"

CONFIG = """
detectors_file = "{root}/geo.toml"
output_directory = "{root}/out"
count = ["hits", "tracks"]

[EventLoader]
file_name = "{root}/raw"

[MaskCreator]
frequency_cut = 3000
mask_directory = "{root}/masks"

[ClusteringSpatial]
type = "pixel"

[Correlations]
concurrent = true

[Tracking4D]
exclude_detectors = ["lgad"]
spatial_cut_abs = "300um"
min_hits_on_track = 5
unique_cluster_usage = true
isolation_cut = "50um"
storage_file = "{root}/saved"

[WaveformProcessing]
cfd = [0.5, 0.7]
storage_file = "{root}/saved"

[WaveformSelector]
min_snr = 5

[[ClusteringSpatial]]
type = "lgad"

[DUTAssociation]
type = "lgad"
spatial_cut_abs = [0.8, 0.8]

[AnalysisEfficiency]
name = "DA"
chi2ndof_cut = 5
spatial_cut_sensoredge = 0.0
efficiency_2D_histograms_bin_size = [1.0, 0.5]
sigma_moyal = 0.5

[AnalysisTiming]
detectors = ["DA", "DB"]
require_same_trigger_group = true
"""


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "geo.toml").write_text(geometry_text())
    (folder / "dies.toml").write_text(DIES)
    (folder / "masks").mkdir()
    spark.createDataFrame(raw_rows()[0], RAW).repartition(3).write.parquet(str(folder / "raw"))
    return folder


def written(root, text, name="run.toml"):
    (root / name).write_text(text.replace("{root}", str(root)))
    return str(root / name)


@pytest.fixture(scope="module")
def done(spark, root):
    return main.run(spark, written(root, CONFIG.replace("[[ClusteringSpatial]]", "[[ClusteringSpatial]]").replace("[ClusteringSpatial]\ntype = \"pixel\"", "[[ClusteringSpatial]]\ntype = \"pixel\"")))


def test_hits_to_efficiency_and_timing(spark, root, done):
    t, report, failed = done
    assert not failed, failed
    tracks = t["tracks"].collect()
    _, true = raw_rows()
    assert len(tracks) == EVENTS and all(r.n == 5 and abs(r.mx - true[r.event_id][1][0]) < 5e-4 and r.isolated for r in tracks)
    assert report.counts["tracks"] == EVENTS and any(line.startswith("tracks: 240") for line in report.lines())
    assert {(r.raw, r.reason) for r in t["discarded"].collect()} == {("other_9", "unknown")}
    eff = {r.die: (r.matched, r.n) for r in t["efficiency"].collect()}
    assert eff[None][1] >= SEEN - 10 and abs(eff[None][0] / eff[None][1] - 0.9) < 0.03
    assert eff["TOP"][1] + eff["BOTTOM"][1] == eff[None][1] and eff["TOP"][0] + eff["BOTTOM"][0] == pytest.approx(eff[None][0], abs=4)
    flow = {r.stage: r.n for r in t["cut_flow"].filter("die IS NULL").collect()}
    assert sum(flow.values()) == EVENTS and flow["good"] == eff[None][1]
    maps = t["efficiency_maps"].filter("die IS NULL AND frame = 'local'").collect()
    assert len(maps) == 22 * 6 and sum(r.n for r in maps) == eff[None][1] and any(r.n == 0 and r.efficiency == 0 for r in maps)
    assert t["profile_maps"].filter("die IS NULL").agg(F.sum("n")).first()[0] == eff[None][0]
    pairs = t["time_pairs"].collect()  # channels of A are of group 0, as is 16
    assert {(r.first, r.second) for r in pairs} == {("DA", "DB")} and sum(r.event_id < LATE for r in pairs) >= 50
    assert all(abs(r.dt - (r.event_id % 3 - 10) * 0.2) < 0.05 for r in pairs if r.event_id < LATE)


def test_counters_come_with_the_tables(spark, done):
    t, report, _ = done
    n = report.counts
    assert n["hits"] == t["hits"].count() and n["clusters"] == t["clusters"].count() and n["Tracking4D.kept"] == EVENTS and n["Tracking4D.hits"] == 5 * EVENTS
    assert n["Tracking4D.followed"] >= EVENTS
    flow = {(r.detector, r.die, r.stage): r.n for r in t["cut_flow"].collect()}
    got = {tuple(k.split(".")[1:]): v for k, v in n.items() if k.startswith("AnalysisEfficiency.")}
    assert {(d if die is None else f"{d}/{die}", s): k for (d, die, s), k in flow.items()} == {k: v for k, v in got.items() if v}
    pairs = {(r.detector, r.reason): r.n for r in t["cut_reasons"].filter("die IS NULL").collect()}
    assert n["DUTAssociation.DA.associated"] == pairs[("DA", 0)]


def test_a_bad_plot_leaves_the_others(spark, tmp_path):
    rows = spark.range(40).select(F.lit("D").alias("detector"), F.col("id").cast("double").alias("v"), F.lit("x").alias("w"))
    at = core_plots.places(F.col("detector"))
    lost = core_plots.Plot("lost", F.raise_error(F.lit("lost")).cast("double"), 4, 0, 40)
    sets = [(rows, at, [core_plots.Plot("good", "v", 4, 0, 40), core_plots.Plot("no_column", "missing", 4, 0, 40), lost]), (rows, at, [core_plots.Plot("more", "v", 2, 0, 40)]), (rows, at, [core_plots.Plot("none", "missing", 1, 0, 1)])]
    bad = plot_sets.written(sets, str(tmp_path), "S")
    assert bad.keys() == {"S/no_column", "S/lost", "S/none"} and "lost" in bad["S/lost"]
    for name, n in (("hist_bins", 6), ("hist_stats", 2)):
        found = spark.read.parquet(f"{tmp_path}/{name}/stage=S")
        assert {r.plot for r in found.collect()} == {"good", "more"} and found.count() == n
    assert plot_sets.written(sets[1:2], str(tmp_path), "S") == {} and spark.read.parquet(f"{tmp_path}/hist_bins/stage=S").count() == 2  # written anew


def test_plots_and_saved_tables(spark, root, done):
    t, _, _ = done
    bins = spark.read.parquet(str(root / "out/hist_bins/stage=ClusteringSpatial"))
    size = {(r.path, r.ix): r.content for r in bins.filter("plot = 'clusterSize'").collect()}
    assert size[("DA", 1)] == BY_A
    stats = {(r.path, r.plot): r for r in spark.read.parquet(str(root / "out/hist_stats/stage=WaveformProcessing")).collect()}
    assert stats[("", "raw_snr")].entries == SEEN + BY_A and ("cfd_0.50/DA/total", "amplitude") in stats and any(p.startswith("cfd_0.70/DA/channel_") for p, _ in stats)
    paths = {r.path for r in spark.read.parquet(str(root / "out/hist_stats/stage=AnalysisEfficiency")).select("path").distinct().collect()}
    assert {"DA", "DA/TOP", "DA/BOTTOM"} <= paths
    points = spark.read.parquet(str(root / "out/graph_points/stage=AnalysisEfficiency"))
    assert points.filter("path = 'DA' AND graph = 'efficiency_vs_event'").count() == t["efficiency_by_event"].filter("die IS NULL").count()
    names = plots.exported(str(root / "out"), spark, str(root / "json"))
    assert "efficiency" in names and spark.read.json(str(root / "json/efficiency")).count() == 3
    assert plots.written({"good": spark.range(1), "bad": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, str(root / "some")).keys() == {"bad"}
    saved = hit_sources.read_saved(spark, str(root / "saved"))
    assert saved["tracks"].count() == EVENTS and saved["track_cluster_links"].count() == 5 * EVENTS and saved["waveforms"].count() == SEEN + BY_A
    assert "mask_T4.txt" in {p.name for p in (root / "masks").iterdir()}


SECOND = """
detectors_file = "{root}/geo.toml"
detectors_file_updated = "{root}/new.toml"

[Reader]
filenames = "{root}/saved"

[WaveformSelector]
cfd = 0.5

[ClusteringSpatial]
type = "lgad"

[DUTAssociation]
type = "lgad"
spatial_cut_abs = [0.8, 0.8]

[AnalysisTiming]
detectors = ["DA", "DB"]
require_same_trigger_group = {group}

[PrealignmentDUT]
dut_names = ["DA"]

[AlignmentDUT]
name = "DA"
update_xy_translation = true
update_z_orientation = true
chi2ndof_cut = 5
spatial_cut_sensoredge = 0
min_quadrant_entries = 2
max_pixel_centroid_deviation = 0.6
efficiency_2D_histograms_bin_size = [0.1, 0.1]

[Synchronizer]
detectors = ["DB"]
cfd = 0.5
window = 20
band = 3
reach = 5
threshold = 2.0
output_file = "{root}/shifted"
input_file = "{root}/saved/waveforms"
"""


def test_saved_tracks_to_timing_alignment_and_synchronisation(spark, root, done):
    t, _, failed = main.run(spark, written(root, SECOND.replace("{group}", "false"), "second.toml"))
    assert not failed
    early = [r for r in t["time_pairs"].collect() if r.event_id < LATE]
    assert len(early) > 50 and all(r.first == "DA" and r.second == "DB" for r in early)
    assert all(abs(r.dt - (-10 + e) * 0.2) < 0.05 for r in early for e in [r.event_id % 3])
    assert t["onsets"].first().event_id in range(LATE, LATE + 20)
    assert {r.shift for r in t["segments"].collect()} == {1}
    got = spark.read.parquet(str(root / "shifted")).filter("detector = 'DB'")
    assert got.count() == SEEN and all(INSIDE[r.event_id] for r in got.filter(f"event_id BETWEEN {LATE + 20} AND {EVENTS - 20}").collect())
    assert geometry.read(str(root / "geo.toml"))[0].position == (0.0, 0.0, 0.0) and "plateaus" in t
    assert "AlignmentDUT" in t["graphs"] and "AlignmentDUT" in t["plots"]  # tracks miss the outer columns, so no die is trusted as a whole


def test_alignment_of_the_telescope_writes_a_geometry(spark, root, done):
    (root / "moved.toml").write_text(geometry_text(0.08))
    text = """
detectors_file = "{root}/moved.toml"
[EventLoader]
file_name = "{root}/raw"
exclude_detectors = ["lgad"]
[ClusteringSpatial]
[Prealignment]
range_abs = 10
fixed_planes = ["T1", "T3", "T4"]
[Tracking4D]
exclude_detectors = ["lgad"]
spatial_cut_abs = "500um"
[{stage}]
exclude_detectors = ["lgad"]
fixed_planes = ["T0", "T1", "T3", "T4"]
iterations = 1
align_orientation = false
dofs = [true, true, false, false, false, false]
residual_cut_init = 5
residual_cut = 5
detectors_file_updated = "{root}/aligned_{stage}.toml"
"""
    for stage in ("AlignmentTrackChi2", "AlignmentMillepede"):
        t, _, _ = main.run(spark, written(root, text.replace("{stage}", stage), "align.toml"), ("Prealignment.damping_factor=0",))
        d = {x.name: x for x in geometry.read(str(root / f"aligned_{stage}.toml"))}
        assert d["T2"].position[0] == pytest.approx(0.0, abs=0.02) and d["T1"].position == (0.0, 0.0, 100.0) and stage in t["graphs"]


def test_arguments_and_errors(root, done):
    path = written(root, CONFIG)
    assert config.arguments(["-c", path, "-o", "A.b=1", "-o", "c=2"]) == (path, ("A.b=1", "c=2")) and config.arguments([path])[0] == path
    with pytest.raises(KeyError):
        config.run([config.Block("Nothing")], {})
    with pytest.raises(KeyError):
        geometry.bound([], "x")
    with pytest.raises(ValueError):
        geometry.bound([], "", "")


def test_scan_of_several_files(spark, tmp_path):
    for k, n in enumerate((4, 3, 5)):
        spark.range(n).select(F.col("id").alias("event_id"), F.lit(k).alias("k")).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    files = [str(tmp_path / f"f{k}") for k in range(3)]
    assert sorted((r.event_id, r.k) for r in hit_sources.scan(spark, files).collect()) == [(i, 0) for i in range(4)] + [(4 + i, 1) for i in range(3)] + [(7 + i, 2) for i in range(5)]
    assert sorted(r.event_id for r in hit_sources.scan(spark, files, [2, 1]).collect()) == [0, 1, 4, 7]


def test_reader_of_several_runs(spark, tmp_path):
    for k in range(2):
        t = spark.createDataFrame([(k, 1, 0.0)], "event_id long, track_id long, mx double")
        links = spark.createDataFrame([(k, 1, 5)], "event_id long, track_id long, cluster_id long")
        c = spark.createDataFrame([(k, 5, "A", 1.4, 2.5, 1.0), (k, 6, "A", 1.0, 2.0, 1.0)], "event_id long, cluster_id long, detector string, col double, row double, charge double")
        hit_sources.write_saved(str(tmp_path / f"r{k}"), t, links, c)
        hit_sources.write_unused(str(tmp_path / f"r{k}"), c, ["A"])
    s = hit_sources.read_saved(spark, [str(tmp_path / "r0"), str(tmp_path / "r1")])
    both = hit_sources.replay(s["tracks"], s["track_cluster_links"], s["clusters"]).collect()
    assert sorted((r.event_id, r.cluster_id, r.pixels[0].col, r.pixels[0].row) for r in both) == [(0, 5, 1, 3), (1, 5, 1, 3)]
    assert sorted(r.cluster_id for r in hit_sources.unlinked_clusters(s["clusters"], s["track_cluster_links"]).collect()) == [6, 6]


def test_detector_rules():
    d = geometry.Detector("D", "lgad", layout="odd", n_cols=3, n_rows=2, pitch_x=1.0, pitch_y=1.0, gap_y=0.5)
    assert d.unknown_layout() and not d.has_die_split() and d.is_pixel() and d.effective_pitch() == (1.0, 1.5)
    assert not geometry.Detector("E", layout="OrthogonalLayout").unknown_layout() and not geometry.Detector("E").is_pixel()
    assert geometry.bound([d], "", "lgad") == [d] and geometry.Detector("F", dies={"b": [], "a": []}).die_labels() == ["b", "a"]


def test_a_path_without_a_die_is_left_out(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("B", "", 2.0), ("C", None, float("nan"))], "detector string, die string, v double")
    e = plots.entries(df, plots.by_die(F.col("detector"), F.col("die")), [plots.Plot("p", "v", 4, 0.0, 4.0)])
    assert sorted((r.path, r.ix) for r in e.collect()) == [("A", 1), ("A/x", 1), ("B", 2)]
    assert plot_sets.filled([(df, plots.places("t"), [plots.Plot("p", "v", 4, 0.0, 1.5)])]).filter("ix IS NULL").count() == 1
