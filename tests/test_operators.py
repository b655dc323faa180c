import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.operators import assoc, cluster, correlate, efficiency, masks, sync, timing, track, waveform
from beamloom.sources import daq, geometry
from beamloom.sources import hits as hit_sources


def flood(pixels):
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        left.discard(start)
        todo = [start]
        while todo:
            c, r = todo.pop()
            out[(c, r)] = start
            for p in [(c + i, r + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    todo.append(p)
    return out


def test_clusters_against_flood_fill(spark):
    r = random.Random(3)
    groups = {(e, d): {(r.randrange(15), r.randrange(15)) for _ in range(r.choice([1, 5, 40, 90]))} for e in range(25) for d in ("A", "B")}
    groups[(99, "A")] = {(0, k) for k in range(200)} | {(k, 199) for k in range(200)}
    rows = [(e, d, c, w, 1.0, 0.0, 0) for (e, d), px in groups.items() for c, w in px]
    df = spark.createDataFrame(rows, "event_id long, detector string, col int, row int, charge double, ts double, channel int").repartition(5)
    got = {}
    for x in cluster.label(df).collect():
        got.setdefault((x.event_id, x.detector), {})[(x.col, x.row)] = (x.seed_col, x.seed_row)
    assert got == {k: flood(v) for k, v in groups.items()}
    assert cluster.label(df.limit(0)).count() == 0


def test_cluster_shapes(spark):
    rows = [(1, "A", 0, 0, 2.0, 5.0, 1), (1, "A", 0, 0, 3.0, 6.0, 2), (1, "A", 1, 1, 1.0, 1.0, 3), (1, "A", 5, 5, 4.0, 2.0, 4), (1, "A", 5, 6, 4.0, 3.0, 5)]
    px = cluster.last_hits(spark.createDataFrame(rows, "event_id long, detector string, col int, row int, charge double, ts double, channel int"))
    c = {(x.seed_col, x.seed_row): x for x in cluster.clusters(cluster.label(px)).collect()}
    assert set(c) == {(0, 0), (5, 5)}
    a = c[(0, 0)]
    assert (a.charge, a.size, a.width_col, a.channel, a.seed_charge) == (4.0, 2, 2, 2, 3.0) and a.col == pytest.approx(0.25) and a.first_ts == 1.0
    assert c[(5, 5)].channel == 4
    split = cluster.label(px.withColumn("die", F.when(F.col("row") < 6, "x").otherwise("y")), "die")
    assert cluster.clusters(split).count() == 3


def test_masks(spark, tmp_path):
    det = geometry.table(spark, [geometry.Detector("A", n_cols=4, n_rows=4, pitch_x=1.0, pitch_y=1.0)])
    rows = [("A", 0, 0)] * 30 + [("A", c, r) for c in range(4) for r in range(4) if (c, r) != (3, 3)]
    hits = spark.createDataFrame(rows, "detector string, col int, row int")
    none = hits.limit(0)
    assert [tuple(r) for r in masks.frequency_mask(hits, det, none, 5.0).collect()] == [("A", 0, 0, 31)]
    d = {(r.col, r.row): r for r in masks.local_density(hits, det, 1).collect()}
    assert d[(0, 0)].mean == pytest.approx(1.0) and d[(1, 1)].mean == pytest.approx((31 + 7) / 8) and d[(2, 2)].mean == pytest.approx(7 / 8)
    dead = masks.dead_pixels(hits, det, none)
    assert [(r.col, r.row) for r in dead.collect()] == [(3, 3)]
    masks.write_text(dead, str(tmp_path / "m"))
    assert [tuple(r) for r in masks.read_text(spark, str(tmp_path / "m"), "A").collect()] == [("A", 3, 3)]


def pulse(kind):
    s = np.zeros(100) + 0.01 * np.array([(-1) ** k for k in range(100)])
    if kind != "flat":
        s[40:45] += np.array([0.25, 0.5, 0.75, 1.0, 0.9])
        if kind == "short":
            s[45:49] += np.array([0.7, 0.5, 0.3, 0.1])
        else:
            s[45:] += 0.9
    return s


def named(s, *args):
    kept, values, times = waveform.features(np.array([s]), *args)
    return (dict(zip(waveform.FEATURES, values[0], strict=True)), times[0]) if kept[0] else None


def test_waveforms(spark):
    f, t = named(pulse("short"), (0.5, 0.7))
    assert f["peak"] == 43 and abs(f["baseline"]) < 0.002 and f["noise"] == pytest.approx(0.01, rel=0.1) and f["amplitude"] == pytest.approx(0.99, abs=0.01)
    assert 8.0 < t[0] < t[1] < 8.6 and f["rise_time"] > 0 and f["time_over_threshold"] == pytest.approx(1.0, abs=0.25) and f["time_over_noise"] > f["time_over_threshold"] and f["integral"] > 0
    f, _ = named(pulse("long"))
    assert f["time_over_threshold"] == 0.0
    assert named(np.arange(10)[::-1] * 1.0) is None and named(np.zeros(1)) is None and named(np.zeros(50)) is None
    two = spark.createDataFrame([(1, [2048.0, 0.0]), (2, None), (3, [])], "k int, s array<double>").select(waveform.calibrated(F.col("s"), 0.1)).collect()
    assert two[0][0] == [-0.1, 0.4] and two[1][0] is None and two[2][0] == []
    mixed = spark.createDataFrame([(1, pulse("short").tolist()), (2, None), (3, [1.0]), (4, pulse("short").tolist() + [0.0] * 7), (5, [0.0] * 30)], "k int, s array<double>")
    got = {r.k: r for r in waveform.process(mixed, "s", (0.5, 0.7), keep=("k",)).collect()}
    assert got[1].peak == got[4].peak == 43 and [p.cfd for p in got[4].start_time_cfd] == [0.5, 0.7] and all(got[k].peak is None and got[k].start_time_cfd is None for k in (2, 3, 5))
    codes = mixed.withColumn("s", F.transform("s", lambda v: F.round(-v * 4096 + 2048)))
    assert {r.k: r.peak for r in waveform.process(codes, "s", keep=("k",), polarity=-1).collect()}[1] == 43


def walked(s, ceiling, level, places, dt):
    """When a trace passes a level, sample by sample from the peak outwards."""
    points, above = [], None
    for k in places:
        if s[k] > ceiling:
            above = (s[k], k * dt)
            continue
        points += [above] if not points and above else []
        points.append((s[k], k * dt))
        if s[k] < level:
            low = points[-1]
            high = min((p for p in points[:-1]), default=low)
            return low[1] + (min(1.0, (level - low[0]) / (high[0] - low[0])) * (high[1] - low[1]) if high[0] > low[0] else 0.0)
    return 0.0


def test_passages_against_walking():
    r = np.random.default_rng(2)
    for n in (3, 8, 40):
        s = r.standard_normal((300, n)).round(1) + 4 * np.exp(-(((np.arange(n) - n / 2) / 3) ** 2))
        peak = s.argmax(axis=1)
        top, level = s.max(axis=1) * 0.9, s.max(axis=1) * r.choice([0.2, 0.5, 0.8], 300)
        span = np.arange(n) <= peak[:, None]
        got = waveform._passed(s, span, top, level, 0.2, True)
        assert np.allclose(got, [walked(s[i], top[i], level[i], range(peak[i], -1, -1), 0.2) for i in range(300)])
        got = waveform._passed(s, np.arange(n) >= peak[:, None], top, level, 0.2, False)
        assert np.allclose(got, [walked(s[i], top[i], level[i], range(peak[i], n), 0.2) for i in range(300)])


def test_exact_lines(spark):
    pts = [(1, float(k), 2.0 + 0.5 * k, 1.0 - 0.25 * k, 4.0) for k in range(6)] + [(2, 0.0, 1.0, 1.0, 1.0), (2, 10.0, 2.0, 3.0, 1.0), (3, 5.0, 0.0, 0.0, 1.0)]
    got = {r.track_id: r for r in track.fit(spark.createDataFrame(pts, "track_id long, z double, x double, y double, w double")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].mx, got[1].cx, got[1].my, got[1].cy) == pytest.approx((0.5, 2.0, -0.25, 1.0)) and got[1].chi2 == pytest.approx(0, abs=1e-12) and got[1].ndof == 8
    assert got[2].chi2 == 0 and got[2].ndof == 0


def test_tilted_fit_against_a_plain_solve(spark):
    """The 4 x 4 normal equations of each track, solved by numpy."""
    rng = np.random.default_rng(6)
    planes = [geometry.Detector(f"P{k}", position=(0.1 * k, -0.2, 100.0 * k), orientation=(0.3 * (k == 2), -0.2 * (k > 3), 0.1 * (k == 4)), res_x=0.02, res_y=0.05) for k in range(6)]
    rows, want = [], {}
    for track_id in range(40):
        mx, cx, my, cy = 0.01, 2.0 + track_id, -0.02, 1.0
        m, v, hits = np.zeros((4, 4)), np.zeros(4), []
        used = planes if track_id else planes[:1]
        for d in used if track_id != 1 else planes[2:4]:
            r, p = np.array(d.rotation()), np.array(d.position)
            z = (r[:, 2] @ p - r[0, 2] * cx - r[1, 2] * cy) / (r[0, 2] * mx + r[1, 2] * my + r[2, 2])
            local = r.T @ (np.array([cx + mx * z, cy + my * z, z]) - p)
            u, w = local[:2] + rng.normal(0, 0.03, 2) * (track_id > 2)
            rows.append((track_id, float(u), float(w), 1 / d.res_x**2, 1 / d.res_y**2, *map(float, p), *map(float, r.ravel())))
            g = p + r @ np.array([u, w, 0.0])
            weight = np.linalg.inv((r @ np.diag([d.res_x**2, d.res_y**2, 1e-9]) @ r.T)[:2, :2])
            a = np.array([[g[2], 1, 0, 0], [0, 0, g[2], 1]])
            m, v = m + a.T @ weight @ a, v + a.T @ weight @ g[:2]
            hits.append((d, u, w))
        if len(hits) > 1:
            t, chi2 = np.linalg.solve(m, v), 0.0
            for d, u, w in hits:
                r, p = np.array(d.rotation()), np.array(d.position)
                z = (r[:, 2] @ p - r[0, 2] * t[1] - r[1, 2] * t[3]) / (r[0, 2] * t[0] + r[1, 2] * t[2] + r[2, 2])
                off = (r.T @ (np.array([t[1] + t[0] * z, t[3] + t[2] * z, z]) - p))[:2] - (u, w)
                chi2 += (off[0] / d.res_x) ** 2 + (off[1] / d.res_y) ** 2
            want[track_id] = (*t, 0.0 if len(hits) == 2 else chi2, 2 * len(hits) - 4)
    names = ["px", "py", "pz", *[f"r{i}{j}" for i in range(3) for j in range(3)]]
    df = spark.createDataFrame(rows, "track_id long, u double, v double, wu double, wv double, " + ", ".join(f"{n} double" for n in names))
    got = {r.track_id: tuple(r)[1:] for r in track.fit_tilted(df).collect()}
    assert got.pop(0) == (None,) * 6  # one hit
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-7), k


def test_follow_takes_the_nearest_inside(spark):
    rows = [(1, 0, 10, 0.0, 0.0, 0.0), (1, 2, 12, 0.0, 0.0, 200.0), (1, 1, 20, 1.0, 0.0, 100.0), (1, 1, 21, 0.5, 0.0, 100.0), (1, 1, 22, 1.01, 0.0, 100.0), (2, 0, 30, 0.0, 0.0, 0.0), (2, 2, 32, 0.0, 0.0, 200.0), (2, 1, 31, 0.8, 0.7, 100.0)]
    c = spark.createDataFrame([(*r, 0.0, 1.0) for r in rows], "event_id long, plane int, cluster_id long, x double, y double, z double, ts double, w double")
    got = {r.event_id: r.members for r in track.follow(c, [(1, 100.0)], 1.0, 1.0, min_hits=2).collect()}
    assert got[1] == [10, 12, 21] and got[2] == [30, 32]
    edge = c.filter("cluster_id NOT IN (21)")
    assert {r.event_id: r.members for r in track.follow(edge, [(1, 100.0)], 1.0, 1.0, min_hits=2).collect()}[1] == [10, 12, 20]


def test_dedup_and_isolation(spark):
    t = spark.createDataFrame([(1, 1, [1, 2, 3], 2.0), (1, 2, [3, 4, 5, 6], 9.0), (1, 3, [1, 2, 7], 1.0), (2, 4, [1, 2, 3], 5.0)], "event_id long, track_id long, members array<long>, chi2ndof double")
    assert {r.track_id for r in track.dedup(t).collect()} == {2, 3, 4}
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.99), (1, 3, 5.0, 5.0), (1, 4, 5.0, 6.0)], "event_id long, track_id long, x double, y double")
    assert {r.track_id for r in track.close_tracks(p, 1.0).collect()} == {1, 2}


def test_association_borders(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, "a", 0.0), (2, 2, 0.0, 0.0, "a", 0.0), (3, 3, 0.0, 0.0, "a", 0.0), (4, 4, float("nan"), 0.0, "a", 0.0)], "event_id long, track_id long, px double, py double, die string, ts double")
    c = spark.createDataFrame([(1, 10, 1.0, 0.0, "a", 5.0), (1, 11, 1.1, 0.0, "a", 5.0), (1, 12, 0.0, 0.0, "b", 5.0), (1, 13, 0.0, 0.0, "a", 5.1), (2, 14, 9.0, 9.0, "a", 0.0), (4, 15, 0.0, 0.0, "a", 0.0)], "event_id long, cluster_id long, x double, y double, die string, ts double")
    c = c.withColumn("pixels", F.array(F.struct("x", "y")))
    e = assoc.examined(t, c, 1.0, 1.0, 5.0)
    assert {r.cluster_id: r.reason for r in e.collect()} == {10: 0, 11: 1, 13: 2, 14: 1}
    n = {r.track_id: (r.n, r.seen) for r in assoc.counts(t, e, c).collect()}
    assert n == {1: (1, True), 2: (0, True), 3: (0, False), 4: (0, True)}
    assert [tuple(r) for r in assoc.closest(e).collect()] == [(1, 1, 10)]


def test_fakes(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 0.0, 0.0, False), (3, 9.0, 9.0, True)], "event_id long, px double, py double, inside boolean")
    c = spark.createDataFrame([(1, 1, 0.1, 0.0), (2, 2, 0.1, 0.0), (3, 3, 0.0, 0.0), (4, 4, 0.0, 0.0)], "event_id long, cluster_id long, x double, y double")
    assert {r.cluster_id for r in efficiency.fakes_by_radius(c, t, 1.0).collect()} == {1, 3, 4}
    assert {r.cluster_id for r in efficiency.fakes_by_radius(c, t, 1.0, inside_counts=True).collect()} == {3, 4}
    assert {r.cluster_id for r in efficiency.fakes_by_edge(c, t).collect()} == {2, 4}


def test_timing(spark):
    rows = [(1, "A", 3, 10.0, 2.0), (1, "B", 16, 7.0, 1.0), (1, "C", 9, 5.0, 1.0), (2, "A", -1, 1.0, 1.0), (2, "B", -1, 0.0, 1.0), (3, "B", 17, 4.0, 1.0), (3, "C", 9, 1.0, 1.0)]
    h = spark.createDataFrame(rows, "track_id long, detector string, channel int, ts double, charge double")
    assert {(r.track_id, r.first, r.second, r.dt) for r in timing.pairs(h, ["A", "B", "C"]).collect()} == {(1, "A", "B", 3.0), (3, "B", "C", 3.0)}
    assert timing.pairs(h, ["A", "B", "C"], same_group=False, all_of=True).count() == 3
    w = spark.createDataFrame([(1, q, 5.0 + 2.0 * q) for q in (1.0, 2.0, 4.0, 5e-4)], "k int, q double, t double")
    f = timing.fit_walk(w, ("k",), F.col("q"), F.col("t"))
    assert f.first().slope == pytest.approx(2.0)
    got = {r.q: r.corrected for r in timing.corrected(w, f, ("k",), F.col("q"), F.col("t"), F.col("q")).collect()}
    assert got[5e-4] == 5.001 and got[1.0] == pytest.approx(got[4.0])
    assert spark.range(1).select(timing.walk(F.lit(9.0), F.lit(4.0), 2.0, 1.0, "root"), timing.walk(F.lit(9.0), F.lit(0.0), 2.0, 1.0, "inverse")).first()[:] == (7.0, 9.0)


def test_sync(spark):
    r = random.Random(1)
    rows = [(i, "d", int(r.random() < (0.9 if i < 600 else 0.2))) for i in range(1000)]
    run = sync.cusum(sync.numbered(spark.createDataFrame(rows, "event_id long, detector string, passed int"), "detector", ("event_id",)), "detector", 200, 0.2).orderBy("n").collect()
    base, c = sum(x[2] for x in rows[:200]) / 200, 0.0
    for got, (_, _, p) in zip(run, rows, strict=True):
        c = max(0.0, c + base - p - 0.2)
        assert got.c == pytest.approx(c, abs=1e-9)
    t = spark.createDataFrame([(i,) for i in range(0, 9000, 7)], "event_id long")
    h = t.filter("event_id % 3 = 0").select(F.when(F.col("event_id") < 4000, F.col("event_id") + 1).otherwise(F.col("event_id") + 3).alias("event_id"))
    found = list(sync.walk_shifts(sync.shift_scan(t, h, 6, 300), 0, 2))
    assert found[0] == (0, 1) and found[-1][1] == 3
    with pytest.raises(Exception, match="negative"):
        sync.apply_shifts(t, spark.createDataFrame([(0, 10, 50)], "first long, last long, shift long")).collect()
    segments = sync.segments(spark, t, iter(found), 300, 500)
    moved = sync.apply_shifts(h, segments)
    late = {r.event_id for r in moved.filter("event_id >= 4500").collect()}
    assert late <= {r.event_id for r in t.collect()} and len(late) > 100
    with pytest.raises(Exception, match="0.3"):
        sync.passing(spark.createDataFrame([(1.0, [(0.5, 1.0)])], "snr double, start_time_cfd array<struct<cfd:double,t:double>>"), 0.3, start_time=(0.0, 9.0)).collect()


def test_shifted_files(spark, tmp_path):
    rows = [(e, d, float(e)) for e in range(20) for d in ("A", "B")]
    w = spark.createDataFrame(rows, "event_id long, detector string, snr double")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    w.write.parquet(source)
    segments = spark.createDataFrame([(10, 19, 3)], "first long, last long, shift long")
    with pytest.raises(ValueError, match="in_place"):
        sync.write_shifted(w, segments, ["A"], source, source)
    with pytest.raises(ValueError, match="no segments"):
        sync.write_shifted(w, segments.limit(0), ["A"], source, target)
    sync.write_shifted(spark.read.parquet(source), segments, ["A"], source, target)
    got = {(r.detector, int(r.snr)): r.event_id for r in spark.read.parquet(target).collect()}
    assert got == {(d, e): e - 3 if d == "A" and e >= 10 else e for e, d, _ in rows} and not (tmp_path / "out.partial").exists()


def test_prealignment_methods_agree(spark):
    r = random.Random(5)
    rows = [(i, "R", 0.0, 0.0, 0.0) for i in range(800)] + [(i, "D", r.gauss(-1.2, 0.2), r.gauss(0.7, 0.2), 0.0) for i in range(800)]
    p = correlate.pairs(spark.createDataFrame(rows, "event_id long, detector string, x double, y double, ts double"), "R")
    for method in ("mean", "maximum", "gauss_fit"):
        s = correlate.shifts(p, method, bins=100, fixed=("R",)).first()
        assert s.shift_x == pytest.approx(1.2, abs=0.3) and s.shift_y == pytest.approx(-0.7, abs=0.3)


def test_dead_pixels(spark):
    det = geometry.table(spark, [geometry.Detector("A", n_cols=3, n_rows=2)])
    hits = spark.createDataFrame([("A", 0, 0, 5000), ("A", 1, 1, 9000), ("A", 2, 0, 1)], "detector string, col int, row int, event_id long")
    masked = spark.createDataFrame([("A", 0, 1)], "detector string, col int, row int")
    assert {tuple(r) for r in masks.dead_pixels(hits, det, masked).collect()} == {("A", 1, 0), ("A", 2, 1)}


def test_daq_and_scans(spark):
    d = spark.createDataFrame([("x:CH12:col1:row2", "CH0 : 0\nCH12 : 65535"), ("none", ""), ("CH7sensor:col1", "CH1 x : 3 CH2: 13107V CH2 :0")], "aux string, dac string")
    got = d.select(daq.channel_of(F.col("aux")).alias("c"), daq.dac_offsets(F.col("dac")).alias("m")).collect()
    assert [r.c for r in got] == [12, -1, -1] and got[0].m == {0: -0.5, 12: 0.5} and got[1].m == {} and got[2].m == {2: -0.5}
    h = spark.createDataFrame([(1,), (3,)], "event_id long")
    assert sorted(r[0] for r in hit_sources.union_files([h, h, h], [2, 4]).collect()) == [1, 5, 7, 9, 11]
    assert hit_sources.normalised(h, ("channel", "has_waveform")).first()[1:] == (-1, False)


@pytest.mark.parametrize("cut", [0.0, 0.3, 1.0, 7.0])
def test_near_pairs_against_all_pairs(spark, cut):
    rng = np.random.default_rng(8)
    rows = [(int(e), i, float(x), float(y)) for i, (e, x, y) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-40, 40, 200) / 10, rng.uniform(-3, 3, 200), strict=True))]
    rows += [(0, 900, -0.0, 0.0), (0, 901, cut, 0.0), (0, 902, 0.0, -cut * (1 - 1e-12))]
    t = spark.createDataFrame(rows, "event_id long, track_id long, x double, y double").repartition(3)
    want = {(e, i, j) for e, i, x, y in rows for f, j, u, v in rows if e == f and i < j and math.hypot(x - u, y - v) < cut}
    assert {(r.event_id, r.t1, r.t2) for r in track.close_pairs(t, cut).collect()} == want
    assert {(r.event_id, r.track_id) for r in track.close_tracks(t, cut).collect()} == {(e, k) for e, i, j in want for k in (i, j)}
    tracks = t.filter("track_id % 3 = 0").select("event_id", F.col("x").alias("px"), F.col("y").alias("py"), F.lit(False).alias("inside"))
    free = {r.track_id for r in efficiency.fakes_by_radius(t, tracks, cut).collect()}
    assert free == {j for f, j, u, v in rows if not any(e == f and i % 3 == 0 and (x - u) ** 2 + (y - v) ** 2 < cut * cut for e, i, x, y in rows)}
