import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.operators import align
from beamloom.sources import geometry
from beamloom.sources.geometry import Detector


def plane(k, **change):
    return replace(Detector(f"P{k}", position=(0.0, 0.0, 100.0 * k), n_cols=100, n_rows=100, pitch_x=0.2, pitch_y=0.2, res_x=0.01, res_y=0.01), **change)


def spots(planes, tracks=400, seed=3, noise=0.0, lost=()):
    """Where random straight lines meet planes as they truly lie, in their own frames."""
    r = np.random.default_rng(seed)
    rows = []
    for e in range(tracks):
        c, m = np.append(r.uniform(-8, 8, 2), 0.0), np.append(r.normal(0, 5e-3, 2), 1.0)
        for d in planes:
            rot, p = np.array(d.rotation()), np.array(d.position)
            t = rot[:, 2] @ (p - c) / (rot[:, 2] @ m)
            u, v, _ = rot.T @ (c + t * m - p)
            if (e, d.name) not in lost:
                rows.append((e, e * 7, d.name, float(u + r.normal(0, noise)), float(v + r.normal(0, noise))))
    return rows


SCHEMA = "event_id long, track_id long, detector string, u double, v double"


def test_limits_of_chi2():
    assert [align.chi2_limit(m, 1) for m in (1, 2, 3)] == [1.0, 4.0, 9.0]
    assert [align.chi2_limit(1, 2), align.chi2_limit(2, 3), align.chi2_limit(3, 2)] == [1.1479, 2.675, 5.9146]
    assert align.chi2_limit(1, 0) == 0.0 and align.chi2_limit(3, -2) == 0.0
    assert align.chi2_limit(1, 31) == pytest.approx((0.47523 + math.sqrt(59)) ** 2 / 60, abs=1e-5)
    assert align.chi2_limit(9, 5) == align.chi2_limit(3, 5)


def test_plateau(spark):
    def plateau(content, low, high, width=0.0, pitch=0.0):
        rows = [(k, i, float(c), width, pitch) for k in "ab" for i, c in enumerate(content) if c]
        got = align.plateaus(spark.createDataFrame(rows, "k string, bin int, content double, width double, pitch double"), ("k",), len(content), low, high).collect()
        assert len({tuple(r)[1:] for r in got}) <= 1 and len(got) in (0, 2)
        return align.Plateau(*tuple(got[0])[1:]) if got else None

    box = np.zeros(200)
    box[80:120] = 50.0
    f = plateau(box, 0.0, 100.0, 20.0, 5.0)
    assert f.centre == pytest.approx(50.0, abs=0.3) and f.width == pytest.approx(20.0, abs=0.6) and not f.warning
    f = plateau(box + 10.0, 0.0, 100.0, 20.0, 5.0)
    assert f.centre == pytest.approx(50.0, abs=0.3) and f.width == pytest.approx(20.0, abs=0.6)
    dip = box.copy()
    dip[98:102] = 5.0  # two channels with a gap
    assert plateau(dip, 0.0, 100.0, 20.0).width == pytest.approx(20.0, abs=0.6)
    half = np.zeros(200)
    half[80:100] = 50.0
    half[104:112] = 11.0  # what is left of a weak channel on the high side
    f = plateau(half, 0.0, 100.0, 20.0, 8.0)
    assert f.centre == pytest.approx(45.0 + 4.0, abs=0.5) and "high" in f.warning
    half[104:112] = 0.0
    f = plateau(half, 0.0, 100.0, 20.0, 8.0)
    assert f.centre == pytest.approx(45.0, abs=0.5) and "not moved" in f.warning
    assert plateau(np.ones(10), 0, 1) is None
    wide = np.zeros(200)
    wide[70:130] = 50.0
    assert "differs" in plateau(wide, 0.0, 100.0, 24.0).warning


def test_layouts_with_rules_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(geometry, "LAYOUTS", dict(geometry.LAYOUTS))
    halves = lambda d: {"LEFT": [(c, r) for c in range(d.n_cols // 2) for r in range(d.n_rows)], "RIGHT": [(c, r) for c in range(d.n_cols // 2, d.n_cols) for r in range(d.n_rows)]}
    geometry.register("pads", geometry.Layout(lambda d: (3 * d.pitch_x, d.pitch_y), halves, "pads"))
    d, plain = (Detector("D", layout=n, position=(0.0, 0.0, 10.0), n_cols=2, n_rows=1, pitch_x=1.0, pitch_y=1.0) for n in ("pads", ""))
    assert d.effective_pitch() == (3.0, 1.0) and d.size() == (4.0, 1.0) and plain.size() == (2.0, 1.0)
    assert d.die_labels() == ["LEFT", "RIGHT"] and d.has_die_split() and not plain.has_die_split()
    assert replace(d, dies={"file": [(0, 0)]}).die_labels() == ["file"]
    at = spark.createDataFrame([("D", 0.2, 0.0), ("D", 1.0, 0.0)], "detector string, col double, row double")
    assert [r.die for r in geometry.with_die(at, geometry.die_table(spark, [d])).orderBy("col").collect()] == ["LEFT", "RIGHT"]
    r = np.random.default_rng(5)  # two pads of 1 x 1 round 2 and 5, and none between
    rows = [(float(x), float(y), 0.0, 0.0) for x, y in zip(np.concatenate([r.uniform(1.5, 2.5, 3000), r.uniform(4.5, 5.5, 3000)]), r.uniform(-3.5, -2.5, 6000), strict=True)]
    new, found = align.prealigned(spark.createDataFrame(rows, "cx double, cy double, mx double, my double"), d)
    assert new.position == pytest.approx((3.5, -3.0, 10.0), abs=0.05) and found["x"].width == pytest.approx(4.0, abs=0.1)


def test_millepede_recovers_rotations_and_shifts(spark):
    true = [plane(k) for k in range(6)]
    true[2] = plane(2, position=(0.05, -0.03, 200.0), orientation=(0.01, -0.008, 0.004))
    true[4] = plane(4, position=(-0.04, 0.02, 400.0), orientation=(-0.006, 0.012, -0.003))
    rows = spots(true, lost={(0, "P1"), (1, "P5")})
    rows += [(5000, 1, f"P{k}", 0.0 + 3.0 * (k == 3), 0.0) for k in range(6)]  # an outlier
    points = spark.createDataFrame(rows, SCHEMA).cache()
    got = align.millepede(points, [plane(k) for k in range(6)], fixed=("P0", "P1", "P5"), iterations=3, inner=3, residual_cut_init=2.0, residual_cut=1.0, sigmas=dict.fromkeys(align.DOFS, 10.0), constrained=False)
    for a, b in zip(got.detectors, true, strict=True):
        assert a.position == pytest.approx(b.position, abs=1e-4) and a.orientation == pytest.approx(b.orientation, abs=1e-4), a.name
    points.unpersist()


def test_constraints_keep_the_whole_in_place(spark):
    true = [plane(k, position=(0.02 * (k == 2), 0.0, 100.0 * k)) for k in range(6)]
    got = align.millepede(spark.createDataFrame(spots(true, 200), SCHEMA), [plane(k) for k in range(6)], ("x", "y"), iterations=1, inner=2, residual_cut_init=9.0, residual_cut=9.0, sigmas=dict.fromkeys(align.DOFS, 10.0))
    x = np.array([d.position[0] for d in got.detectors])
    z = np.arange(6) - 2.5
    assert x.sum() == pytest.approx(0, abs=1e-9) and (x * z).sum() == pytest.approx(0, abs=1e-9)
    assert x[2] - np.delete(x, 2).mean() == pytest.approx(0.02, rel=0.4)


def test_track_chi2_recovers_five_degrees(spark):
    true = [plane(k) for k in range(5)]
    true[2] = plane(2, position=(0.06, -0.02, 200.0), orientation=(0.012, 0.009, -0.005))
    points = spark.createDataFrame(spots(true, 300), SCHEMA).cache()
    got = align.track_chi2(points, [plane(k) for k in range(5)], fixed=("P0", "P1", "P3", "P4"), iterations=1, evaluations=6)
    assert got.detectors[2].position == pytest.approx(true[2].position, abs=1e-4) and got.detectors[2].orientation == pytest.approx(true[2].orientation, abs=2e-4)
    assert {s[2] for s in got.steps} == {"x", "y", "rx", "ry", "rz"} and align.graphs(spark, got).count() == 5
    points.unpersist()


def dut(**change):
    return replace(Detector("D", position=(3.0, -2.0, 50.0), n_cols=4, n_rows=2, pitch_x=1.0, pitch_y=1.0, dies={"lo": [(c, 0) for c in range(4)], "hi": [(c, 1) for c in range(4)]}), **change)


def matched(spark, n, rows=(0, 1), turn=0.02, seed=1):
    r = np.random.default_rng(seed)
    u, v = r.integers(0, 4, n) - 1.5 + r.uniform(-0.4, 0.4, n), np.array(rows)[r.integers(0, len(rows), n)] - 0.5 + r.uniform(-0.4, 0.4, n)
    c, s = math.cos(turn), math.sin(turn)
    return spark.createDataFrame([(float(3.1 + c * a - s * b), float(-2.05 + s * a + c * b), 50.0) for a, b in zip(u, v, strict=True)], "gx double, gy double, gz double")


def test_dut_is_moved_and_turned(spark):
    new, steps, good = align.align_dut(matched(spark, 8000), dut(), bin_size=(0.05, 0.05))
    assert good.all() and new.position == pytest.approx((3.1, -2.05, 50.0), abs=0.02) and new.orientation[2] == pytest.approx(0.02, abs=6e-3)
    assert all(abs(b) < abs(a) for a, b in zip(steps, steps[1:], strict=False))


def test_a_bad_die_is_left_out_and_its_offset_taken_off(spark):
    new, _, good = align.align_dut(matched(spark, 4000, rows=(0,), turn=0.0), dut(), rotate=False, bin_size=(0.05, 0.05))
    assert good[:, 0].all() and not good[:, 1].any()
    assert new.position == pytest.approx((3.1, -2.05, 50.0), abs=0.03)
    few, _, good = align.align_dut(matched(spark, 60), dut(), bin_size=(0.05, 0.05))
    assert not good.any() and few == dut()
    _, _, last = align.align_dut(matched(spark, 8000), dut(dies={}), rotate=False, translate=False, row=1, bin_size=(0.05, 0.05))
    assert last[:, 1].all() and not last[:, 0].any()


def test_prealignment_of_a_dut(spark):
    r = np.random.default_rng(4)
    rows = [(float(x), float(y), 0.0, 0.0) for x, y in zip(r.uniform(1.0, 5.0, 6000), r.uniform(-4.0, -2.0, 6000), strict=True)]
    t = spark.createDataFrame(rows, "cx double, cy double, mx double, my double")
    new, found = align.prealigned(t, dut(position=(0.0, 0.0, 50.0)))
    assert new.position == pytest.approx((3.0, -3.0, 50.0), abs=0.05) and found["x"].width == pytest.approx(4.0, abs=0.1)
    assert align.prealigned(t.filter(F.lit(False)), dut())[0] == dut()
