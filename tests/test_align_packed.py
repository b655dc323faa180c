from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.operators import align
from tests.test_align import SCHEMA, plane, spots


def test_tracks_without_a_line_do_not_count(spark):
    """One point, two on one plane, or a point without a place: before, a division by zero or no number at all."""
    planes = [plane(k) for k in range(5)]
    rows = spots([replace(p, position=(0.02, -0.01, 200.0)) if k == 2 else p for k, p in enumerate(planes)], 200)
    odd = [(900, 1, "P2", 0.1, 0.1), (901, 1, "P2", 0.1, 0.1), (901, 1, "P2", 0.3, 0.1), (902, 1, "P1", 0.0, 0.0), (902, 1, "P2", None, 0.0), (902, 1, "P3", 0.0, 0.0)]
    found = align.track_chi2(spark.createDataFrame(rows + odd, SCHEMA), planes, ("x", "y"), ("P0", "P1", "P3", "P4"))
    assert found.detectors[2].position == pytest.approx((0.02, -0.01, 200.0), abs=1e-6)


def test_sums_are_those_of_plain_least_squares(spark):
    """chi2 and its slope by the corrections, tracks refitted, against differences; one track lacks a plane, one has two points on one."""
    planes, dofs = [plane(k) for k in range(4)], ("x", "y", "rz")
    rows = spots(planes, 60, noise=0.02, lost=((3, "P1"),)) + [(5, 35, "P2", 0.2, 0.1)]
    tracks = align.packed(align.track_rows(spark.createDataFrame(rows, SCHEMA), planes)).cache()
    assert tracks.count() <= 8 * tracks.rdd.getNumPartitions()
    of = lambda step: align.normal_equations(tracks, [align.with_change(d, dofs, step[3 * k : 3 * k + 3]) for k, d in enumerate(planes)], [0, 1, 2, 3], dofs)
    now = of(np.zeros(12))
    assert (now.tracks, now.points) == (60, len(rows))
    for i in range(12):
        step = np.eye(12)[i] * 1e-5
        up, down = of(step).chi2, of(-step).chi2
        assert (up - down) / 2e-5 == pytest.approx(-2 * now.vector[i], rel=1e-3, abs=0.5)
        if i % 3 < 2:  # shifts are linear; a turn is so to first order only
            assert (up + down - 2 * now.chi2) / 1e-10 == pytest.approx(2 * now.matrix[i, i], rel=1e-3)
    assert "lambda" not in tracks.select(F.length("n"))._jdf.queryExecution().executedPlan().toString()
