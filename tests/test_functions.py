import math

import pytest
from pyspark.sql import functions as F

from beamloom.functions import coords, hist, units
from beamloom.plans import config
from beamloom.sources import geometry


def test_units(spark):
    for text, want in (("50um", 0.05), ("5mrad", 0.005), ("690us", 690e3), ("1.5", 1.5), ("2 cm", 20.0), ("120.0GeV", 0.0), ("x", 0.0), (3, 3.0), ("90deg", math.pi / 2)):
        assert units.parse(text) == pytest.approx(want)
    rows = [("50um",), ("5mrad",), ("1.5",), ("1e3ns",), ("7 GeV",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(units.unit_to_base(F.col("s"))).collect()]
    assert got == pytest.approx([0.05, 0.005, 1.5, 1000.0, 0.0, 0.0])
    assert units.display(0.05, "length") == "50um" and units.display(2.5e6, "time") == "2.5ms"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.999, 1.0, 4.0, -0.1, 5.0, float("nan"), None)], "v double")
    assert {(r.bin, r.content) for r in hist.bins_1d(df, "v", 5, 0, 5).collect()} == {(0, 2.0), (1, 1.0), (4, 1.0)}
    s = hist.stats_1d(df, "v", 0, 5).first()
    assert (s.entries, s.sum_w) == (6, 4.0) and s.mean == pytest.approx(5.999 / 4)
    assert hist.stats_1d(df, "v", 0, 5, merged=True).first().entries == 4


def test_truncation_puts_values_below_into_bin_zero(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(coords.bin_2d(F.col("v"), F.lit(0.0), 1.0)).collect()] == [0, 0, -1]


def test_running_ratio_over_blocks(spark):
    rows = [(i * 37 % 20000, i % 3 == 0) for i in range(3000)]
    got = {r.e: r.ratio for r in hist.running_ratio(spark.createDataFrame(rows, "e long, p boolean"), F.col("p"), "e").collect()}
    p = n = 0
    for e, passed in sorted(rows):
        p, n = p + passed, n + 1
        assert got[e] == pytest.approx(p / n)


def test_polygon(spark):
    pts = spark.createDataFrame([(5.0, 5.0), (0.5, 9.9), (12.0, 5.0), (-1.0, 3.0)], "x double, y double")
    inside = [r[0] for r in pts.select(coords.inside_polygon(F.col("x"), F.col("y"), [(0, 0), (10, 0), (10, 10), (0, 10)])).collect()]
    assert inside == [True, True, False, False]


def test_acceptance_and_groups(spark):
    d = spark.createDataFrame([(-0.5, 0.0), (9.5, 0.0), (9.6, 0.0), (3.0, 5.0), (3.0, 5.01)], "col double, y double")
    got = [r[0] for r in d.select(coords.has_intercept(F.col("col"), F.col("y"), F.lit(10), F.lit(10.0), F.lit(1.0), 0.0)).collect()]
    assert got == [True, True, False, True, False]
    c = spark.createDataFrame([(x,) for x in (3, 9, 16, 17, -1)], "c int")
    assert [r[0] for r in c.select(coords.trigger_group(F.col("c"))).collect()] == [0, 1, 0, 1, -1]


def test_geometry_round_trip(spark, tmp_path):
    text = '[General]\ndies_file = "dies.toml"\n\n[A]\ntype = "t"\nposition = ["1mm", 0, "10cm"]\norientation = [0, "90deg", 0]\nnumber_of_pixels = [4, 2]\npixel_pitch = ["50um", "1mm"]\npitch_x_gap = "30um"\n\n[B]\nposition = [0, 0, 0]\nnumber_of_pixels = [1, 1]\n'
    (tmp_path / "g.toml").write_text(text)
    (tmp_path / "dies.toml").write_text('[[A.dies]]\nname = "L"\npixels = [[0, 0], [1, 0]]\n')
    a, b = geometry.read(str(tmp_path / "g.toml"))
    assert a.position == (1.0, 0.0, 100.0) and a.effective_pitch() == pytest.approx((0.06, 1.0)) and a.size() == pytest.approx((0.23, 2.0)) and a.dies == {"L": [(0, 0), (1, 0)]}
    row = geometry.table(spark, [a, b]).filter("detector = 'A'").first()
    assert row.r00 == pytest.approx(0.0) and row.r02 == pytest.approx(1.0) and row.has_dies
    assert geometry.die_table(spark, [a, b]).count() == 2
    a.position = (2.0, 3.0, 4.0)
    geometry.write(str(tmp_path / "h.toml"), str(tmp_path / "g.toml"), [a, b])
    new = geometry.read(str(tmp_path / "h.toml")) if (tmp_path / "h.toml").exists() else []
    assert new[0].position == (2.0, 3.0, 4.0) and (tmp_path / "h.toml").read_text().count("\n") == text.count("\n")


def test_config():
    text = 'batch = 5\n[Global]\nout = "x"\n[MaskCreator]\nfrequency_cut = 3\n[[Analysis]]\nname = "a"\ncuts = "50um"\n[[Analysis]]\nname = "b"\ncuts = [1, "2um"]\n'
    m, a, b = config.parse(text, ("MaskCreator.frequency_cut=7", "a.flag=true", "Analysis.mode=fast"))
    assert [x.name for x in (m, a, b)] == ["MaskCreator", "a", "b"] and m.number("frequency_cut") == 7
    assert a.flag("flag") and not b.flag("flag") and b.text("mode") == "fast" and a.list("cuts") == [0.05] and b.list("cuts") == [1.0, 0.002] and m.text("out") == "x" and m.number("batch") == 5
    with pytest.raises(KeyError):
        config.run([config.Block("Nothing")], {})


def test_names_and_lists(spark):
    assert units.cfd_folder(0.2) == "cfd_0.20" and units.padded(7, 3) == "007" and units.listed(" a, b,, c ") == ["a", "b", "c"] and units.listed("") == []
    d = spark.createDataFrame([("A", "tel"), ("B", "dut")], "name string, kind string")
    found = {r["name"]: r.x for r in d.select("name", coords.is_excluded(F.col("name"), F.col("kind"), ["dut", "C"]).alias("x")).collect()}
    assert found == {"A": False, "B": True}
    assert not any(r.x for r in d.select(coords.is_excluded(F.col("name"), F.col("kind"), []).alias("x")).collect())


def test_a_pixel_of_two_dies_goes_to_the_first_of_the_file(spark):
    table = geometry.die_table(spark, [geometry.Detector("D", dies={"Z": [(0, 0), (1, 0)], "A": [(1, 0), (2, 0)]})])
    at = spark.createDataFrame([("D", 0.4, 0.0), ("D", 1.2, 0.0), ("D", 2.0, 0.0), ("D", 3.0, 0.0)], "detector string, col double, row double")
    assert [r.die for r in geometry.with_die(at, table).orderBy("col").collect()] == ["Z", "Z", "A", ""]
