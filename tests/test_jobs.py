import os
import subprocess
import sys

from pyspark.sql import functions as F

from beamloom.operators import plots
from beamloom.streaming import building
from jobs import build_events, histograms, registered, settings

SF, ROOT = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def order(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_events_of_a_growing_input(spark, tmp_path):
    config = settings.read(f"{ROOT}/jobs/build_events.toml") | {"files_per_batch": 2}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    where = [str(tmp_path / n) for n in ("in", "out", "at")]
    before = spark.conf.get(building.STATE_STORE[0], None)
    found = []
    for low, high in ((0, 300), (300, 301), (301, 700), (700, 10**9)):
        events.filter(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(where[0])
        found.append(order(build_events.run(spark, *where, config)))
        assert order(build_events.run(spark, *where, config)) == found[-1]  # nothing new
    assert spark.conf.get(building.STATE_STORE[0], None) == before
    for a, b in zip(found, found[1:], strict=False):
        assert set(a) <= set(b)  # what is written stays
    whole = building.windowed(build_events.sub_events(events, config["columns"]), "click", "end_of_run")
    last = whole.groupBy("run").agg(F.max("event_id").alias("last"))  # is open
    want = whole.join(last, "run").filter("event_id < last").select("run", "event_id", "number", "seq", "producer", "window_ts")
    assert found[-1] == order(want) and found[0] and found[0] != found[-1]


def test_end_of_run_closes_the_last_window(spark, tmp_path):
    where = [str(tmp_path / n) for n in ("in", "out", "at")]
    config = {"master": "", "end": "end_of_run", "max_windows": 0, "files_per_batch": 0, "columns": {n: n for n in build_events.FIELDS}}
    schema = "run long, seq long, producer string, number long, begin long, end long"
    spark.createDataFrame([(4, -1, "a", 1, 0, 0)], schema).write.parquet(where[0])
    assert order(build_events.run(spark, *where, config)) == []  # no window is closed yet
    spark.createDataFrame([(4, 0, "a", 1, 0, 0), (4, 1, "b", 1, 10, 30), (4, 2, "a", 2, 2000, 2000)], schema).write.mode("append").parquet(where[0])
    closed = [(4, 0, 1, -1, "a", 0.02), (4, 0, 1, 0, "a", 0.02), (4, 0, 1, 1, "b", 0.02)]
    assert order(build_events.run(spark, *where, config)) == closed
    spark.createDataFrame([(4, 3, "end_of_run", None, None, None)], schema).write.mode("append").parquet(where[0])
    assert order(build_events.run(spark, *where, config))[3:] == [(4, 1, 2, 2, "a", 2.0)]
    assert any(n.startswith("run=4") for n in os.listdir(where[1]))


def test_histograms_of_a_growing_input(spark, tmp_path):
    config = settings.read(f"{ROOT}/jobs/histograms.toml")
    where = [str(tmp_path / n) for n in ("in", "out", "at")]
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "documents")}
    for share in (0, 1):
        for name, df in tables.items():
            key = "l_orderkey" if name == "lineitem" else "doc_id"
            df.filter(F.col(key) % 2 == share).write.mode("append").parquet(f"{where[0]}/{name}.parquet")
        got = order(histograms.run(spark, *where, config))
        assert order(histograms.run(spark, *where, config)) == got
    want = []
    for name, df in tables.items():
        for p in config["plot"]:
            if p["table"] == name:
                filled = plots.entries(df, plots.places(F.expr(p["path"])), [histograms.plot(p)])
                want += order(plots.bins(filled).select(F.lit(name).alias("table"), "path", "plot", "ix", "iy", "content"))
    assert got == sorted(want, key=repr)
    stats = spark.read.parquet(f"{where[1]}/hist_stats").filter("table = 'lineitem' AND plot = 'hitCharge'")
    plain = tables["lineitem"].groupBy(F.concat(F.lit("P"), F.col("l_linenumber") - 1).alias("path")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    assert {r.path: (r.entries, round(r.mean_x, 6)) for r in stats.collect()} == {r.path: (r.n, round(r["mean"], 6)) for r in plain.collect()}
    one = {"files_per_batch": 9, "plot": [p for p in config["plot"] if p["table"] == "documents"]}
    histograms.run(spark, where[0], where[1], where[2], one)  # other tables' partitions stay
    assert order(spark.read.parquet(f"{where[1]}/hist_bins").select("table", "path", "plot", "ix", "iy", "content")) == got


def test_registered_jobs_take_new_folders(spark):
    first, second = (order(registered.job2_histograms(spark, SF)) for _ in range(2))
    assert first == second and first


def test_command_line(tmp_path):
    call = [sys.executable, "-m", "jobs.build_events", "--config", "jobs/build_events.toml", "--input", f"{SF}/events.parquet", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "at")]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert "jobs.build_events" in done.stderr and "new rows of" in done.stderr and any(n.startswith("run=") for n in os.listdir(tmp_path / "out"))
