import datetime

import numpy as np
from pyspark.sql import functions as F

from beamloom.functions import near
from beamloom.operators import assoc, track
from beamloom.plans import catalogue
from beamloom.sources import daq
from beamloom.sources import hits as hit_sources


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offset_texts_are_read_once_each(spark):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else "CH0 : 0 CH1: 65535" if i % 3 == 1 else "CH1 : 13107") for i in range(90)], "i long, dac string")
    got = daq.with_offsets(d, F.col("dac"))
    assert got.columns == ["i", "dac", "offsets"]
    want = {0: None, 1: {0: -0.5, 1: 0.5}, 2: {1: 13107 / 65535 - 0.5}}
    rows = got.collect()
    assert len(rows) == 90 and all(r.offsets == want[r.i % 3] for r in rows)


def test_closest_of_places_as_far_but_for_rounding(spark):
    t = spark.createDataFrame([(1, 1, 0.3, 0.0, "a", 0.0)], "event_id long, track_id long, px double, py double, die string, ts double")
    c = spark.createDataFrame([(1, 10, 0.5, 0.0, "a", 0.0), (1, 11, 0.1, 0.0, "a", 0.0)], "event_id long, cluster_id long, x double, y double, die string, ts double")
    e = assoc.examined(t, c.withColumn("pixels", F.array(F.struct("x", "y"))), 1.0, 1.0)
    assert [tuple(r) for r in assoc.closest(e).collect()] == [(1, 1, 10)]


def test_follow_on_the_border_of_the_ellipse(spark):
    """The line is at 7 where z is 200, six from the cluster at 1; a start and a slope, each rounded, put it farther away."""
    rows = [(1, 0, 10, 0.0, 0.0, 0.0), (1, 2, 11, 1.0, 0.0, 200.0), (1, 6, 12, 21.0, 0.0, 600.0)]
    c = spark.createDataFrame([(*r, 0.0, 1.0) for r in rows], "event_id long, plane int, cluster_id long, x double, y double, z double, ts double, w double")
    assert [r.members for r in track.follow(c, [(2, 200.0)], 6.0, 6.0, min_hits=2).collect()] == [[10, 12, 11]]
    assert [r.members for r in track.follow(c, [(2, 200.0)], 6.0, 3.0, min_hits=2).collect()] == [[10, 12, 11]]
    assert [r.members for r in track.follow(c, [(2, 200.0)], 5.99, 6.0, min_hits=2).collect()] == [[10, 12]]


def test_files_are_not_dealt_by_file(spark):
    h = spark.range(1000).select(F.col("id").alias("event_id"))
    out = hit_sources.union_files([h, h], [500, 300])
    assert out.count() == 800 and out.agg(F.max("event_id")).first()[0] == 1299
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with hits whose size the planner takes for large
    try:
        assert "SortMergeJoin" not in plan(hit_sources.union_files([h, h], [500, 300]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_track_is_sent_to_few_cells(spark):
    rng = np.random.default_rng(5)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (2000, 2)))], "track_id long, x double, y double")
    assert near.wide_ahead(t, "x", "y", 1.0).count() < 2 * 2000
    p = t.withColumn("event_id", F.lit(1))
    here = p.select("track_id", "x", "y").collect()
    a = np.array([[r.x, r.y] for r in here])
    want = int((np.triu(np.hypot(*(a[:, None] - a[None]).transpose(2, 0, 1)) < 1.0, 1)).sum())
    assert track.close_pairs(p, 1.0).count() == want > 0


def against_sql(spark, folder, name, rows, schema, table):
    """What a query gives, and what its SQL gives, on one small table."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.queries()[name](spark, str(folder)).collect())), sorted(map(tuple, con.sql(catalogue.oracle_sql()[name]).fetchall()))


def test_a_pulse_beyond_the_range_of_its_plot(spark, tmp_path):
    """The second trace has a signal-to-noise ratio of some 10,000; the plot of them ends at 5,000."""
    shape = [[0.1, 0.12, 0.11, 0.13, 0.05, 0.6, 0.9, 0.4, 0.1, 0.2], [0.1, 0.1001, 0.2, 0.05, 0.5, 0.6, 0.9, 0.4, 0.1, 0.2]]
    got, want = against_sql(spark, tmp_path, "plots_waveforms", [(i, i, s) for i, s in enumerate(shape)], "vec_id long, label int, embedding array<float>", "embeddings")
    snr = [r for r in got if r[1] == "raw_snr"]
    assert got == want and snr[0][2:4] == (2, 2.0) and snr[0][4] > 2500


def test_a_cluster_beyond_the_range_of_its_plots(spark, tmp_path):
    """All 576 pixels of a detector in one cluster; the plots end at 99.5 pixels and a charge of 49,999.5."""
    day = datetime.datetime(2020, 1, 1)
    rows = [(1, 1, c, r, 100.0, day) for c in range(24) for r in range(24)]
    got, want = against_sql(spark, tmp_path, "plots_clustering", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp_ntz", "lineitem")
    assert got == want and ("P0", "clusterSize", 1, 1.0, 576.0) in got
