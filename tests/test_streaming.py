import random

import pytest
from pyspark.sql import functions as F

from beamloom.functions import scan
from beamloom.operators import plots
from beamloom.streaming import batches, building

SUB = "run long, seq long, producer string, number long, begin long, end long"


@pytest.fixture
def stateful(spark):
    key, value = building.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 0), ("b", 1, 1), ("a", 3, 2), ("a", 2, 3), ("b", 2, 4), ("a", 3, 5), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "producer string, number long, seq long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(building.stream_in_order(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "append", "kept")
    got = sorted(tuple(r) for r in spark.table("kept").collect())
    assert got == sorted(tuple(r) for r in building.in_order(df).select("producer", "number", "seq").collect()) == sorted(rows[:3] + rows[4:6])
    drain(building.stream_histogram(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "number", 4, 0, 4), "complete", "bins")
    assert {tuple(r) for r in spark.table("bins").collect()} == {(1, 3), (2, 2), (3, 2)}


def test_windows(spark):
    sub = spark.createDataFrame([("m", 1, 0), ("s", 1, 1), ("s", 2, 2), ("m", 3, 3), ("s", 3, 4), ("s", 1, 5)], "producer string, number long, seq long")
    assert {tuple(r) for r in building.symmetric(sub).collect()} == {(1, 2, 2), (2, 1, 1), (3, 2, 2)}
    assert {tuple(r) for r in building.master_anchored(sub, "m").collect()} == {(1, 2), (3, 2)}
    e = spark.range(10).select(F.col("id").alias("event_id"))
    assert {tuple(r) for r in building.tumbling(e, 4).collect()} == {(0, 4), (1, 4), (2, 2)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_over_blocks(spark, inclusive):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    values = {"hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "all": ("sum", F.col("v"))}
    got = {r.i: (r.hi, r.lo, r["all"]) for r in scan.running(df, ("g",), ("i",), values, inclusive, block=16).collect()}
    for g, i, _ in rows:
        seen = [v for h, k, v in rows if h == g and v is not None and (k < i or inclusive and k == i)]
        assert got[i] == ((max(seen), min(seen), sum(seen)) if seen else (None, None, None))


def events(rows, master=None, end=None, limit=0):
    """Event building one sub-event after the other: a window, and a buffer for what is ahead of it."""
    out, state = [], {}
    for run, seq, producer, number, begin, stop in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(run, {"window": None, "events": [], "ahead": [], "n": 0, "over": False})

        def close(s=s, run=run):
            if s["window"] is not None and not s["over"]:
                ts = next(((b + e) / 2000 for *_, b, e in s["events"] if b or e), 0.0)
                out.extend((run, s["n"], s["window"], q, p, ts) for q, p, _, _ in s["events"])
                s["n"] += 1
                s["over"] = bool(limit) and s["n"] >= limit
            s["window"] = None

        if s["over"] or producer == end is not None:
            close()
            s["over"] = True
            continue
        me = (seq, producer, begin or 0, stop or 0)
        if number is None or s["window"] is not None and number < s["window"]:
            continue
        if s["window"] is not None and number == s["window"]:
            s["events"].append(me)
        elif master is None or producer == master:
            close()
            ready = [a for n, a in s["ahead"] if n == number]
            s["ahead"] = [(n, a) for n, a in s["ahead"] if n > number]
            s.update(window=number, events=[me, *ready])
        else:
            s["ahead"].append((number, me))
    return out, state


def raw(seed, runs=3, n=150):
    """In order, late, ahead, skipped and empty numbers; times often missing."""
    rng, rows, seq = random.Random(seed), [], 0
    at = {r: 0 for r in range(runs)}
    for _ in range(n * runs):
        run = rng.choice([0, 0, *range(runs)])
        at[run] += rng.random() < 0.4
        number = at[run] + rng.choice([0, 0, 0, 0, -1, -3, 1, 2, 4])
        times = rng.choice([(None, None), (0, 0), (seq * 10, seq * 10 + 7)])
        rows.append((run, seq, rng.choice(["m", "m", "s", "t", None]), rng.choice([number] * 30 + [None]), *times))
        seq += 1
    return rows


def closed(rows, master, limit):
    """The windows at the end of the input, where that ends all runs."""
    runs = sorted({r[0] for r in rows})
    return events([*rows, *[(r, 10**6 + r, "END", None, None, None) for r in runs]], master, "END", limit)[0]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("master, limit", [(None, 0), ("m", 0), ("m", 7), (None, 5)])
def test_batch_windows_against_one_by_one(spark, master, limit, monkeypatch):
    rows = raw(1)
    df = spark.createDataFrame([*rows, (None, 3, "m", 1, 1, 1)], SUB).repartition(5)
    got = order(tuple(r) for r in building.windowed(df, master, "END", limit).collect())
    assert got == order(closed(rows, master, limit)) and got
    ended = [*rows[:200], (0, 199.5, "END", 5, None, None), *rows[200:]]
    ended = [(r[0], i, *r[2:]) for i, r in enumerate(ended)]
    got = order(tuple(r) for r in building.windowed(spark.createDataFrame(ended, SUB), master, "END", limit).collect())
    assert got == order(closed(ended, master, limit))
    summed = building.windows(building.windowed(df, master))
    assert {(r.run, r.event_id): (r.number, r.parts, r.window_ts) for r in summed.collect()} == {
        (a, b): (n, sum(1 for x in closed(rows, master, 0) if x[:2] == (a, b)), ts) for a, b, n, _, _, ts in closed(rows, master, 0)
    }
    assert building.windowed(df.limit(0), master).count() == 0


@pytest.mark.parametrize("master, limit", [(None, 0), ("m", 0), ("m", 7)])
def test_stream_windows_over_restarts(stateful, tmp_path, master, limit):
    spark, rows, taken = stateful, raw(2), []
    where = {n: str(tmp_path / n) for n in ("in", "out", "at")}
    ends = [(r, 10**6 + r, "END", 0, None, None) for r in range(3)]
    parts = [rows[:100], rows[100:101], rows[101:400], [*rows[400:], ends[0]], [(0, 2 * 10**6, "m", 10**6, 1, 1), *ends[1:]]]
    for part in parts:  # each a run of the stream of its own, on the same checkpoint
        spark.createDataFrame(part, SUB).repartition(3).write.mode("append").parquet(where["in"])
        for _ in range(2):  # the second finds nothing new
            stream = spark.readStream.schema(SUB).parquet(where["in"])
            out = building.stream_windowed(stream, master, "END", limit)
            q = out.writeStream.format("parquet").option("path", where["out"]).option("checkpointLocation", where["at"]).trigger(availableNow=True).start()
            q.awaitTermination()
        taken += part
        got = order(tuple(r) for r in spark.read.parquet(where["out"]).collect()) if (tmp_path / "out").exists() else []
        assert got == order(events(taken, master, "END", limit)[0])
    batch = building.windowed(spark.createDataFrame(taken, SUB), master, "END", limit)
    assert got == order(tuple(r) for r in batch.collect()) and got


def hits(n, first=0):
    return [(first + i // 3, f"P{i % 4}", float(i % 7), float("nan") if i % 11 == 0 else i * 0.5) for i in range(n)]


def fill(rows):
    entries = plots.entries(rows, plots.places(F.col("detector")), [plots.Plot("charge", "charge", 5, 0, 5), plots.Plot("map", "charge", 3, 0, 6, "ts", 4, 0.0, 100.0)])
    counts = rows.groupBy("detector").agg(F.count("*").alias("hits"), F.count(F.when(F.col("charge") > 3, 1)).alias("passed"))
    return batches.filled(entries) | {"cut_flow": counts}


def run_tables(spark, folder):
    t = batches.histograms(spark, folder) | {"cut_flow": batches.merged(spark, folder, "cut_flow", ("detector",))}
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    return {n: order(rounded(r) for r in df.select(*sorted(df.columns)).collect()) for n, df in t.items()}


def test_micro_batches_give_the_whole_runs_tables(spark, tmp_path):
    schema = "event_id long, detector string, charge double, ts double"
    where = {n: str(tmp_path / n) for n in ("in", "sums", "at", "whole", "at2")}
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where["in"])
    spark.createDataFrame(hits(60), schema).repartition(2).write.parquet(where["in"])
    batches.accumulated(stream(), fill, where["sums"], where["at"]).awaitTermination()
    spark.createDataFrame(hits(45, 20), schema).repartition(3).write.mode("append").parquet(where["in"])
    fails = {"left": 1}

    def failing(rows):  # once, after the first of its tables
        tables = fill(rows)
        if fails["left"] and rows.count():
            fails["left"] = 0
            return {"hist_bins": tables["hist_bins"], "cut_flow": rows.select(F.raise_error(F.lit("lost")).alias("detector"))}
        return tables

    with pytest.raises(Exception, match="lost"):
        batches.accumulated(stream(), failing, where["sums"], where["at"]).awaitTermination()
    batches.accumulated(stream(), fill, where["sums"], where["at"]).awaitTermination()
    batches.accumulated(stream(), fill, where["sums"], where["at"]).awaitTermination()
    whole = spark.readStream.schema(schema).parquet(where["in"])
    batches.accumulated(whole, fill, where["whole"], where["at2"]).awaitTermination()
    got = run_tables(spark, where["sums"])
    assert got == run_tables(spark, where["whole"])
    assert sum(hits for _, hits, _ in got["cut_flow"]) == 105
    rows = spark.read.schema(schema).parquet(where["in"])
    entries = plots.entries(rows, plots.places(F.col("detector")), [plots.Plot("charge", "charge", 5, 0, 5), plots.Plot("map", "charge", 3, 0, 6, "ts", 4, 0.0, 100.0)])
    assert order(tuple(r) for r in plots.bins(entries).select("content", "ix", "iy", "path", "plot").collect()) == got["hist_bins"]
