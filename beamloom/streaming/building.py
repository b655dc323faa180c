"""Event building from sub-events of several producers, in batch and as a stream.

A run's sub-events (run, seq, producer, number, begin, end; (run, seq) is the order in which they were read) become windows of equal
number. A window is opened by the anchor: any sub-event, or those of one master producer. With W the highest
anchor number so far, a sub-event below W is late and dropped; one above W waits until an anchor reaches its
number, and is an orphan if the anchors skip it. A window closes when a higher one opens, and the last one at
the end of its run. In batch the end of the input is the end of all runs; a stream learns it from a sub-event of the
producer `end`, after which a run takes no more.

Both ways have the same closed form: a sub-event belongs to a window if its number is an anchor's, and if no higher
anchor came before it. In batch the anchors' running maximum is a scan over blocks (`functions.scan`), so no task sees a
whole run. In the stream the state of a run is W, the number of windows so far, and the list of sub-events of
the open window and of those ahead of it.

Rows without run or number are none; a null producer is no anchor but the one of any producer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beamloom.functions import scan

#: The setting and the value that streams with state of this kind need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(sub: DataFrame, by: str = "producer", order: str = "seq") -> DataFrame:
    """Sub-events that are not late for their producer: a number below one that it sent before is a straggler and is dropped."""
    seen = scan.running(sub, (by,), (order,), {"__seen": ("max", F.col("number"))}, inclusive=False)
    return seen.filter(F.col("__seen").isNull() | (F.col("number") >= F.col("__seen"))).drop("__seen")


def symmetric(sub: DataFrame) -> DataFrame:
    """number, parts, producers: sub-events of equal number are one window."""
    return in_order(sub).groupBy("number").agg(F.count("*").alias("parts"), F.count_distinct("producer").alias("producers"))


def master_anchored(sub: DataFrame, master: str) -> DataFrame:
    """number, parts: windows for the master's numbers; others' sub-events without one are dropped."""
    kept = in_order(sub)
    anchors = kept.filter(F.col("producer") == master).select("number").distinct()
    return kept.join(anchors, "number", "left_semi").groupBy("number").agg(F.count("*").alias("parts"))


def tumbling(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy(F.floor(F.col("event_id") / size).alias("window")).agg(F.count("*").alias("n"))


# ---- windows of a run


def _middle() -> Column:
    """The middle of a sub-event's time window (ps) in ns; null without one."""
    begin, end = F.coalesce("begin", F.lit(0)), F.coalesce("end", F.lit(0))
    return F.when((begin != 0) | (end != 0), (begin + end) / 2000.0)


def windowed(sub: DataFrame, master: str | None = None, end: str | None = None, max_windows: int = 0) -> DataFrame:
    """run, event_id (windows of a run counted from 0), number, seq, producer, window_ts of each sub-event that belongs to a window.

    window_ts is the first time of the window's sub-events, the opening one first, 0 without any. `max_windows` ends a run after so many.
    """
    rows = sub.filter("run IS NOT NULL").select("run", "seq", "producer", "number", _middle().alias("__ts"))
    if end is not None:
        over = rows.filter(F.col("producer") == end).groupBy("run").agg(F.min("seq").alias("__end"))
        rows = rows.join(over, "run", "left").filter(F.col("__end").isNull() | (F.col("seq") < F.col("__end"))).drop("__end")
    rows = rows.filter("number IS NOT NULL")
    anchor = F.lit(True) if master is None else F.coalesce(F.col("producer") == master, F.lit(False))
    seen = scan.running(rows, ("run",), ("seq", "number", "producer"), {"__top": ("max", F.when(anchor, F.col("number")))}, inclusive=False)
    kept = seen.filter(F.col("__top").isNull() | (F.col("number") >= F.col("__top")))
    opened = kept.filter(anchor).groupBy("run", "number").agg(F.min("seq").alias("__open"))
    ranked = scan.running(opened, ("run",), ("number",), {"__n": ("sum", F.lit(1))}, inclusive=False).withColumn("event_id", F.coalesce("__n", F.lit(0)).cast("long"))
    if max_windows:
        ranked = ranked.filter(F.col("event_id") < max_windows)
    out = kept.join(ranked.drop("__n"), ["run", "number"])
    window = Window.partitionBy("run", "number")  # one event
    ts = F.min_by(F.col("__ts"), F.when(F.col("__ts").isNotNull(), F.struct(F.col("seq") != F.col("__open"), "seq"))).over(window)
    return out.select("run", "event_id", "number", "seq", "producer", F.coalesce(ts, F.lit(0.0)).alias("window_ts"))


def windows(rows: DataFrame) -> DataFrame:
    """run, event_id, number, parts, producers, window_ts: one row a window of `windowed` or `stream_windowed`."""
    return rows.groupBy("run", "event_id", "number").agg(F.count("*").alias("parts"), F.count_distinct("producer").alias("producers"), F.max("window_ts").alias("window_ts"))


_LOWEST = np.iinfo(np.int64).min
_WAITING = "seq long, producer string, number long, ts double, opens boolean"


class _Builder(StatefulProcessor):
    """The windows of a run, as its sub-events come in."""

    def __init__(self, master: str | None, end: str | None, max_windows: int):
        self.master, self.end, self.max_windows = master, end, max_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "top long, windows long, over boolean")
        self.waiting = handle.getListState("waiting", _WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top, done, over = self.at.get() if self.at.exists() else (_LOWEST, 0, False)
        if over:
            return
        new = pd.concat(list(rows)).sort_values(["seq", "number", "producer"], kind="stable")
        if self.end is not None:
            ends = np.flatnonzero((new["producer"] == self.end).to_numpy())
            over = len(ends) > 0
            new = new.iloc[: ends[0]] if over else new
        number = new["number"].to_numpy(np.int64)
        anchor = np.full(len(new), True) if self.master is None else (new["producer"] == self.master).to_numpy(bool)
        before = np.maximum.accumulate(np.concatenate([[top], np.where(anchor, number, _LOWEST)]))
        new = pd.DataFrame({"seq": new["seq"], "producer": new["producer"], "number": number, "ts": new["ts"], "opens": anchor & (number > before[:-1])})[number >= before[:-1]]
        top = int(before[-1])
        old = pd.DataFrame([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], columns=list(new.columns))
        held = pd.concat([f for f in (old, new) if len(f)]) if len(old) or len(new) else new
        closed = np.full(len(held), True) if over else (held["number"] < top).to_numpy(bool)
        ready, held = held[closed], held[~closed]
        ready = ready[ready["number"].isin(ready.loc[ready["opens"].astype(bool), "number"])].copy()
        if len(ready):
            ready["late"] = ~ready["opens"].astype(bool)
            ready = ready.sort_values(["number", "late", "seq"])
            numbers, rank = np.unique(ready["number"].to_numpy(np.int64), return_inverse=True)
            event = done + rank
            done += len(numbers)
            ts = ready["ts"].astype(float).groupby(ready["number"]).transform("first").fillna(0.0)
            out = pd.DataFrame({"run": key[0], "event_id": event, "number": ready["number"].astype(np.int64), "seq": ready["seq"].astype(np.int64), "producer": ready["producer"], "window_ts": ts})
            over = over or bool(self.max_windows) and done >= self.max_windows
            yield out[event < self.max_windows] if self.max_windows else out
        self.at.update((top, done, over))
        if over or not len(held):
            self.waiting.clear()
        else:
            self.waiting.put([(int(r.seq), r.producer, int(r.number), None if pd.isna(r.ts) else float(r.ts), bool(r.opens)) for r in held.itertuples(index=False)])


def stream_windowed(stream: DataFrame, master: str | None = None, end: str | None = None, max_windows: int = 0) -> DataFrame:
    """`windowed` of a stream (append mode): a window comes out once a higher one opens or its run ends. A run's sub-events must come in the
    order of seq from one micro-batch to the next; inside one, any order does. The session needs STATE_STORE."""
    rows = stream.filter("run IS NOT NULL").select("run", "seq", "producer", "number", _middle().alias("ts"))
    if end is None:
        rows = rows.filter("number IS NOT NULL")
    else:
        rows = rows.filter(F.col("number").isNotNull() | (F.col("producer") == end)).fillna(0, ["number"])
    kind = rows.schema["run"].dataType.simpleString()
    schema = f"run {kind}, event_id long, number long, seq long, producer string, window_ts double"
    return rows.groupBy("run").transformWithStateInPandas(_Builder(master, end, max_windows), schema, "Append", "None")


def stream_in_order(stream: DataFrame) -> DataFrame:
    """The late rule of `in_order` on a stream of (producer string, number long, seq long): the state is one number a producer."""

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            if top is None or row.number >= top:
                out.append((row.producer, row.number, row.seq))
                top = row.number
        if top is not None:
            state.update((int(top),))
        yield pd.DataFrame(out, columns=["producer", "number", "seq"])

    return stream.groupBy("producer").applyInPandasWithState(keep, "producer string, number long, seq long", "top long", "append", "NoTimeout")


def stream_histogram(stream: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, content as running state of a stream (complete or update mode)."""
    v = F.col(value).cast("double")
    return stream.filter((v >= low) & (v < high) & ~F.isnan(v)).groupBy(((v - low) / ((high - low) / bins)).cast("int").alias("bin")).agg(F.count("*").alias("content"))
