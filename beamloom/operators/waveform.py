"""Pulse features of digitised traces.

A batch of traces of one length is a matrix, and every feature is an array operation over all its
rows: masks of samples above or below a level, the first or last set place of a mask, and running
sums along a trace (in its own order). Drops (no peak, no baseline, no noise) give null features, so
one filter after the features is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords

FEATURES = ("peak", "start", "baseline", "noise", "amplitude", "snr", "rise_time", "time_over_threshold", "time_over_noise", "integral")
#: Fixed values of the digitiser: the code of zero volts and the codes of a volt.
ZERO_CODE, CODES_PER_VOLT = 2048.0, 4096.0


def calibrated(samples: Column, dc_offset: Column | float = 0.0, polarity: int = -1) -> Column:
    """Volts of a trace of codes, turned so that pulses point up."""
    offset = dc_offset if isinstance(dc_offset, Column) else F.lit(float(dc_offset))
    return F.transform(samples, lambda x: ((x - ZERO_CODE) / CODES_PER_VOLT + offset) * polarity)


def _last(mask: np.ndarray) -> np.ndarray:
    """The last set place of each row, -1 without any."""
    n = mask.shape[1]
    return np.where(mask.any(axis=1), n - 1 - mask[:, ::-1].argmax(axis=1), -1)


def _first(mask: np.ndarray) -> np.ndarray:
    return np.where(mask.any(axis=1), mask.argmax(axis=1), -1)


def _middle(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The median of the first `count` values of each row."""
    rows, place = np.arange(len(values)), np.arange(values.shape[1])
    ranked = np.sort(np.where(place < count[:, None], values, np.inf), axis=1)
    return (ranked[rows, (count - 1) // 2] + ranked[rows, count // 2]) / 2


def _passed(s: np.ndarray, span: np.ndarray, ceiling: np.ndarray, level: np.ndarray, dt: float, rising: bool) -> np.ndarray:
    """When each trace passes a level inside its span of samples (a mask), seen from the peak outwards.

    The low end is the sample next to the peak that is below the level and not above the ceiling. The high end
    is the least of the samples between them that are not above the ceiling or, without any, the last one above it
    that is met on the way from the peak. In between time is linear in the voltage; without a high end that
    reaches the level, the highest sample's time counts. 0 if the level isn't passed.
    """
    rows, place = np.arange(len(s)), np.arange(s.shape[1])
    under = span & (s <= ceiling[:, None])
    nearest = _last if rising else _first
    low = nearest(under & (s < level[:, None]))
    at = np.maximum(low, 0)
    between = under & ((place > low[:, None]) if rising else (place < low[:, None]))
    high = np.where(between, s, np.inf).argmin(axis=1)
    entered = nearest(under)
    brink = entered + (1 if rising else -1)
    inside = (brink >= 0) & (brink < s.shape[1])
    brink = np.where(inside, brink, 0)
    carried = inside & span[rows, brink]
    high = np.where(between.any(axis=1), high, np.where(carried, brink, at))
    v0, v1 = s[rows, at], s[rows, high]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(v1 > v0, np.minimum(1.0, (level - v0) / (v1 - v0)), 0.0)
    return np.where(low >= 0, at * dt + share * (high - at) * dt, 0.0)


def _area(s: np.ndarray, peak: np.ndarray, low: np.ndarray, high: np.ndarray, width: float, dt: float) -> np.ndarray:
    """Area between a trace and its chord over a window of fixed width that starts at the rising edge; the baseline is not taken
    off. 0 without an edge, or where the window leaves the trace."""
    rows, place = np.arange(len(s)), np.arange(s.shape[1])
    first = _last((place >= 1) & (place <= peak[:, None]) & (s < low[:, None]))
    top = ((place >= first[:, None]) & (place <= peak[:, None]) & (s > high[:, None])).any(axis=1)
    last = ((width + first * dt) / dt).astype(int) - 1
    good = (first >= 0) & top & (last > first) & (last < s.shape[1])
    a, b = np.where(good, first, 0), np.where(good, last, 0)
    sums = np.concatenate([np.zeros((len(s), 1)), np.cumsum(s[:, :-1] + s[:, 1:], axis=1)], axis=1)
    chord = (s[rows, a] + s[rows, b]) * (b - a)
    return np.where(good, 0.5 * dt * np.abs(sums[rows, b] - sums[rows, a] - chord), 0.0)


def features(s: np.ndarray, cfds: tuple[float, ...] = (0.7,), dt: float = 0.2, noise_factor: float = 1.0, integral_time: float = 2.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, values of FEATURES, start times by fraction) of the rows of a matrix; rows that are not kept were dropped."""
    n = s.shape[1]
    if n < 2 or not len(s):
        return np.zeros(len(s), bool), np.zeros((len(s), len(FEATURES))), np.zeros((len(s), len(cfds)))
    rows, place = np.arange(len(s)), np.arange(n)
    peak = s.argmax(axis=1)
    kept = peak >= 1
    count = np.maximum(peak, 1)
    median = _middle(s, count)
    spread = _middle(np.abs(s - median[:, None]), count) * 1.4826
    start = _last((place < peak[:, None]) & (s < (median + spread)[:, None]))
    kept &= start >= 2
    size = np.maximum(start - 1, 1)
    baseline = np.cumsum(s, axis=1)[rows, size - 1] / size
    noise = np.sqrt(np.cumsum((s - baseline[:, None]) ** 2, axis=1)[rows, size - 1] / size)
    kept &= noise > 0
    amplitude = np.maximum(0.0, s[rows, peak] - baseline)
    ceiling, half, quiet = baseline + 0.99 * amplitude, baseline + 0.5 * amplitude, baseline + noise_factor * noise
    before = (place >= 1) & (place <= np.minimum(peak, n - 2)[:, None])
    behind = place >= peak[:, None]
    rise = lambda level: _passed(s, before, ceiling, level, dt, True)
    fall = lambda level: _passed(s, behind, ceiling, level, dt, False)
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = amplitude / noise
    values = [
        peak, start, baseline, noise, amplitude, snr, rise(baseline + 0.9 * amplitude) - rise(baseline + 0.1 * amplitude), np.maximum(0.0, fall(half) - rise(half)),
        np.maximum(0.0, fall(quiet) - rise(quiet)), _area(s, peak, baseline + noise_factor * noise / 2.0, ceiling, integral_time, dt),
    ]
    times = [rise(baseline + f * amplitude) for f in cfds]
    return kept, np.stack(values, axis=1), np.stack(times, axis=1) if times else np.zeros((len(s), 0))


def process(
    df: DataFrame, samples: str = "samples", cfds: tuple[float, ...] = (0.7,), dt: float = 0.2, noise_factor: float = 1.0, integral_time: float = 2.8, keep: tuple[str, ...] = (),
    polarity: int | None = None, dc_offset: str | None = None,
) -> DataFrame:
    """keep, FEATURES and start_time_cfd (array of (cfd, t)) for each row; null features where the trace is dropped.

    With a polarity, samples are codes that are calibrated first, with the offset of a column; else they are volts.
    """
    volts = F.col(samples) if polarity is None else calibrated(F.col(samples), F.lit(0.0) if dc_offset is None else F.col(dc_offset), polarity)
    picked = df.select(*keep, volts.cast("array<double>").alias("__s"))
    ints = ("peak", "start")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {'int' if c in ints else 'double'}" for c in FEATURES]) + ", start_time_cfd array<struct<cfd:double,t:double>>"
    pair = pa.list_(pa.struct([("cfd", pa.float64()), ("t", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            traces = b.column(b.num_columns - 1)
            ends, flat = traces.offsets.to_numpy(), traces.values.to_numpy(zero_copy_only=False)
            size = np.where(traces.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            kept, values, times = np.zeros(len(b), bool), np.zeros((len(b), len(FEATURES))), np.zeros((len(b), len(cfds)))
            for n in np.unique(size).tolist():  # traces of one length are one matrix
                at = np.nonzero(size == n)[0]
                kept[at], values[at], times[at] = features(flat[ends[at][:, None] + np.arange(n)], cfds, dt, noise_factor, integral_time)
            lost = ~kept
            cols = [pa.array(values[:, i].astype(np.int32) if c in ints else values[:, i], mask=lost) for i, c in enumerate(FEATURES)]
            each = pa.StructArray.from_arrays([pa.array(np.tile(np.array(cfds, float), int(kept.sum()))), pa.array(times[kept].ravel())], ["cfd", "t"])
            edges = pa.array(np.concatenate([[0], np.cumsum(kept)]) * len(cfds), pa.int32(), mask=np.concatenate([lost, [False]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols, pa.ListArray.from_arrays(edges, each).cast(pair)], [*keep, *FEATURES, "start_time_cfd"])

    return picked.mapInArrow(run, schema)


def valid(df: DataFrame, snr=(0.0, 1e30), start_time=(0.0, 1e30), rise_time=(0.0, 1e30), integral=(0.0, 1e30)) -> DataFrame:
    """Strict bounds."""
    first = F.get("start_time_cfd", F.lit(0))["t"]
    cut = F.col("peak").isNotNull()
    for v, (lo, hi) in ((F.abs("snr"), snr), (first, start_time), (F.col("rise_time"), rise_time), (F.col("integral"), integral)):
        cut &= (v > lo) & (v < hi)
    return df.filter(cut)


def select(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Inclusive bounds on any feature; start_time means that of the first fraction."""
    cut = F.lit(True)
    for name, (lo, hi) in bounds.items():
        v = F.get("start_time_cfd", F.lit(0))["t"] if name == "start_time" else F.col(name)
        cut &= v.between(lo, hi)
    return df.filter(cut)


def to_pixels(df: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Pulses as hits: charge is the integral, the time moves to the pulse's start."""
    start = coords.start_time_at(F.col("start_time_cfd"), fraction, F.get("start_time_cfd", F.lit(0))["t"])
    return df.withColumns({"charge": F.col("integral"), "ts": F.col("ts") + start})
