"""Configuration: a TOML file of stages, overrides from the command line, and the registry of stage functions."""

from __future__ import annotations

import argparse
import time
import tomllib
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from beamloom.functions import units
from beamloom.sources import store

#: Tables by name; `geometry` is the list of detectors, `plots` and `graphs` are tables by stage.
Tables = dict[str, Any]
#: Tables that several stages read.
KEPT = ("hits", "traces", "pixels", "clusters", "tracks", "track_cluster_links", "residuals", "waveforms", "associations", "masked", "time_pairs")
_STAGES: dict[str, Callable[[Tables, "Block"], Tables]] = {}


@dataclass
class Block:
    """One stage's settings, with the global ones behind them."""

    kind: str
    values: dict[str, Any] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.values.get("name") or self.kind

    def _raw(self, key: str, default: Any) -> Any:
        return self.values.get(key, self.common.get(key, default))

    def number(self, key: str, default: float = 0.0) -> float:
        """A number, or a string with a unit, in base units."""
        return units.parse(self._raw(key, default))

    def text(self, key: str, default: str = "") -> str:
        return str(self._raw(key, default))

    def flag(self, key: str, default: bool = False) -> bool:
        return bool(self._raw(key, default))

    def list(self, key: str, default: tuple = (), convert: Callable = units.parse) -> list:
        """An array; a bare value is an array of one."""
        v = self._raw(key, list(default))
        return [x if isinstance(x, list) else convert(x) for x in (v if isinstance(v, list) else [v])]

    def texts(self, key: str, default: tuple = ()) -> list[str]:
        return self.list(key, default, str)


def stage(kind: str):
    """Registers a function (tables, block) -> tables under a name."""

    def add(f):
        _STAGES[kind] = f
        return f

    return add


def _override_value(text: str) -> Any:
    try:
        return tomllib.loads(f"v = {text}")["v"]
    except tomllib.TOMLDecodeError:
        return {"true": True, "false": False}.get(text.lower(), text)


def parse(text: str, overrides: tuple[str, ...] = ()) -> list[Block]:
    """Stages in the order of the file; `[[Stage]]` may repeat. Overrides are `Stage.key=value`, or `key=value` for all."""
    raw = tomllib.loads(text)
    common = {k: v for k, v in raw.items() if not isinstance(v, (dict, list)) or (isinstance(v, list) and not (v and isinstance(v[0], dict)))}
    common |= raw.get("Global", {})
    order: list[str] = []
    for line in text.splitlines():
        head = line.strip()
        if head.startswith("["):
            order.append(head.strip("[]").split("]")[0].strip())
    seen: dict[str, int] = {}
    blocks = []
    for kind in order:
        if kind == "Global" or kind not in raw:
            continue
        i = seen.get(kind, 0)
        seen[kind] = i + 1
        v = raw[kind]
        blocks.append(Block(kind, dict(v[i] if isinstance(v, list) else v), common))
    for o in overrides:
        path, _, value = o.partition("=")
        head, _, key = path.rpartition(".")
        for b in blocks:
            if not head:
                b.common[key] = _override_value(value)
            elif head in (b.kind, b.name):
                b.values[key] = _override_value(value)
    return blocks


@dataclass
class Report:
    """What a run tells about itself: seconds by stage, counts of rows by table, and the stages' counters, seen while tables were written."""

    seconds: dict[str, float] = field(default_factory=dict)
    whole: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)

    def lines(self) -> list[str]:
        """The slowest stage first, then the counts."""
        slow = sorted(self.seconds.items(), key=lambda s: -s[1])
        return [f"{n}: {s:.3f} s" for n, s in slow] + [f"in all: {self.whole:.3f} s"] + [f"{n}: {units.count(c)}" for n, c in sorted(self.counts.items())]


def run(blocks: list[Block], tables: Tables, report: Report | None = None) -> Tables:
    """Applies the stages one after the other. The tables that later stages build on (KEPT) are stored once they are made; others are
    plans that are computed where they are written.

    A stage with `concurrent` starts on the tables that are there and runs beside those after it; its new tables join
    at the end. Its jobs share the cluster's cores with theirs.
    """
    report = report or Report()
    begun = time.monotonic()
    beside: list[tuple[set, str, Future]] = []

    def applied(b: Block, t: Tables) -> Tables:
        start = time.monotonic()
        with store.counting(report.counts):
            out = _STAGES[b.kind](t, b)
            out = out | {n: store.stored(out[n], n, {n: F.count(F.lit(1))}) for n in KEPT if n in out and out[n] is not t.get(n)}
        report.seconds[b.name] = report.seconds.get(b.name, 0.0) + time.monotonic() - start
        return out

    for b in blocks:
        if b.kind not in _STAGES:
            raise KeyError(f"no stage {b.kind}")
    with ThreadPoolExecutor(max_workers=4) as pool:
        for b in blocks:
            if b.flag("concurrent"):
                beside.append((set(tables), b.kind, pool.submit(applied, b, {k: v for k, v in tables.items() if k not in ("plots", "graphs")})))
            else:
                tables = applied(b, tables)
        for before, name, done in beside:
            new = done.result()
            for kind in ("plots", "graphs"):
                if name in new.get(kind, {}):
                    tables = tables | {kind: tables.get(kind, {}) | {name: new[kind][name]}}
            tables = tables | {k: v for k, v in new.items() if k not in before and k not in ("plots", "graphs")}
    report.whole = time.monotonic() - begun
    return tables


def arguments(argv: list[str]) -> tuple[str, tuple[str, ...]]:
    """(config path, overrides) from `-c path -o Stage.key=value ...`; a bare path is the config."""
    p = argparse.ArgumentParser()
    p.add_argument("path", nargs="?")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--option", action="append", default=[])
    a = p.parse_args(argv)
    path = a.config or a.path
    if not path or not Path(path).exists():
        p.error("a config file is needed")
    return path, tuple(a.option)
