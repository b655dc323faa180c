"""A run from the command line: `python -m beamloom.plans.main -c run.toml -o Stage.key=value ...`.

Global keys: `detectors_file`, `detectors_file_updated`, `output_directory` (tables of results, plots and graphs, each
written on its own, so that one failure does not lose the others), `count` (names of tables whose rows are counted).
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.operators import plots
from beamloom.plans import config, stages
from beamloom.plans import plots as plot_sets
from beamloom.sources import geometry, store


def results(t: config.Tables) -> dict[str, DataFrame]:
    """The tables that a run writes beside its plots: results, and points of graphs."""
    out = {n: t[n] for n in ("efficiency", "cut_flow", "efficiency_maps", "profile_maps", "efficiency_by_event", "fake_map", "fake_rates", "cut_reasons", "time_pairs", "cluster_counts", "pair_counts", "corrections", "plateaus", "discarded", "segments", "onsets") if n in t}
    for name, points in t.get("graphs", {}).items():
        out[f"graph_points/stage={name}"] = points
    return out


def run(spark: SparkSession, path: str, overrides: tuple[str, ...] = (), tables: config.Tables | None = None) -> tuple[config.Tables, config.Report, dict[str, str]]:
    """(tables, report, what could not be written by table)."""
    blocks = config.parse(Path(path).read_text(), overrides)
    common = blocks[0] if blocks else config.Block("")
    t = dict(tables or {})
    if file := common.text("detectors_file"):
        t = stages.with_geometry(t, spark, geometry.read(file))
    report = config.Report()
    t = config.run(blocks, t, report)
    for name in common.texts("count"):
        if name not in report.counts:  # of stored tables it is known
            report.counts[name] = t[name].agg(F.count("*")).first()[0]
    failed = {}
    if folder := common.text("output_directory"):
        failed = plots.written(results(t), folder)
        for name, sets in t.get("plots", {}).items():
            failed |= plot_sets.written(sets, folder, name)
    return t, report, failed


def main(argv: list[str]) -> int:
    path, overrides = config.arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    _, report, failed = run(spark, path, overrides)
    store.swept(spark)  # tables between stages; what the run returns is written
    print("\n".join([*report.lines(), *(f"not written: {n}: {why}" for n, why in failed.items())]))
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
