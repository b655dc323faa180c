"""Histograms, maps and graphs of a run as tables.

All plots of a table are filled in one pass: each row gives one entry a plot and place, entries are summed per
task, and bins times tasks are what is shuffled. `hist_bins` has the contents, `hist_stats` the entries (those
out of range too) and moments (in range only), `graph_points` the points of graphs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = Column | str | float | int


@dataclass(frozen=True)
class Plot:
    """A histogram of x, or a map of x and y; bounds and bin numbers may depend on the row's detector."""

    name: str
    x: Value
    bins: Value
    low: Value
    high: Value
    y: Value | None = None
    bins_y: Value = 1
    low_y: Value = 0.0
    high_y: Value = 1.0
    weight: Value = 1.0


def _column(v: Value | None) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def _bin(v: Column, n: Column, low: Column, high: Column) -> Column:
    inside = (v >= low) & (v < high)
    return F.when(inside, ((v - low) / ((high - low) / n)).cast("int"))


def entries(df: DataFrame, paths: Column, plots: list[Plot]) -> DataFrame:
    """path, plot, x, y, w, ix, iy for each plot and path (an array) of each row; NaN and null values give none."""
    number = lambda v: _column(v).cast("double")
    made = []
    for p in plots:
        x, y = number(p.x), F.lit(0.0) if p.y is None else number(p.y)
        x, y = (F.when(~F.isnan(v), v) for v in (x, y))
        ix = _bin(x, number(p.bins), number(p.low), number(p.high))
        iy = F.lit(0) if p.y is None else _bin(y, number(p.bins_y), number(p.low_y), number(p.high_y))
        made.append(F.struct(F.lit(p.name).alias("plot"), x.alias("x"), y.alias("y"), number(p.weight).alias("w"), ix.alias("ix"), iy.alias("iy")))
    each = df.select(paths.alias("paths"), F.explode(F.array(*made)).alias("e"))
    return each.select(F.explode("paths").alias("path"), "e.*").filter("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")


def bins(filled: DataFrame) -> DataFrame:
    """path, plot, ix, iy, content."""
    return filled.filter("ix IS NOT NULL AND iy IS NOT NULL").groupBy("path", "plot", "ix", "iy").agg(F.sum("w").alias("content"))


def sums(filled: DataFrame) -> DataFrame:
    """path, plot, entries and sums of moments: all of them add up, over parts of a table as well."""
    inside = F.col("ix").isNotNull() & F.col("iy").isNotNull()
    total = lambda e: F.coalesce(F.sum(F.when(inside, F.col("w") * e)), F.lit(0.0))
    return filled.groupBy("path", "plot").agg(
        F.count("*").alias("entries"), total(F.lit(1.0)).alias("sum_w"), total(F.col("x")).alias("sum_x"), total(F.col("x") * F.col("x")).alias("sum_x2"),
        total(F.col("y")).alias("sum_y"), total(F.col("y") * F.col("y")).alias("sum_y2"), total(F.col("x") * F.col("y")).alias("sum_xy"),
    )


def moments(s: DataFrame) -> DataFrame:
    """sums with means and population deviations."""
    mean = {a: F.when(F.col("sum_w") != 0, F.col(f"sum_{a}") / F.col("sum_w")).otherwise(0.0) for a in "xy"}
    s = s.withColumns({f"mean_{a}": m for a, m in mean.items()})
    spread = {a: F.when(F.col("sum_w") != 0, F.col(f"sum_{a}2") / F.col("sum_w") - F.col(f"mean_{a}") * F.col(f"mean_{a}")).otherwise(0.0) for a in "xy"}
    return s.withColumns({f"std_{a}": F.sqrt(F.greatest(v, F.lit(0.0))) for a, v in spread.items()})


def stats(filled: DataFrame) -> DataFrame:
    """path, plot, entries, sums, means and population deviations."""
    return moments(sums(filled))


def graph(df: DataFrame, path: Value, name: str, x: Value, y: Value) -> DataFrame:
    """path, graph, x, y: points in any number of calls are united, so a graph grows by union."""
    where = F.lit(path) if isinstance(path, str) else path
    return df.select(where.alias("path"), F.lit(name).alias("graph"), _column(x).cast("double").alias("x"), _column(y).cast("double").alias("y"))


def places(*names: Column | str) -> Column:
    """The paths of a row; null ones are left out (a detector without dies has no place by die)."""
    return F.array_compact(F.array(*[F.lit(n) if isinstance(n, str) else n for n in names]))


def by_die(detector: Column, die: Column) -> Column:
    """The detector's place and, where the row lies on a die, the die's."""
    return places(detector, F.when((die.isNotNull()) & (die != ""), F.concat_ws("/", detector, die)))


def written(found: dict[str, DataFrame], folder: str, form: str = "parquet") -> dict[str, str]:
    """Writes tables of plots by module, each on its own; returns what failed, by table. One that fails does not stop the others."""
    failed = {}
    for name, df in found.items():
        try:
            df.write.mode("overwrite").format(form).save(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001 - any failure of one table is reported, not raised
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return failed


def exported(folder: str, spark, target: str) -> list[str]:
    """The written tables of plots as JSON lines for other programs, contents with their statistics; returns their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(folder)) if s.isDirectory())
    for n in names:
        spark.read.parquet(f"{folder}/{n}").write.mode("overwrite").json(f"{target}/{n}")
    return names
