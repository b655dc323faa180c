"""Pairs of places nearer than a distance, by cells of its size as a join key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(v: str, distance: float) -> Column:
    """Cells are a little wider than the distance, so that rounding never puts two near places two cells apart."""
    return F.floor(F.col(v) / (distance * (1 + 1e-9)))


def celled(df: DataFrame, x: str, y: str, distance: float) -> DataFrame:
    """df with its cell, __ix and __iy."""
    return df.withColumns({"__ix": _cell(x, distance), "__iy": _cell(y, distance)})


def around(df: DataFrame, x: str, y: str, distance: float) -> DataFrame:
    """df once for each cell that may hold a near place: its own and the eight around it."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    each = celled(df, x, y, distance).withColumn("__s", F.explode(steps))
    return each.withColumns({"__ix": F.col("__ix") + F.col("__s.a"), "__iy": F.col("__iy") + F.col("__s.b")}).drop("__s")


#: Sides of a wide cell, in distances: wider ones send fewer places to the cells beside their own, and hold more pairs to look at.
WIDE = 4


def _wide(v: str, distance: float) -> Column:
    return F.floor(F.col(v) / (WIDE * distance))


def wide_celled(df: DataFrame, x: str, y: str, distance: float) -> DataFrame:
    """df with its wide cell, __ix and __iy."""
    return df.withColumns({"__ix": _wide(x, distance), "__iy": _wide(y, distance)})


def wide_ahead(df: DataFrame, x: str, y: str, distance: float) -> DataFrame:
    """df in its own wide cell (__own) and in those of the four around it that come behind it (by x, then y) and reach within the
    distance of it. Of two near places in different cells, the one of the earlier cell so meets the other, once."""
    at = lambda v, k: F.floor((F.col(v) + k * distance * (1 + 1e-9)) / (WIDE * distance))
    each = wide_celled(df, x, y, distance)
    right, up, down = at(x, 1) > F.col("__ix"), at(y, 1) > F.col("__iy"), at(y, -1) < F.col("__iy")
    step = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    ahead = F.array(step(0, 0), F.when(up, step(0, 1)), F.when(right, step(1, 0)), F.when(right & up, step(1, 1)), F.when(right & down, step(1, -1)))
    each = each.withColumn("__s", F.explode(F.array_compact(ahead)))
    return each.withColumns({"__ix": F.col("__ix") + F.col("__s.a"), "__iy": F.col("__iy") + F.col("__s.b"), "__own": (F.col("__s.a") == 0) & (F.col("__s.b") == 0)}).drop("__s")
