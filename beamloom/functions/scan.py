"""Running values over long ordered groups, by a scan in two steps.

A window over a whole group would put the group into one task. Here rows are cut into blocks of their order
column; a block's total goes into a small table (one row a block), in which the groups' windows run; inside, each
block has its own window. Any associative sum can be run this way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How values of rows become one, and how that of the blocks before joins that of the own block (nulls are none).
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))),
}


def running(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], values: dict[str, tuple[str, Column]], inclusive: bool = True, block: int = 4096) -> DataFrame:
    """df with, for each name, the (kind, value) over the rows of the group up to each row, or up to the one before it.

    The first order column is a whole number whose blocks cut the group; the others decide among equal ones. Null groups
    are a group; a row before all values has null.
    """
    rows = df.withColumns({"__g": F.struct(F.lit(0).alias("_"), *by), "__block": F.floor(F.col(order[0]) / block)})
    totals = rows.groupBy("__g", "__block").agg(*[KINDS[k][0](v).alias(f"__t_{n}") for n, (k, v) in values.items()])
    before = Window.partitionBy("__g").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__g", "__block", *[KINDS[k][0](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (k, _) in values.items()])
    inside = Window.partitionBy("__g", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = {f"__o_{n}": KINDS[k][0](v).over(inside) for n, (k, v) in values.items()}
    joined = rows.withColumns(own).join(bases, ["__g", "__block"])
    both = {n: KINDS[k][1](F.col(f"__b_{n}"), F.col(f"__o_{n}")) for n, (k, _) in values.items()}
    return joined.withColumns(both).drop("__g", "__block", *own, *[f"__b_{n}" for n in values])
