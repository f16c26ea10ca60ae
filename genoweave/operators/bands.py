"""Ordered work on groups of any size: inside bands of a position, with what the bands before leave carried in.

A group is cut into bands by an integer position that orders it. Windows run
inside (group, band); what reaches over a band's edge is a table with one row per
group and band, over which a second, small window runs. So no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

Fold = Callable[[Column], Column]


def last_known(c: Column) -> Column:
    """Fold of ``carry``: the value of the nearest band before that has one."""
    return F.last(c, ignorenulls=True)


def cut(df: DataFrame, position: str | Column, width: int) -> DataFrame:
    """Rows with their band ``band_`` (null positions are a band of their own, the first)."""
    return df.withColumn("band_", F.floor((F.col(position) if isinstance(position, str) else position) / width))


def inside(keys: list[str], *order: str | Column) -> WindowSpec:
    return W.partitionBy(*keys, "band_").orderBy(*order)


def carry(rows: DataFrame, keys: list[str], **what: tuple[Column, Fold]) -> DataFrame:
    """Rows with one column per ``name=(aggregate of a band, fold over bands)``, folded over the bands before their own (null where there is none)."""
    earlier = W.partitionBy(*keys).orderBy("band_").rowsBetween(W.unboundedPreceding, -1)
    table = rows.groupBy(*keys, "band_").agg(*(of_band.alias(name) for name, (of_band, _) in what.items()))
    own = {k: f"of_{i}_" for i, k in enumerate([*keys, "band_"])}
    folded = table.select(*(F.col(k).alias(v) for k, v in own.items()), *(fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in what.items()))
    same = F.lit(True)
    for k, v in own.items():
        same = same & rows[k].eqNullSafe(folded[v])
    return rows.join(folded, same).drop(*own.values())


def runs(opened: DataFrame, keys: list[str], order: list[str], **totals: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """One row per run: rows from one with ``opens_`` 1 up to the next such row, over all bands.

    ``name=(aggregate of rows, aggregate of parts)`` gives the columns: parts of runs are
    aggregated in their bands first, then parts of one run are put together.
    """
    numbered = opened.withColumn("run_", F.sum("opens_").over(inside(keys, *order).rowsBetween(W.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "band_", "run_").agg(*(of_rows.alias(name) for name, (of_rows, _) in totals.items()))
    opener = F.struct(F.col("band_").alias("b"), F.col("run_").alias("r"))  # run 0 of a band began in a band before
    begun = carry(parts, keys, begun_=(F.max(F.when(F.col("run_") > 0, opener)), last_known))
    owned = begun.withColumn("opener_", F.when(F.col("run_") > 0, opener).otherwise(F.col("begun_")))
    return owned.groupBy(*keys, "opener_").agg(*(of_parts(name).alias(name) for name, (_, of_parts) in totals.items())).drop("opener_")
