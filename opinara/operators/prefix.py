"""Sums over all earlier rows in two levels: blocks of a bounded size, each in one task, and the blocks' own totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.storage import durable


def before(df: DataFrame, whole: list[str], block: str, order: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with, by name, the sum of a column (sums) and its last value that isn't null (lasts) over the rows of the same whole that
    come earlier in order of block and order. No task sees more than a block's rows, or a row of each block of a whole.

    df is read twice: a costly one should be a table."""
    lasts = lasts or {}
    inside = Window.partitionBy(*whole, block).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*whole).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))
    totals = df.groupBy(*whole, block).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(latest(c).alias(n) for n, c in lasts.items()))
    keys = {k: f"_key{i}" for i, k in enumerate([*whole, block])}  # nulls are a whole of their own
    totals = totals.select(
        *(F.col(k).alias(n) for k, n in keys.items()), *(F.coalesce(F.sum(n).over(blocks), F.lit(0)).alias(f"_{n}") for n in sums), *(F.last(n, True).over(blocks).alias(f"_{n}") for n in lasts)
    )
    rows = df.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()} | {n: F.last(c, True).over(earlier) for n, c in lasts.items()})
    both = rows.join(totals, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in keys.items())))
    made = {n: F.col(n) + F.col(f"_{n}") for n in sums} | {n: F.coalesce(n, F.col(f"_{n}")) for n in lasts}
    return both.withColumns(made).drop(*(f"_{n}" for n in made), *keys.values())


def in_ranges(df: DataFrame, whole: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """df as a table with a column block, by which before() may be used: ranges of whole and order of about the same size, so that
    a whole with most of the rows has many of them."""
    ranged = df.repartitionByRange(*(F.col(c) for c in [*whole, *order])).withColumn("block", F.spark_partition_id())
    return durable(ranged, name)
