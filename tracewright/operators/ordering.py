"""Sums along one order of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.storage import materialize


#: Rows up to which one window does.
FEW = 50_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], keep: bool = False) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over all rows up to this one, itself included.

    Rows are sorted by range and written, summed within each range, and moved up by the
    totals of the ranges before; only those totals meet in one place.  A table of up to
    :data:`FEW` rows, which are counted, is summed as it is.  ``order`` must tell rows
    apart, or their sums may change from run to run.
    """
    if df.count() <= FEW:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    ranged = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), **{f"_{n}": c for n, c in sums.items()}})
    ranged = materialize(ranged, "ranges", keep)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums])
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_range").select(*df.columns, *[(F.sum(f"_{n}").over(inside) + F.col(f"_{n}_before")).alias(n) for n in sums])
