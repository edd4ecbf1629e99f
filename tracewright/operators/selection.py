"""Exact order statistics of columns of any size, by nested histograms of the values' bits.

Values are counted by the high bits of a number that sorts as they do, the bin that holds
each wanted rank is found from the counts, and only the values of that bin are counted by
further bits.  All ranks and keys go together.  What is ordered in one task is the bins of
one key, at most 2**22 and not the values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType

#: Bits that are left to refine after each histogram.
SHIFTS = (42, 21, 0)


def ordered_bits(value: Column, kind: DataType) -> Column:
    """A long that sorts as the number does; NaN sorts last, as in Spark."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return value.cast("long")
    if not isinstance(kind, (FloatType, DoubleType)):
        raise TypeError(f"ranks need a column of whole or floating numbers, not {kind.simpleString()}")
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double"), F.lit(0.0))).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def nearest(q: float) -> Callable[[Column], Column]:
    """The place, from 0, of the value at rank ceil(q * n)."""
    return lambda n: F.greatest(F.lit(0), F.ceil(F.lit(q) * n) - 1)


def half_even(q: float) -> Callable[[Column], Column]:
    """The place round-half-even(q * (n - 1))."""
    return lambda n: F.rint(F.lit(q) * (n - 1)).cast("long")


def select_ranks(values: DataFrame, column: str, places: dict[str, Callable[[Column], Column]], keys: tuple[str, ...] = ()) -> DataFrame:
    """For each key (null is one) the values at some places of their order: keys, then a column for each of ``places``.

    ``places`` gives by name the place, from 0, in n sorted values.  Nulls are no values.
    Without keys there is one row, of nulls if there are no values; with keys, a row for
    each key that has a value.  The values are counted once, and that shuffle is read again
    for each histogram.
    """
    kind = values.schema[column].dataType
    own = [f"_k{i}" for i in range(len(keys))]
    named = values.where(F.col(column).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(column).alias("_v"))
    counts = named.groupBy(*own, "_v").agg(F.count("*").alias("_c"))
    bits = ordered_bits(F.col("_v"), kind)
    counts = counts.select("*", bits.alias("_b"))

    found = counts.groupBy(*own, F.shiftright("_b", SHIFTS[0]).alias("_bin")).agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v"))
    by = Window.partitionBy(*own)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("_n", F.sum("_c").over(whole))
    wanted = F.array(*[F.struct(F.lit(i).alias("which"), place(F.col("_n")).cast("long").alias("at")) for i, place in enumerate(places.values())])
    found = _bins_that_hold(found.withColumn("_want", wanted), by, own)
    for before, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        bins = found.select(*[F.col(o).alias(f"{o}b") for o in own], F.col("_bin").alias("_in"), "_want")
        inside = F.shiftright("_b", before) == F.col("_in")
        for o in own:
            inside &= F.col(o).eqNullSafe(F.col(f"{o}b"))
        rest = counts.join(bins, inside)
        found = rest.groupBy(*own, "_in", "_want", F.shiftright("_b", shift).alias("_bin")).agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v"))
        found = _bins_that_hold(found, Window.partitionBy(*own, "_in"), own)
    each = found.select(*own, "_v", F.explode("_want").alias("_w"))
    picked = [F.max(F.when(F.col("_w.which") == i, F.col("_v"))).alias(name) for i, name in enumerate(places)]
    result = each.groupBy(*own).agg(*picked)
    return result.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *places)


def _bins_that_hold(found: DataFrame, by, own: list[str]) -> DataFrame:
    """Of bins with counts those that hold a wanted place, with the places inside them."""
    upto = F.sum("_c").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_before", upto - F.col("_c"))
    here = F.filter("_want", lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_c")))
    inside = F.transform(here, lambda w: F.struct(w["which"].alias("which"), (w["at"] - F.col("_before")).alias("at")))
    return found.select(*own, "_bin", "_v", inside.alias("_want")).where(F.size("_want") > 0)
