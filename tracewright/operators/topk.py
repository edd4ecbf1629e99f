"""Counts and top-k with ties broken by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_common(df: DataFrame, key: Column | str, k: int | None = None, first: Column | str = "seq", measures: tuple[Column, ...] = (), name: str = "key") -> DataFrame:
    """Key, n and ``measures`` of the ``k`` most frequent keys, null a key like others; of
    equal counts the key seen first stands first."""
    column = F.col(key) if isinstance(key, str) else key
    counted = df.groupBy(column.alias(name)).agg(F.count("*").alias("n"), *measures, F.min(first).alias("_first"))
    ordered = counted.orderBy(F.desc("n"), F.asc("_first"))
    return (ordered.limit(k) if k else ordered).drop("_first")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
