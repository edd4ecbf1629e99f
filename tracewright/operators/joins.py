"""Joins over time and by event key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values that rows without a key are spread over where a shuffle goes by key.
SPREAD = 65536


def known_key(key: Column) -> Column:
    """The side of a join that :func:`spread_key` meets; null where the key is."""
    return F.concat(F.lit("k"), key)


def spread_key(key: Column, *by: Column) -> Column:
    """A key that joins as ``key`` does but is never null: rows without one get one of
    :data:`SPREAD` values, by the hash of ``by``, that no key equals.

    A left join sends all its null keys to one task; these go everywhere, without a second
    scan to split them off.
    """
    return F.coalesce(known_key(key), F.concat(F.lit("n"), F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("string")))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: Column, into: str) -> DataFrame:
    """``left`` with ``into``: ``value`` of the latest ``right`` row of the key at or before
    the left row's time, null where there is none.

    Both sides go through one shuffle and one sort by key and time, whatever the number of
    matches; no pair is made.  A null time on the left finds nothing.
    """
    carried = F.struct(*left.columns)
    both = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), carried.alias("_row"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_value"), F.lit(False).alias("_is"))
    both = both.unionByName(right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), value.alias("_value"), F.lit(True).alias("_is")))
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_is"), F.struct(F.col("_value").alias("v"))), ignorenulls=True).over(order)
    return both.withColumn("_found", found).where("_side = 1").select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_found.v")).alias(into))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: Column, into: str) -> DataFrame:
    """As :func:`asof_backward`, but the first ``right`` row at or after the left row's time."""
    carried = F.struct(*left.columns)
    both = left.select(*keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_seq"), carried.alias("_row"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_value"), F.lit(False).alias("_is"))
    both = both.unionByName(right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.col("seq").alias("_seq"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), value.alias("_value"), F.lit(True).alias("_is")))
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_last(), "_side", "_seq").rowsBetween(0, Window.unboundedFollowing)
    found = F.first(F.when(F.col("_is"), F.struct(F.col("_value").alias("v"))), ignorenulls=True).over(order)
    return both.withColumn("_found", found).where("_side = 0").select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_found.v")).alias(into))


def within_after(calls: DataFrame, marks: DataFrame, keys: list[str], at: str, window_ms: int, into: str = "near") -> DataFrame:
    """``calls`` with ``into``: whether a mark of the key lies 0 to ``window_ms`` before.

    The latest mark at or before the call decides, so one as-of join does the interval
    semi-join.  Marks at time 0 or null don't count.
    """
    marks = marks.where(F.col(at).isNotNull() & (F.col(at) != 0))
    found = asof_backward(calls, marks, keys, at, at, F.col(at), "_mark")
    return found.withColumn(into, F.coalesce(F.col(at) - F.col("_mark") <= window_ms, F.lit(False))).drop("_mark")


def last_api_calls(api_calls: DataFrame, key: str = "uuid") -> DataFrame:
    """The last api call of each key: its :func:`known_key` and context tokens, nulls as zero."""
    usage = F.col("usage")
    tokens = F.coalesce(usage["cache_read"], F.lit(0)) + F.coalesce(usage["in"], F.lit(0)) + F.coalesce(usage["cache_create"], F.lit(0))
    return api_calls.where(F.col(key).isNotNull()).groupBy(known_key(F.col(key)).alias("_key")).agg(F.max_by(tokens, "seq").alias("context_tokens"))


def with_context(tool_calls: DataFrame, api_calls: DataFrame, mode: str = "strict") -> DataFrame:
    """``tool_calls`` with ``context_tokens`` of the api call that issued them, else null.

    ``strict`` joins the uuid of the line that carries the call to the uuid of a merged
    message, which is that of its first line; ``message`` joins by message id, and so
    finds calls on later lines too.
    """
    left, right = ("api_uuid", "uuid") if mode == "strict" else ("api_message_id", "message_id")
    key = spread_key(F.nullif(F.col(left), F.lit("")), F.col("seq"))
    return tool_calls.join(last_api_calls(api_calls, right), key == F.col("_key"), "left").drop("_key")


def assert_joined(tool_calls: DataFrame, api_calls: DataFrame) -> DataFrame:
    """``tool_calls`` unchanged; running it raises at a call whose api call is missing or has
    no usage."""
    known = api_calls.where("uuid is not null").groupBy(known_key(F.col("uuid")).alias("_key")).agg(F.bool_or(F.col("usage").isNotNull()).alias("_usage"))
    joined = tool_calls.join(known, spread_key(F.col("api_uuid"), F.col("id")) == F.col("_key"), "left")
    checked = F.when(F.coalesce(F.col("_usage"), F.lit(False)), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("tool call without api usage: "), F.coalesce("id", F.lit("?")))).cast("string"))
    return joined.withColumn("status", checked).drop("_key", "_usage")
