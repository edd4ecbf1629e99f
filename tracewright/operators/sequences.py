"""Operators over a stream's ordered events: islands, neighbours, overlaps, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tracewright.operators.joins import SPREAD
from tracewright.schema import stream_order, stream_window


def islands(df: DataFrame, same: list[str], partition: list[str], order: list[Column | str], into: str = "island") -> DataFrame:
    """Numbers maximal runs of neighbours that agree in ``same``; null agrees with null."""
    ordered = Window.partitionBy(*partition).orderBy(*order)
    changed = F.lit(False)
    for name in same:
        changed = changed | ~F.col(name).eqNullSafe(F.lag(name).over(ordered))
    first = F.row_number().over(ordered) == 1
    return df.withColumn("_starts", (first | changed).cast("int")).withColumn(into, F.sum("_starts").over(ordered)).drop("_starts")


def repeat_runs(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Runs of two or more calls of one stream with one name and argument shape (and, if
    ``strict``, result size): session, agent, length, tool, args_shape, start_ts,
    errors_in_run, first_seq."""
    from tracewright.schema import sort_time

    same = ["name", "args_shape"] + (["result_chars"] if strict else [])
    numbered = islands(calls, same, ["session", "agent"], [sort_time(), "seq"])
    at = F.struct(sort_time(), "seq")
    return (
        numbered.groupBy("session", "agent", "island")
        .agg(
            F.count("*").alias("length"),
            F.first("name").alias("tool"),
            F.first("args_shape").alias("args_shape"),
            F.min_by("ts", at).alias("start_ts"),
            F.count_if("is_error").alias("errors_in_run"),
            F.min(at).getField("seq").alias("first_seq"),
        )
        .where("length >= 2")
        .drop("island")
    )


def with_next_call(calls: DataFrame) -> DataFrame:
    """Adds ``after``: what a stream's next call does, compared with this one."""
    order = stream_order()
    following = F.lead("seq").over(order)
    same_name = F.lead("name").over(order).eqNullSafe(F.col("name"))
    same_shape = F.lead("args_shape").over(order).eqNullSafe(F.col("args_shape"))
    label = (
        F.when(following.isNull(), "no_further_tool_call")
        .when(same_name & same_shape, "retry_identical_shape")
        .when(same_name, "same_tool_different_arguments")
        .otherwise("switched_tool")
    )
    return calls.withColumn("after", label)


def with_position(calls: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1) and ``is_last`` within the stream."""
    return calls.withColumn("pos", F.row_number().over(stream_order())).withColumn("is_last", F.lead("seq").over(stream_order()).isNull())


def unresolved(calls: DataFrame) -> Column:
    """Over :func:`with_position`: an error that no later success of the same tool in the
    same stream follows."""
    of_tool = Window.partitionBy("session", "agent", "name")
    last_success = F.max(F.when(~F.coalesce(F.col("is_error"), F.lit(False)), F.col("pos"))).over(of_tool)
    return F.coalesce(F.col("is_error"), F.lit(False)) & F.coalesce(last_success < F.col("pos"), F.lit(True))


def with_overlap(calls: DataFrame, start: str = "ts", end: str = "ts_result") -> DataFrame:
    """Adds ``overlaps``: whether a call starts before an earlier one of its stream ended."""
    order: WindowSpec = stream_window().orderBy(start, end, "seq").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("overlaps", F.coalesce(F.col(start) < F.max(end).over(order), F.lit(False)))


def gaps_between(events: DataFrame, partition: list[str], at: str = "ts", into: str = "gap") -> DataFrame:
    """Positive differences between neighbours in time."""
    order = Window.partitionBy(*partition).orderBy(at, "seq")
    return events.withColumn(into, F.col(at) - F.lag(at).over(order)).where(F.col(into) > 0)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that has no null part; rows with a null key all stay, and
    are spread over the tasks by their place in the order."""
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    spread = F.when(~has_key, F.pmod(F.xxhash64(*order), F.lit(SPREAD)))
    rank = F.row_number().over(Window.partitionBy(*keys, spread).orderBy(*order))
    return df.withColumn("_rank", rank).where(~has_key | (F.col("_rank") == 1)).drop("_rank")


def last_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def replay_completion(jobs: DataFrame, partition: list[str], arrival: str, duration: str, order: list[str]) -> DataFrame:
    """Adds ``completion`` of jobs served one at a time in order at unlimited capacity.

    completion = max(arrival, previous completion) + duration has the closed form
    S(i) + max over j <= i of (arrival(j) - S(j - 1)), with S the running sum of
    durations, so two windows replace the loop.
    """
    upto = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = jobs.withColumn("_s", F.sum(duration).over(upto))
    return summed.withColumn("completion", F.col("_s") + F.max(F.col(arrival) - (F.col("_s") - F.col(duration))).over(upto)).drop("_s")
