"""Live views of a growing transcript tree or event log with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.schema import event_schema


def follow_log(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of events from JSON lines files that appear below ``folder``."""
    rows = spark.readStream.schema(event_schema()).option("maxFilesPerTrigger", max_files).json(folder)
    return rows.withColumn("at", F.timestamp_millis(F.coalesce("ts", "ts_result")))


def follow_lines(spark: SparkSession, root: str, max_files: int = 100) -> DataFrame:
    """A stream of transcript lines: uuid, time and the raw line."""
    rows = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", max_files).load(root)
    return rows.select("value", F.get_json_object("value", "$.uuid").alias("uuid"), F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("at"))


def first_lines(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Lines without copies that are appended again within ``late``; state is bounded by it."""
    return lines.where("uuid is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["uuid"])


def error_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls and errors by tool and event-time window; a window is final once the watermark passes it."""
    calls = events.where("ev = 'tool_call'").withWatermark("at", late)
    return calls.groupBy(F.window("at", window), "name").agg(F.count("*").alias("calls"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of activity of each stream, parted by gaps of event time."""
    return events.withWatermark("at", late).groupBy("session", F.coalesce("agent", F.lit("")).alias("agent"), F.session_window("at", gap)).agg(F.count("*").alias("events"))
