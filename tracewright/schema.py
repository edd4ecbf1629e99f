"""The event log: one wide schema, and a typed view of each kind of event.

Every field is nullable, as logs may leave any of them out.  ``seq`` is the position of an
event in its log; it breaks ties between equal times and says which event came last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import WindowSpec

SCHEMA_VERSION = 1

EVENT_KINDS = ("session", "prompt", "api_call", "tool_call", "notification", "turn", "compact", "queue_op")

_FIELDS = {
    "session": (
        "t_start bigint, t_end bigint, project string, cwd string, git_branch string, entrypoint string, versions array<string>, "
        "n_lines bigint, n_duplicate_lines bigint, n_orphan_results bigint, line_types map<string,bigint>, agent_type string, "
        "spawn_depth int, spawned_by_tool_use string, background boolean, workflow string, model string, effort string, "
        "end_status string, resolved boolean, harness_error string"
    ),
    "prompt": "uuid string, parent_uuid string, text_chars bigint, origin string, sidechain boolean",
    "api_call": (
        "ts_last bigint, uuid string, parent_uuid string, request_id string, message_id string, model string, effort string, stop_reason string, "
        "sidechain boolean, blocks struct<text:bigint,text_chars:bigint,thinking:bigint,thinking_chars:bigint,tool_use:bigint,other:bigint>, "
        "usage struct<`in`:bigint,out:bigint,cache_read:bigint,cache_create:bigint,cache_create_5m:bigint,cache_create_1h:bigint,service_tier:string,speed:string>"
    ),
    "tool_call": (
        "ts_result bigint, duration_ms bigint, id string, name string, args_shape string, api_uuid string, api_message_id string, is_error boolean, "
        "result_chars bigint, background boolean, spawned_agent string, status string, sidechain boolean, function_name string"
    ),
    "notification": "agent_ref string, tool_use_id string, status string",
    "turn": "duration_ms bigint, message_count bigint, pending_background_agents bigint",
    "compact": "trigger string, pre_tokens bigint",
    "queue_op": "op string, content_chars bigint",
}
_BASE = "ev string, session string, agent string, ts bigint"


def kind_schema(kind: str) -> StructType:
    """The fields of one kind of event."""
    return StructType.fromDDL(f"{_BASE}, {_FIELDS[kind]}")


def event_schema() -> StructType:
    """The union of all kinds' fields."""
    merged = StructType.fromDDL(_BASE)
    for kind in EVENT_KINDS:
        for field in kind_schema(kind):
            if field.name not in merged.names:
                merged = merged.add(field)
    return merged


def sort_time(ts: Column | None = None, ts_result: Column | None = None) -> Column:
    """The time that orders calls; a zero counts as missing, as does null."""
    ts = F.col("ts") if ts is None else ts
    ts_result = F.col("ts_result") if ts_result is None else ts_result
    return F.coalesce(F.nullif(ts, F.lit(0)), F.nullif(ts_result, F.lit(0)), F.lit(0))


def stream_window() -> WindowSpec:
    """A stream is a session's main thread (agent null) or one of its agents."""
    return Window.partitionBy("session", "agent")


def stream_order() -> WindowSpec:
    """A stream's calls in time order, equal times as logged."""
    return stream_window().orderBy(sort_time(), "seq")


@dataclass(frozen=True)
class Trace:
    """An event log with ``seq``.  Views are lazy; reading one prunes the other kinds."""

    events: DataFrame
    views: dict[str, DataFrame] = field(default_factory=dict)

    def cached(self) -> Trace:
        """The same log kept in memory and on disk, for reports that read it many times.

        What is windowed by stream is kept partitioned by stream, so no window moves it again.
        """
        spark = self.events.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_stream = {kind: self.of(kind).repartition(parts, "session", "agent").persist() for kind in ("tool_call", "api_call", "compact")}
        return Trace(self.events.persist(), by_stream)

    def of(self, kind: str) -> DataFrame:
        if kind in self.views:
            return self.views[kind]
        fields = [f.name for f in kind_schema(kind) if f.name in self.events.columns]
        return self.events.where(F.col("ev") == kind).select(*fields, "seq")

    @property
    def sessions(self) -> DataFrame:
        return self.of("session")

    @property
    def prompts(self) -> DataFrame:
        return self.of("prompt")

    @property
    def api_calls(self) -> DataFrame:
        return self.of("api_call")

    @property
    def tool_calls(self) -> DataFrame:
        return self.of("tool_call")

    @property
    def notifications(self) -> DataFrame:
        return self.of("notification")

    @property
    def turns(self) -> DataFrame:
        return self.of("turn")

    @property
    def compacts(self) -> DataFrame:
        return self.of("compact")

    @property
    def queue_ops(self) -> DataFrame:
        return self.of("queue_op")

    @property
    def last_sessions(self) -> DataFrame:
        """The last session event of each stream."""
        sessions = self.sessions
        rest = [c for c in sessions.columns if c not in ("session", "agent")]
        return sessions.groupBy("session", "agent").agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select("session", "agent", "_last.*")

    @property
    def streams(self) -> DataFrame:
        """One row per stream: key, ``stream_ord`` (where it is first seen), and its last
        session event's fields.  Notifications and queue operations don't make a stream."""
        seen = self.events.where(~F.col("ev").isin("notification", "queue_op")).groupBy("session", "agent").agg(F.min("seq").alias("stream_ord"))
        last = self.last_sessions.withColumnsRenamed({"session": "_s", "agent": "_a"}).drop("seq", "ev", "ts")
        return seen.join(last, (F.col("session") == F.col("_s")) & F.col("agent").eqNullSafe(F.col("_a")), "left").drop("_s", "_a")
