"""Queries that run the transcript parser and the trajectory adapter over rendered events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans import replication
from tracewright.schema import Trace
from tracewright.sources import rendered, trajectories, transcripts
from tracewright.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, _ = transcripts.parse_lines(rendered.transcript_lines(spark, sf_dir))
    return numbered.where("_first and _op_first")


def _export(spark: SparkSession, sf_dir: str) -> transcripts.Export:
    return transcripts.export_lines(rendered.transcript_lines(spark, sf_dir), rendered.transcript_metas(spark, sf_dir), "salt")


def merged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = transcripts.merge_messages(_kept(spark, sf_dir))
    sizes = [F.col(f"blocks.{c}").alias(c) for c in ("text", "text_chars", "thinking_chars", "tool_use", "other")]
    tokens = [F.col(f"usage.{c}").alias(f"tokens_{c}") for c in ("in", "out", "cache_read")]
    return calls.select("file", "message_id", "uuid", "ts", "ts_last", "request_id", "model", "stop_reason", *sizes, *tokens)


def matched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = transcripts.match_tools(transcripts.tool_blocks(_kept(spark, sf_dir)))
    return calls.select("file", "id", "name", "args_shape", "ts", "ts_result", "duration_ms", "api_uuid", "api_message_id", "is_error", "result_chars", "background", "status")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.find_prompts(_kept(spark, sf_dir)).select("file", "ts", "uuid", "text_chars", "sidechain")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.find_notifications(_kept(spark, sf_dir)).select("file", "ts", "agent_ref", "tool_use_id", "status")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, compactions and queue operations as (kind, file, ts, label, n)."""
    found = transcripts.find_marks(_kept(spark, sf_dir))
    told = {"turn": (F.lit(None).cast("string"), F.col("duration_ms")), "compact": (F.col("trigger"), F.col("pre_tokens")), "queue_op": (F.col("op"), F.col("content_chars"))}
    out = None
    for kind, (label, n) in told.items():
        rows = found[kind].select(F.lit(kind).alias("kind"), "file", "ts", label.alias("label"), n.alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole export's session events."""
    sessions = _export(spark, sf_dir).trace.sessions
    return sessions.select("session", "agent", "t_start", "t_end", "n_lines", "n_duplicate_lines", "n_orphan_results", F.col("line_types")["assistant"].alias("assistant_lines"), "agent_type", "spawned_by_tool_use", "workflow", F.coalesce("background", F.lit(False)).alias("background"), "end_status")


def spawned_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole export's calls that spawned an agent."""
    return _export(spark, sf_dir).trace.tool_calls.where("spawned_agent is not null").select("session", "agent", "id", "spawned_agent", "status")


def events_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir).events.groupBy("ev").agg(F.count("*").alias("n"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir).anomalies.groupBy("kind", "key").agg(F.count("*").alias("n"))


def _converted(spark: SparkSession, sf_dir: str, exact: bool = False) -> trajectories.Conversion:
    return trajectories.convert_records(rendered.trajectory_records(spark, sf_dir), exact)


def adapted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _converted(spark, sf_dir).trace.tool_calls
    return calls.select("agent", "id", "name", "function_name", "args_shape", "ts", "ts_result", "duration_ms", "api_uuid", "is_error", "result_chars", "status")


def adapted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _converted(spark, sf_dir).trace.api_calls
    return calls.select("agent", "uuid", "ts", "model", F.col("blocks.tool_use").alias("tool_use"), *[F.col(f"usage.{c}").alias(f"tokens_{c}") for c in ("in", "cache_read", "cache_create")])


def adapted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).trace.sessions.select("session", "agent", "t_start", "t_end", "end_status", "agent_type", "resolved", "harness_error")


def adapted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = materialize(_converted(spark, sf_dir).trace.events, "verdicts")  # read by five branches
    found = replication.verdicts(Trace(log))
    return found.withColumn("z", F.round("z", 6)).withColumn("p", F.round("p", 6))


def adapted_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).counters


def adapted_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that name a model call beside those that find it; reading it raises where one doesn't."""
    trace: Trace = trajectories.checked(_converted(spark, sf_dir).trace)
    return trace.events.where("ev = 'tool_call'").agg(F.count("*").alias("calls"), F.count("api_uuid").alias("joined"))


#: Rendered files and what stands in them, in DuckDB's SQL.
VIEWS = """raw as (select *, user_id - user_id % 4 as main, case when user_id % 4 <> 0 then 'a' || user_id end as hex,
    case when user_id % 4 <> 0 then 'p/' || (user_id - user_id % 4) || '/subagents/agent-a' || user_id || '.jsonl' else 'p/' || user_id || '.jsonl' end as file from base),
ops as (select event_id, row_number() over (partition by user_id, ms order by event_id) as nth from raw where k % 4 = 0),
uses as (select raw.*, 't' || event_id as id, k % 11 = 0 as background from raw),
notes as (select *, case when k % 12 = 0 then 'a' || (user_id + 1 + k % 3) end as agent_ref, case when k % 12 <> 0 then 't' || event_id end as tool_use_id,
    ['failed', 'completed', 'running', 'killed'][1 + k % 4] as status from raw where user_id % 4 = 0 and k % 6 = 0),
threads as (select main, min(event_id) filter (user_id % 4 = 0) as f, max(event_id) filter (user_id % 4 = 0) as l from raw group by main),
metas as (select main, 'a' || (main + i) as hex, 'kind' || i as agent_type, case when i = 1 then 't' || f when i = 2 and l > f then 't' || l end as tool_use_id, case when i = 3 then 'wf_x' end as workflow
    from threads, (select unnest([1, 2, 3]) as i))"""
RECORDS = """acts as (select * exclude (agent), event_id // 64 as chunk, 'i' || user_id || '-' || (event_id // 64) as agent, 'r' || (k % 5) as response,
    ['run', 'edit', 'browse', 'message', 'recall', 'finish'][1 + case when k % 6 = 5 then case when k = 95 then 5 else 0 end else k % 6 end] as action,
    k <> 99 and k % 10 <> 9 as seen, k % 5 <> 4 as has_usage, case when k % 8 = 2 then '  ERROR: no' when k % 8 = 4 then '[No exact match found in x' else props end as body from base),
acted as (select *, 'i' || user_id || '-' || chunk || ':' || response as api, agent || ':turn:' || (2 * event_id) as turn, action in ('run', 'edit', 'browse') as tool,
    action = 'finish' or action = 'message' and k % 2 = 0 as said,
    case when k % 3 = 0 then 'exit_code' when k % 8 = 2 then 'editor_ERROR_prefix' when k % 8 = 4 then 'editor_no_exact_match' end as label,
    case when k % 3 = 0 then k % 7 <> 0 else k % 8 in (2, 4) end as bad from acts)"""
SHAPE = "'big:b,k:i,none:n,note:s' || length(props) || ',run_in_background:b,tags:a' || (k % 3) || ',value:f'"
ARGS_SHAPE = """case when k % 4 = 0 then 'command:s' || length(props) || ',n:i' when k % 4 = 1 then '_unparsed:s7' when action = 'run' then 'command:s' || length(props)
    when action = 'edit' then 'content:s' || length(props) || ',path:s1' else 'url:s1' end"""
MARKS = """select 'turn' as kind, file, ms as ts, null::varchar as label, d as n from raw where k % 4 = 1
    union all select 'compact', file, ms, case when k % 3 = 0 then 'auto' else 'manual' end, d from raw where k % 4 = 2
    union all select 'queue_op', file, ms, 'enqueue', length(props) from raw join ops using (event_id) where nth = 1"""
PROMPTS = "select file, ms as ts, 'u' || event_id as uuid, length(props)::bigint as text_chars, false as sidechain from raw where k % 5 = 0 and k % 10 <> 0"

QUERIES: dict[str, tuple[Query, str]] = {
    "transcript_model_calls": (
        merged_calls,
        f"""with {VIEWS}, one as (select unnest(case when k % 4 in (0, 3) then [0] else [1, 2] end) as part, * from raw)
        select file, 'm' || event_id as message_id, case when part = 2 then 'y' else 'x' end || event_id as uuid, case when part = 2 then ms + 1 else ms end as ts, case when part = 1 then ms else ms + 1 end as ts_last,
        'r' || k as request_id, 'm' || (k % 4) as model, case when part <> 1 then 'tool_use' end as stop_reason, case when part = 2 then 0 else 1 end as text, case when part = 2 then 0 else length(event_type) end as text_chars,
        case when part = 2 then 0 else length(props) end as thinking_chars, case when part = 1 then 0 else 1 end as tool_use, 0 as other,
        k as tokens_in, case when part <> 1 then d end as tokens_out, case when part <> 1 then 2 * k end as tokens_cache_read from one""",
    ),
    "transcript_tool_calls": (
        matched_calls,
        f"""with {VIEWS} select file, id, event_type as name, {SHAPE} as args_shape, ms + 1 as ts, case when k <> 99 then ms + d end as ts_result, case when k <> 99 then d - 1 end as duration_ms, 'y' || event_id as api_uuid,
        'm' || event_id as api_message_id, k <> 99 and k % 7 = 0 as is_error, case when k = 99 then 0 when k % 2 = 0 then length(event_type) else length(event_type) + length(props) end as result_chars, background,
        case when k = 99 then 'unmatched' else 'matched' end as status from uses
        union all select file, id, null, null, null, ms + d + 1, null, null, null, k % 7 = 0, 4, false, 'orphan_result' from uses where k % 13 = 0""",
    ),
    "transcript_prompts": (prompts, f"with {VIEWS} {PROMPTS}"),
    "transcript_notifications": (notifications, f"with {VIEWS} select file, ms + 1000 * k as ts, agent_ref, tool_use_id, status from notes"),
    "transcript_marks": (marks, f"with {VIEWS} {MARKS}"),
    "transcript_sessions": (
        session_outcomes,
        f"""with {VIEWS}, per as (select main, hex, file, min(ms) as t_start, max(greatest(ms + 1, case when k <> 99 then ms + d end, case when k % 13 = 0 then ms + d + 1 end, case when user_id % 4 = 0 and k % 6 = 0 then ms + 1000 * k end)) as t_end,
            sum(3 + (k % 5 = 0)::int + (k <> 99)::int + (k % 13 = 0)::int + (k % 9 = 0)::int + (user_id % 4 = 0 and k % 6 = 0)::int + (k % 17 = 0)::int + (k % 19 = 0)::int)::bigint as n_lines,
            count(*) filter (k % 9 = 0) + count(*) filter (nth > 1) as n_duplicate_lines, count(*) filter (k % 13 = 0) as n_orphan_results, 2 * count(*) as assistant_lines from raw left join ops using (event_id) group by all),
        told as (select notes.main, coalesce(agent_ref, m.hex) as hex, notes.tool_use_id, status, event_id from notes left join metas m on m.main = notes.main and m.tool_use_id = notes.tool_use_id where status <> 'running'),
        by_hex as (select main, hex, arg_max(status, event_id) as status from told where hex is not null group by all), by_use as (select main, tool_use_id, arg_max(status, event_id) as status from told where tool_use_id is not null group by all)
        select p.main::varchar as session, p.hex as agent, t_start, t_end, n_lines, n_duplicate_lines, n_orphan_results, assistant_lines, m.agent_type, m.tool_use_id as spawned_by_tool_use, m.workflow, coalesce(u.background, false) as background,
        case when p.hex is not null then coalesce(h.status, b.status, case when not coalesce(u.background, false) and u.k <> 99 then 'completed' end, 'unknown') end as end_status
        from per p left join metas m on m.main = p.main and m.hex = p.hex left join by_hex h on h.main = p.main and h.hex = p.hex left join by_use b on b.main = p.main and b.tool_use_id = m.tool_use_id left join uses u on u.main = p.main and u.id = m.tool_use_id""",
    ),
    "transcript_spawned_agents": (
        spawned_agents,
        f"""with {VIEWS} select u.main::varchar as session, u.hex as agent, u.id, m.hex as spawned_agent, s.status from uses u join metas m on m.main = u.main and m.tool_use_id = u.id,
        lateral (select case when u.k = 99 then 'unmatched' else 'matched' end as status union all select 'orphan_result' where u.k % 13 = 0) s""",
    ),
    "transcript_events_by_kind": (
        events_by_kind,
        f"""with {VIEWS}, marks as ({MARKS}), prompts_ as ({PROMPTS}) select kind as ev, count(*) as n from marks group by 1 union all select 'prompt', count(*) from prompts_
        union all select 'notification', count(*) from notes union all select 'session', count(distinct file) from raw union all select 'api_call', count(*) + count(*) filter (k % 4 in (1, 2)) from raw
        union all select 'tool_call', count(*) + count(*) filter (k % 13 = 0) from raw""",
    ),
    "transcript_anomalies": (
        anomalies,
        f"with {VIEWS} select 'parse_error' as kind, '' as key, count(*) as n from raw where k % 17 = 0 union all select 'unknown_line_type', 'mystery', count(*) from raw where k % 19 = 0",
    ),
    "trajectory_tool_calls": (
        adapted_calls,
        f"""with {RECORDS} select agent, agent || ':' || (2 * event_id) as id, action as name, 'fn_' || action as function_name,
        {ARGS_SHAPE} as args_shape,
        ms as ts, case when seen then ms + d end as ts_result, case when seen then greatest(0, d) end as duration_ms, case when has_usage then api end as api_uuid, seen and bad as is_error, case when seen then length(body) else 0 end as result_chars,
        case when seen then 'matched' else 'unmatched' end as status from acted where tool""",
    ),
    "trajectory_model_calls": (
        adapted_requests,
        f"""with {RECORDS}, c as (select agent, case when tool then api else turn end as uuid, ms as ts, 'm' || (k % 2) as model, case when tool then greatest(k % 3, 1) else 0 end as tool_use,
        case when has_usage then greatest(0, d + k - k - k % 10) end as tokens_in, case when has_usage then k end as tokens_cache_read, case when has_usage then k % 10 end as tokens_cache_create, tool, event_id from acted where tool or said)
        select * exclude (tool, event_id) from c qualify not tool or row_number() over (partition by agent, uuid, tool order by event_id) = 1""",
    ),
    "trajectory_sessions": (
        adapted_sessions,
        f"""with {RECORDS} select 'events' as session, agent, min(least(ms, case when tool and seen then ms + d end)) as t_start, max(greatest(ms, case when tool and seen then ms + d end)) as t_end,
        case when chunk % 5 = 0 then 'failed' when bool_or(action = 'finish') then 'completed' else 'killed' end as end_status, arg_min('m' || (k % 2), event_id) as agent_type, chunk % 2 = 0 as resolved, case when chunk % 10 = 5 then 'agent got stuck in a loop' when chunk % 5 = 0 then 'step cap' else '' end as harness_error
        from acted group by agent, chunk""",
    ),
    "trajectory_counters": (
        adapted_counters,
        f"""with {RECORDS}, l as (select case when said then 'model_turn_' || action when action = 'recall' then 'skipped_action_recall' when tool and not has_usage then 'call_without_token_usage' end as counter from acted
        union all select case when not seen then 'unmatched_tool_call' when bad then 'error_signal_' || label when label is not null then 'signal_' || label end from acted where tool)
        select counter, count(*) as n from l where counter is not null group by 1""",
    ),
    "trajectory_joins": (adapted_joins, f"with {RECORDS} select count(*) as calls, count(*) filter (has_usage) as joined from acted where tool"),
}
