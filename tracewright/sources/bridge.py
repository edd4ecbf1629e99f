"""A trace over general tables: ``events`` and ``conversations`` read as agent activity.

Each column is a pure function of one row, so SQL can derive the same views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.schema import Trace, event_schema


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _wide(df: DataFrame, kind: str, columns: dict[str, Column]) -> DataFrame:
    """``df`` as events of one kind, with every field of the wide schema."""
    fields = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in event_schema() if f.name != "ev"]
    return df.select(F.lit(kind).alias("ev"), *fields, columns["seq"].cast("long").alias("seq"))


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with k, ms (floored epoch milliseconds) and d (milliseconds of value)."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "props",
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.round(F.col("value") * 1000).cast("long").alias("d"),
    )


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    base = base_events(spark, sf_dir)
    k, ms, d, user = (F.col(c) for c in ("k", "ms", "d", "user_id"))
    agent = F.when(user % 4 != 0, user)
    here = {"session": user, "agent": agent, "seq": F.col("event_id")}

    tool_calls = _wide(
        base,
        "tool_call",
        here
        | {
            "ts": F.when(k != 98, ms),
            "ts_result": F.when(k != 99, ms + d),
            "duration_ms": F.when(k < 98, d),
            "id": F.col("event_id"),
            "name": F.when(k != 98, F.col("event_type")),
            "args_shape": F.when(k != 98, F.concat(F.lit("props:s"), F.length("props"))),
            "api_uuid": F.when(k % 3 != 0, F.col("event_id")),
            "is_error": F.when(k == 99, False).otherwise(k % 7 == 0),
            "result_chars": F.when(k == 99, 0).otherwise(k),
            "background": k % 11 == 0,
            "status": F.when(k == 99, "unmatched").when(k == 98, "orphan_result").otherwise("matched"),
        },
    )
    api_calls = _wide(
        base.where("k % 3 != 0"),
        "api_call",
        here
        | {
            "ts": ms,
            "ts_last": ms + 10 * k - 50,
            "uuid": F.col("event_id"),
            "model": F.concat(F.lit("m"), k % 4),
            "blocks": F.struct(F.lit(1).cast("long"), k, F.lit(0).cast("long"), F.lit(0).cast("long"), k % 4, F.lit(0).cast("long")),
            "usage": F.struct(d % 100, k, d - d % 100, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        },
    )
    users = base.groupBy("user_id").agg(F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.max("event_id").alias("event_id"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "failed", "killed", "unknown", None)]), (user % 5 + 1).cast("int"))
    sessions = _wide(
        users,
        "session",
        here
        | {
            "ts": F.col("t0"),
            "t_start": F.col("t0"),
            "t_end": F.col("t1"),
            "project": F.concat(F.lit("p"), user % 6),
            "agent_type": F.when(agent.isNotNull() & (user % 3 != 0), F.concat(F.lit("type"), user % 3)),
            "spawn_depth": F.when(agent.isNotNull(), user % 3),
            "background": user % 2 == 0,
            "workflow": F.when(user % 7 == 0, F.lit("wf")),
            "end_status": F.when(agent.isNotNull(), status),
        },
    )
    notifications = _wide(base.where("event_type = 'purchase'"), "notification", {"session": user, "agent_ref": user, "ts": ms + 1000 * k, "status": F.lit("completed"), "seq": F.col("event_id")})
    compacts = _wide(base.where("event_type = 'signup' and k % 2 = 0"), "compact", here | {"ts": ms, "trigger": F.when(k % 4 == 0, "auto").otherwise("manual"), "pre_tokens": d})
    queue_ops = _wide(base.where("event_type = 'click'"), "queue_op", here | {"ts": ms, "op": F.when(k % 2 == 0, "enqueue").when(k % 3 == 0, "dequeue"), "content_chars": k})
    talk = read(spark, sf_dir, "conversations").withColumn("_seq", F.col("conv_id") * 1000 + F.col("turn"))
    said = {"session": F.concat(F.lit("c"), F.col("conv_id")), "ts": F.col("turn") * 1000 + F.length("text"), "seq": F.col("_seq")}
    prompts = _wide(talk.where("role = 'user'"), "prompt", said | {"text_chars": F.length("text"), "sidechain": F.lit(False)})
    turns = _wide(
        talk.where("role = 'assistant'"), "turn", said | {"duration_ms": 10 * F.length("text"), "message_count": F.col("turn"), "pending_background_agents": F.nullif(F.col("turn") % 3, F.lit(0))}
    )
    events = tool_calls
    for part in (api_calls, sessions, notifications, compacts, queue_ops, prompts, turns):
        events = events.unionByName(part)
    return Trace(events)


#: The same views in DuckDB's SQL, by name.
SQL = {
    "base": """select event_id, event_type, props, user_id, (props->>'$.k')::bigint as k, epoch_us(ts) // 1000 as ms,
        round(value * 1000)::bigint as d, user_id::varchar as session, case when user_id % 4 <> 0 then user_id::varchar end as agent, event_id as seq from events""",
    "tool_calls": """select session, agent, seq, case when k <> 98 then ms end as ts, case when k <> 99 then ms + d end as ts_result,
        case when k < 98 then d end as duration_ms, case when k <> 98 then event_type end as name,
        case when k <> 98 then 'props:s' || length(props) end as args_shape, case when k % 3 <> 0 then event_id end as api_uuid,
        case when k = 99 then false else k % 7 = 0 end as is_error, case when k = 99 then 0 else k end as result_chars, k % 11 = 0 as background,
        case when k = 99 then 'unmatched' when k = 98 then 'orphan_result' else 'matched' end as status,
        coalesce(nullif(case when k <> 98 then ms end, 0), nullif(case when k <> 99 then ms + d end, 0), 0) as sort_ts from base""",
    "api_calls": """select session, agent, seq, ms as ts, ms + 10 * k - 50 as ts_last, event_id as uuid, 'm' || (k % 4) as model, k % 4 as tool_use,
        d % 100 as tok_in, k as tok_out, d - d % 100 as cache_read, 0::bigint as cache_create, d as context_tokens from base where k % 3 <> 0""",
    "sessions": """select session, agent, max(event_id) as seq, min(ms) as t_start, max(ms) as t_end, 'p' || (user_id % 6) as project,
        case when agent is not null and user_id % 3 <> 0 then 'type' || (user_id % 3) end as agent_type, case when agent is not null then user_id % 3 end as spawn_depth,
        user_id % 2 = 0 as background, case when user_id % 7 = 0 then 'wf' end as workflow,
        case when agent is not null then ['completed', 'failed', 'killed', 'unknown', null][1 + user_id % 5] end as end_status from base group by user_id, session, agent""",
    "notifications": "select session, session as agent_ref, ms + 1000 * k as ts from base where event_type = 'purchase'",
    "compacts": "select session, agent, ms as ts, case when k % 4 = 0 then 'auto' else 'manual' end as trigger from base where event_type = 'signup' and k % 2 = 0",
    "queue_ops": "select case when k % 2 = 0 then 'enqueue' when k % 3 = 0 then 'dequeue' end as op, seq from base where event_type = 'click'",
    "prompts": "select 'c' || conv_id as session, turn * 1000 + length(text) as ts, conv_id * 1000 + turn as seq from conversations where role = 'user'",
    "turns": "select 10 * length(text) as duration_ms, nullif(turn % 3, 0) as pending from conversations where role = 'assistant'",
}


def with_views(query: str) -> str:
    """``query`` behind the views it names."""
    import re

    used = [n for n in SQL if re.search(rf"\b{n}\b", query)]
    needed = {n for n in used} | ({"base"} if any(re.search(r"\bbase\b", SQL[n]) for n in used) else set())
    if not needed:
        return query.strip()
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in SQL if n in needed)
    rest = query.strip()
    return f"with {ctes}" + (",\n" + rest[5:] if rest[:5].lower() == "with " else "\n" + rest)
