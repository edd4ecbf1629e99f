"""``events`` rendered as raw transcript lines and as trajectory records.

The parsers of this folder read what is rendered here as they read files, so that SQL over
``events`` can say what they must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.bridge import base_events

#: Events of one user that make one trajectory record.
CHUNK = 64


def _iso(ms: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _named(**fields: Column | str | int) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _line(kind: str, ms: Column, **fields: Column | str) -> Column:
    return F.to_json(_named(type=kind, timestamp=_iso(ms), version="1.0", **fields), {"ignoreNullFields": "false"})


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as :func:`~tracewright.sources.transcripts.read_lines` gives them.

    Users whose id 4 divides have a main thread; the three ids above each are its agents.
    An event becomes a model call of two lines with something between them, a tool use, its
    result, and now and then a prompt, a second result, a line written twice, a notification,
    or a line that the format doesn't know.  Events are dealt to tasks while they are narrow:
    however few splits a table's file has, its lines are rendered and cut side by side.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = base_events(spark, sf_dir).where("user_id is not null").repartition(parts, "event_id")
    k, ms, d, kind, props = (F.col(c) for c in ("k", "ms", "d", "event_type", "props"))
    e, user = F.col("event_id").cast("string"), F.col("user_id")
    id_ = lambda letter: F.concat(F.lit(letter), e)
    block = lambda **f: F.array(_named(**f))
    said = lambda uuid, at, content, **m: _line("assistant", at, uuid=id_(uuid), requestId=F.concat(F.lit("r"), k), message=_named(id=id_("m"), model=F.concat(F.lit("m"), k % 4), content=content, **m))
    result = lambda uuid, at, content: _line("user", at, uuid=id_(uuid), message=_named(role="user", content=block(type="tool_result", tool_use_id=id_("t"), content=content, is_error=k % 7 == 0)))
    text = lambda value: _named(type="text", text=value)
    tags = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 3).cast("int"))
    arguments = _named(k=k, value=k + 0.5, big=k % 2 == 0, tags=tags, run_in_background=k % 11 == 0, note=props, none=F.lit(None).cast("string"))
    use = said("y", ms + 1, block(type="tool_use", id=id_("t"), name=kind, input=arguments), stop_reason="tool_use", usage=_named(input_tokens=k, output_tokens=d, cache_read_input_tokens=2 * k))
    status = F.when(k % 4 == 0, " failed ").when(k % 4 == 1, "completed").when(k % 4 == 2, "running").otherwise("killed")
    whom = F.when(k % 12 == 0, F.concat(F.lit("<task-id>agent-a"), user + 1 + k % 3, F.lit("</task-id>"))).otherwise(F.concat(F.lit("<tool-use-id>"), id_("t"), F.lit("</tool-use-id>")))
    notice = F.concat(F.lit("<task-notification>"), whom, F.lit("<status>"), status, F.lit("</status></task-notification>"))
    between = (
        F.when(k % 4 == 0, _line("queue-operation", ms, operation="enqueue", content=props))
        .when(k % 4 == 1, _line("system", ms, uuid=id_("s"), subtype="turn_duration", durationMs=d, messageCount=k))
        .when(k % 4 == 2, _line("system", ms, uuid=id_("s"), subtype="compact_boundary", compactMetadata=_named(trigger=F.when(k % 3 == 0, "auto").otherwise("manual"), preTokens=d)))
        .otherwise(_line("summary", ms))
    )
    prompt = lambda content: _line("user", ms, uuid=id_("u"), message=_named(role="user", content=content), isMeta=k % 10 == 0)
    parts = [
        F.when(k % 5 == 0, F.when(k % 15 == 0, prompt(F.array(text(props)))).otherwise(prompt(props))),
        said("x", ms, F.array(_named(type="text", text=kind, thinking=F.lit(None).cast("string")), _named(type="thinking", text=F.lit(None).cast("string"), thinking=props)), usage=_named(input_tokens=k)),
        between,
        use,
        F.when(k != 99, F.when(k % 2 == 0, result("z", ms + d, kind)).otherwise(result("z", ms + d, F.array(text(kind), text(props))))),
        F.when(k % 13 == 0, result("w", ms + d + 1, F.lit("late"))),
        F.when(k % 9 == 0, use),
        F.when((user % 4 == 0) & (k % 6 == 0), _line("user", ms + 1000 * k, uuid=id_("n"), message=_named(role="user", content=notice))),
        F.when(k % 17 == 0, F.lit("{broken")),
        F.when(k % 19 == 0, _line("mystery", ms)),
    ]
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), p.alias("value")) for i, p in enumerate(parts)])
    main = user - user % 4
    is_agent = user % 4 != 0
    file = F.when(is_agent, F.concat(F.lit("p/"), main, F.lit("/subagents/agent-a"), user, F.lit(".jsonl"))).otherwise(F.concat(F.lit("p/"), main, F.lit(".jsonl")))
    rows = base.select(F.lit("p").alias("project_dir"), main.cast("string").alias("session"), F.when(is_agent, F.concat(F.lit("a"), user)).alias("agent_hex"), file.alias("file"), "event_id", F.explode(numbered).alias("p")).where("p.value is not null")
    return rows.select("project_dir", "session", "agent_hex", "file", (F.col("event_id") * len(parts) + F.col("p.i")).cast("long").alias("line"), F.col("p.value").alias("value"))


def transcript_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metas as :func:`~tracewright.sources.transcripts.read_metas` gives them: of a thread's
    three agents, its first use spawned the first, its last the second, and none the third."""
    base = base_events(spark, sf_dir).where("user_id is not null")
    threads = base.groupBy((F.col("user_id") - F.col("user_id") % 4).alias("main")).agg(*[f(F.when(F.col("user_id") % 4 == 0, F.col("event_id"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    agents = threads.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    spawn = F.when(F.col("i") == 1, F.col("first")).when((F.col("i") == 2) & (F.col("last") > F.col("first")), F.col("last"))
    none = F.lit(None).cast("string")
    return agents.select(
        F.lit("p").alias("project_dir"),
        F.col("main").cast("string").alias("session"),
        F.concat(F.lit("a"), F.col("main") + F.col("i")).alias("agent_hex"),
        F.concat(F.lit("kind"), F.col("i")).alias("agent_type"),
        F.concat(F.lit("t"), spawn).alias("tool_use_id"),
        F.lit(1).alias("spawn_depth"),
        none.alias("model"),
        none.alias("effort"),
        F.when(F.col("i") == 3, "wf_x").alias("workflow"),
        F.concat(F.lit("p/"), F.col("main"), F.lit("/subagents/agent-a"), F.col("main") + F.col("i"), F.lit(".meta.json")).alias("file"),
    )


def trajectory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as :func:`~tracewright.sources.trajectories.read_records` gives them: each
    ``CHUNK`` of event ids of a user is one, its history flat or in pairs by turns."""
    base = base_events(spark, sf_dir).where("user_id is not null")
    k, ms, d, props = (F.col(c) for c in ("k", "ms", "d", "props"))
    e = F.col("event_id")
    naive = lambda at: F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    action = F.element_at(F.array(*[F.lit(a) for a in ("run", "edit", "browse", "message", "recall", "finish")]), (F.when(k % 6 == 5, F.when(k == 95, 5).otherwise(0)).otherwise(k % 6) + 1).cast("int"))
    call_id = F.concat(F.lit("c"), e)
    recorded = F.when(k % 4 == 0, F.to_json(_named(command=props, n=k))).when(k % 4 == 1, "no json")
    choices = F.array(_named(message=_named(tool_calls=F.array(_named(id=call_id, function=_named(arguments=recorded))))))
    usage = F.when(k % 5 != 4, _named(prompt_tokens=d + k, cache_read_input_tokens=k, cache_creation_input_tokens=k % 10))
    meta = _named(function_name=F.concat(F.lit("fn_"), action), tool_call_id=call_id, total_calls_in_response=k % 3, model_response=_named(id=F.concat(F.lit("r"), k % 5), model=F.concat(F.lit("m"), k % 2), choices=choices, usage=usage))
    act = _named(
        id=2 * e,
        timestamp=naive(ms),
        source=F.when((k % 2 == 1) & (action == "message"), "user").otherwise("agent"),
        action=action,
        args=_named(command=props, path="p", content=props, url="u", thought="t"),
        tool_call_metadata=meta,
    )
    body = F.when(k % 8 == 2, "  ERROR: no").when(k % 8 == 4, "[No exact match found in x").otherwise(props)
    observed = _named(id=2 * e + 1, timestamp=naive(ms + d), cause=2 * e, observation="x", content=body, extras=F.when(k % 3 == 0, _named(exit_code=k % 7)))
    seen = F.filter(F.array(F.to_json(act), F.when((k != 99) & (k % 10 != 9), F.to_json(observed))), lambda x: x.isNotNull())
    chunk = F.floor(e / CHUNK).cast("long")
    held = base.select("user_id", chunk.alias("chunk"), F.struct(e.alias("at"), seen.alias("seen")).alias("h")).groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list("h")).alias("h"))
    pairs = F.transform("h", lambda h: h["seen"])
    listed = lambda texts: F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    history = F.when(F.col("chunk") % 2 == 0, listed(F.flatten(pairs))).otherwise(listed(F.transform(pairs, listed)))
    instance = F.concat(F.lit("i"), F.col("user_id"), F.lit("-"), F.col("chunk"))
    error = F.when(F.col("chunk") % 10 == 5, "agent got stuck in a loop").when(F.col("chunk") % 5 == 0, "step cap").otherwise("")
    value = F.concat(F.lit('{"instance_id":"'), instance, F.lit('","error":"'), error, F.lit('","report":{"resolved":'), (F.col("chunk") % 2 == 0).cast("string"), F.lit('},"history":'), history, F.lit("}"))
    return held.select(F.lit("events").alias("session"), F.parse_json(value).alias("v"), (F.col("user_id") * 100_000_000 + F.col("chunk")).alias("record"), instance.alias("agent"))
