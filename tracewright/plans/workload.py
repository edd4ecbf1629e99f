"""A log as a workload: turns, model steps and tools, their replay without contention,
replicas, and the choice of a scheduling policy from a queue.

The contended backend is not rebuilt: it is sequential by nature.  What is relational in
it is here: building the jobs, replay at unlimited capacity in closed form, load scaling,
and selection as a top-k.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.stats import dist_of
from tracewright.operators.joins import asof_backward
from tracewright.operators.sequences import replay_completion
from tracewright.schema import Trace
from tracewright.storage import materialize

MIN_SERVICE_MS = 1
ACK_MS = 1000
REPLICA_SEED = 4
STARVE_MS = 60_000.0
POLICIES = ("fifo", "sjf", "unblock", "affinity", "combined")


def _same_stream(left: str, right: str) -> Column:
    return (F.col(f"{left}.session") == F.col(f"{right}.session")) & F.col(f"{left}.agent").eqNullSafe(F.col(f"{right}.agent"))


def assign_turns(trace: Trace) -> DataFrame:
    """Model calls with ``turn`` (from 0 within the stream) and ``prompt_ts``.

    A call belongs to the latest prompt at or before it; those before any prompt form a
    turn of their own.  Sidechain prompts open no turn on a main stream, and a main stream
    without prompts has no turns.
    """
    prompts = trace.prompts.where(F.col("ts").isNotNull() & (F.col("agent").isNotNull() | ~F.coalesce("sidechain", F.lit(False))))
    numbered = prompts.withColumn("_idx", F.row_number().over(Window.partitionBy("session", "agent").orderBy("ts", "seq")))
    calls = trace.api_calls.where("ts is not null")
    placed = asof_backward(calls, numbered, ["session", "agent"], "ts", "ts", F.struct("_idx", "ts"), "_prompt")
    has_prompts = numbered.where("agent is null").select(F.col("session").alias("_s")).distinct()
    kept = placed.join(has_prompts, F.col("agent").isNull() & (F.col("session") == F.col("_s")), "left").where(F.col("agent").isNotNull() | F.col("_s").isNotNull())
    idx = F.coalesce(F.col("_prompt._idx"), F.lit(-1))
    turn = F.dense_rank().over(Window.partitionBy("session", "agent").orderBy(idx)) - 1
    return kept.withColumns({"turn": turn.cast("int"), "prompt_ts": F.col("_prompt.ts")}).drop("_prompt", "_s")


def spawn_times(trace: Trace) -> DataFrame:
    """The time of the last call that spawned each agent."""
    calls = trace.tool_calls.where("spawned_agent is not null and spawned_agent != '' and ts is not null")
    return calls.groupBy("session", F.col("spawned_agent").alias("agent")).agg(F.max_by("ts", "seq").alias("spawn_ts"))


def tools(trace: Trace) -> DataFrame:
    """Tools of model steps, by stream and api uuid: duration, child, background.

    A child without model calls is no child; its traced delay stands for it.
    """
    children = trace.api_calls.where("agent is not null and ts is not null").select(F.col("session").alias("_s"), F.col("agent").alias("_child")).distinct()
    linked = trace.tool_calls.where("api_uuid is not null and api_uuid != ''")
    joined = linked.join(children, (F.col("session") == F.col("_s")) & (F.col("spawned_agent") == F.col("_child")), "left")
    return joined.select(
        "session",
        "agent",
        "api_uuid",
        F.col("id").alias("tool_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("?")).alias("name"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        "ts_result",
        F.coalesce("background", F.lit(False)).alias("background"),
        F.col("_child").alias("child"),
        "seq",
    )


def steps(trace: Trace) -> DataFrame:
    """Model steps: stream, turn, step, uuid, arrival_ts, service_ms, pre_gap_ms, ready_ts, spawned.

    ``ready_ts`` is when a step's model call and its waited-for tools were done; the gap
    before the next step runs from there, and before the first from the turn's arrival.
    """
    calls = assign_turns(trace)
    waits = tools(trace).where("not background and ts_result is not null").groupBy("session", "agent", "api_uuid").agg(F.max("ts_result").alias("_tools_end"))
    joined = calls.alias("c").join(waits.alias("w"), _same_stream("c", "w") & (F.col("c.uuid") == F.col("w.api_uuid")), "left").select("c.*", "_tools_end")
    sessions = trace.last_sessions.select("session", "agent", "t_start")
    joined = joined.alias("c").join(sessions.alias("s"), _same_stream("c", "s"), "left").select("c.*", "s.t_start")
    joined = joined.join(spawn_times(trace), ["session", "agent"], "left")

    last = F.greatest(F.coalesce(F.nullif("ts_last", F.lit(0)), F.col("ts")), F.col("ts"))
    in_turn = Window.partitionBy("session", "agent", "turn")
    order = in_turn.orderBy("ts", "seq")
    first_ts = F.min("ts").over(in_turn)
    spawned = F.col("agent").isNotNull() & (F.col("turn") == 0)
    opened = F.when(spawned, F.coalesce(F.nullif("spawn_ts", F.lit(0)), F.nullif("t_start", F.lit(0)), first_ts)).otherwise(F.coalesce("prompt_ts", first_ts))
    rows = joined.withColumns({"_last": last, "ready_ts": F.greatest(last, F.coalesce("_tools_end", last)), "spawned": spawned, "arrival_ts": F.least(opened, first_ts)})
    before = F.coalesce(F.lag("ready_ts").over(order), F.col("arrival_ts"))
    return rows.select(
        "session",
        "agent",
        "turn",
        (F.row_number().over(order) - 1).alias("step"),
        "uuid",
        "ts",
        "arrival_ts",
        F.greatest(F.col("_last") - F.col("ts"), F.lit(MIN_SERVICE_MS)).alias("service_ms"),
        F.greatest(F.col("ts") - before, F.lit(0)).alias("pre_gap_ms"),
        "ready_ts",
        "spawned",
    )


def turns(step_rows: DataFrame) -> DataFrame:
    """One row per turn: arrival, steps, and the latency that the log shows (null if none)."""
    latency = F.max("ready_ts") - F.min("arrival_ts")
    return step_rows.groupBy("session", "agent", "turn", "spawned").agg(
        F.min("arrival_ts").alias("arrival_ts"), F.count("*").alias("n_steps"), F.sum(F.col("service_ms") + F.col("pre_gap_ms")).alias("model_ms"), F.when(latency > 0, latency).alias("traced_ms")
    )


def reconcile(tool_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """``tool_rows`` with spawns set right by the log, and ``overhead_ms``.

    A call that returned over a second before its child was done didn't wait: it counts as
    background.  One that waited keeps what it waited beyond the child as overhead.
    """
    child = turn_rows.where("spawned").select(F.col("session").alias("_s"), F.col("agent").alias("_a"), F.col("traced_ms").alias("_child_ms"))
    joined = tool_rows.join(child, (F.col("session") == F.col("_s")) & (F.col("child") == F.col("_a")), "left").drop("_s", "_a")
    early = ~F.col("background") & (F.col("duration_ms") + ACK_MS < F.col("_child_ms"))
    waited = ~F.col("background") & ~F.coalesce(early, F.lit(False)) & F.col("_child_ms").isNotNull()
    over = F.when(waited, F.greatest(F.lit(0), F.col("duration_ms") - F.col("_child_ms"))).otherwise(F.lit(0))
    return joined.withColumns({"overhead_ms": over, "reclassified": F.coalesce(early, F.lit(False)), "background": F.col("background") | F.coalesce(early, F.lit(False))}).drop("_child_ms")


def replay(trace: Trace) -> DataFrame:
    """Turns replayed at unlimited capacity: latency_ms beside traced_ms, and completion_ts.

    A step's tools run side by side; one that waits for a child takes the child's own
    replayed time and its overhead.  Children are settled from the leaves up, a level a
    round, until no turn's time changes: as many rounds as agents wait for each other in a
    chain.  Agents that wait for each other in a circle have no such time, and raise.
    """
    step_rows = steps(trace).persist()  # each level reads them again
    turn_rows = turns(step_rows).persist()
    settled = reconcile(tools(trace), turn_rows)
    placed = settled.alias("t").join(step_rows.alias("s"), _same_stream("t", "s") & (F.col("t.api_uuid") == F.col("s.uuid"))).select("t.*", "s.turn", "s.step").persist()
    waited = placed.where("child is not null and not background")
    nested = waited.limit(1).count() > 0
    most = waited.select("session", "child").distinct().count() + 1 if nested else 0  # a chain has no child twice
    latency = turn_rows.select("session", "agent", "turn", "spawned", F.col("model_ms").alias("latency_ms"))
    last, rounds = None, 0
    while True:
        child = latency.where("spawned").select(F.col("session").alias("_s"), F.col("agent").alias("_a"), F.col("latency_ms").alias("_child_ms"))
        timed = placed.join(child, (F.col("session") == F.col("_s")) & (F.col("child") == F.col("_a")), "left")
        waits = F.col("child").isNotNull() & ~F.col("background") & F.col("_child_ms").isNotNull()
        taken = F.when(waits, F.col("_child_ms") + F.col("overhead_ms")).otherwise(F.col("duration_ms"))
        per_step = timed.groupBy("session", "agent", "turn", "step").agg(F.max(taken).alias("_ms"))
        per_turn = per_step.groupBy("session", "agent", "turn").agg(F.sum("_ms").alias("_tools_ms"))
        joined = turn_rows.alias("r").join(per_turn.alias("p"), _same_stream("r", "p") & (F.col("r.turn") == F.col("p.turn")), "left")
        latency = joined.select("r.*", (F.col("r.model_ms") + F.coalesce("p._tools_ms", F.lit(0))).alias("latency_ms"))
        if not nested:
            break
        latency, rounds = materialize(latency, "replay-round"), rounds + 1
        if last is not None:
            now, before = latency.alias("n"), last.alias("l")
            same = _same_stream("n", "l") & (F.col("n.turn") == F.col("l.turn")) & F.col("n.latency_ms").eqNullSafe(F.col("l.latency_ms"))
            if not now.join(before, same, "left_anti").agg(F.count("*")).first()[0]:
                break
        if rounds > most + 1:
            raise ValueError("agents wait for each other in a circle")
        last = latency
    return replay_completion(latency, ["session", "agent"], "arrival_ts", "latency_ms", ["arrival_ts", "turn"]).withColumnRenamed("completion", "completion_ts")


def fidelity(replayed: DataFrame) -> DataFrame:
    """Distribution of |replayed - traced| / traced over main turns."""
    main = replayed.where("agent is null and traced_ms > 0")
    error = F.abs(F.col("completion_ts") - F.col("arrival_ts") - F.col("traced_ms")) / F.col("traced_ms")
    return dist_of(main.select(F.round(error, 4).alias("_e")), "_e")


def replicate(turn_rows: DataFrame, factor: int, seed: int = REPLICA_SEED) -> DataFrame:
    """``factor`` copies of the workload as sessions of their own, shifted by seeded offsets
    drawn over the span of arrivals; copy 0 is the original."""
    if factor < 1:
        raise ValueError(f"replicate factor must be 1 or more, got {factor}")
    start = turn_rows.agg(F.min("arrival_ts"), F.max(F.when(~F.col("spawned"), F.col("arrival_ts")))).first()
    span = float((start[1] or 0) - (start[0] or 0)) if start[1] is not None else 0.0
    draw = random.Random(seed)
    offsets = [0.0] + [draw.uniform(0.0, span) for _ in range(factor - 1)]
    copies = turn_rows.sparkSession.createDataFrame(list(enumerate(offsets)), "replica int, offset_ms double")
    tagged = F.when(F.col("replica") == 0, F.col("session")).otherwise(F.concat(F.lit("r"), F.col("replica"), F.lit(":"), F.col("session")))
    many = turn_rows.crossJoin(F.broadcast(copies))  # ``factor`` rows
    return many.withColumns({"session": tagged, "arrival_ms": F.col("arrival_ts") + F.col("offset_ms")})


def policy_order(policy: str, now: Column, starve_ms: float = STARVE_MS) -> list[Column]:
    """Sort keys of a queue (ready_ms, service_ms, waiters, warm, pos) under a policy.

    Requests that waited ``starve_ms`` go first, oldest first; ties keep queue order.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    if policy == "fifo":
        return [F.col("ready_ms"), F.col("pos")]
    starved = now - F.col("ready_ms") >= starve_ms
    cold = F.when(F.col("warm") == 1, 0).otherwise(1)
    keys = {"sjf": [F.col("service_ms")], "unblock": [-F.col("waiters")], "affinity": [cold], "combined": [-F.col("waiters"), cold]}[policy]
    return [F.when(starved, 0).otherwise(1), F.when(starved, F.col("ready_ms")), *[F.when(~starved, k) for k in keys], F.col("pos")]


def select_requests(queue: DataFrame, policy: str, k: int, now: Column | float, starve_ms: float = STARVE_MS) -> DataFrame:
    """The first ``k`` requests of each ``queue_id`` under a policy, with their ``rank``.

    Not-a-number times or services raise when the plan runs.
    """
    now = F.lit(float(now)) if isinstance(now, (int, float)) else now
    bad = F.isnan("ready_ms") | F.isnan("service_ms") | F.isnan(now)
    checked = queue.withColumn("ready_ms", F.when(bad, F.raise_error(F.lit("not a number in queue")).cast("double")).otherwise(F.col("ready_ms")))
    rank = F.row_number().over(Window.partitionBy("queue_id").orderBy(*policy_order(policy, now, starve_ms)))
    return checked.withColumn("rank", rank).where(F.col("rank") <= max(0, k))
