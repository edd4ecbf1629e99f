"""Workload distributions: corpus, arrivals, tool latency, structure, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import dist_of, share
from tracewright.operators.sequences import gaps_between, with_overlap
from tracewright.operators.topk import most_common
from tracewright.schema import Trace

LONG_MS = (10_000, 30_000, 60_000)
TOP_TOOLS = 12


def named(column: str = "name") -> Column:
    """The name, ``?`` where it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("?"))


def timed_calls(calls: DataFrame) -> DataFrame:
    """Calls that matched a result and took a known time."""
    return calls.where("status = 'matched' and duration_ms >= 0")


def answered(calls: DataFrame) -> Column:
    return ~F.coalesce(F.col("status").isin("unmatched", "orphan_result"), F.lit(False))


def corpus(trace: Trace) -> DataFrame:
    """One row: sessions, agents, span_days, session_hours_total, and the distribution of minutes of a session."""
    wall = F.when(F.col("agent").isNull(), F.col("t_end") - F.col("t_start"))
    main = lambda c: F.when(F.col("agent").isNull(), F.col(c))
    sessions = trace.sessions.withColumn("_minutes", wall / 60_000)
    return dist_of(
        sessions,
        "_minutes",
        F.count_if(F.col("agent").isNull()).alias("sessions"),
        F.count("agent").alias("agents"),
        F.coalesce(F.round((F.max(main("t_end")) - F.min(main("t_start"))) / 86_400_000, 1), F.lit(0.0)).alias("span_days"),
        F.coalesce(F.round(F.sum(wall) / 3_600_000, 1), F.lit(0.0)).alias("session_hours_total"),
    )


def models(trace: Trace) -> DataFrame:
    return most_common(trace.api_calls.where("model is not null and model != ''"), "model", name="model")


def main_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.where(F.col("agent").isNull() & ~F.coalesce("sidechain", F.lit(False)))


def prompts_per_session(prompts: DataFrame) -> DataFrame:
    per = main_prompts(prompts).groupBy("session").agg(F.count("*").alias("_n"))
    return dist_of(per, "_n", F.coalesce(F.sum("_n"), F.lit(0)).alias("prompts"))


def inter_arrival(prompts: DataFrame) -> DataFrame:
    """Distribution of seconds between a session's neighbouring prompts, where over zero."""
    return dist_of(gaps_between(main_prompts(prompts), ["session"]).select((F.col("gap") / 1000).alias("_s")), "_s")


def queue_ops(trace: Trace) -> DataFrame:
    return most_common(trace.queue_ops, named("op"), name="op")


def queue_delivered(trace: Trace) -> DataFrame:
    """Dequeued prompts as a share of prompts."""
    both = main_prompts(trace.prompts).agg(F.count("*").alias("prompts")).crossJoin(trace.queue_ops.agg(F.count_if(F.col("op") == "dequeue").alias("delivered")))
    return both.withColumn("share", share(F.col("delivered"), F.col("prompts"), 3))


def tool_counts(calls: DataFrame) -> DataFrame:
    """One row: calls by outcome, error rate and background share of the matched."""
    ok = answered(calls)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sums = calls.agg(
        F.count_if(ok).alias("calls_matched"),
        F.count_if(F.col("status") == "unmatched").alias("calls_unmatched"),
        F.count_if(F.col("status") == "orphan_result").alias("calls_orphan"),
        F.count_if(ok & flag("is_error")).alias("_errors"),
        F.count_if(ok & flag("background")).alias("_background"),
    )
    return sums.select(
        "calls_matched",
        "calls_unmatched",
        "calls_orphan",
        share(F.col("_errors"), F.col("calls_matched"), 4).alias("error_rate"),
        share(F.col("_background"), F.col("calls_matched"), 4).alias("background_share"),
    )


def tool_durations(calls: DataFrame) -> DataFrame:
    return dist_of(timed_calls(calls), "duration_ms", F.coalesce(F.round(F.sum("duration_ms") / 3_600_000, 1), F.lit(0.0)).alias("total_hours"))


def by_tool(calls: DataFrame, k: int = TOP_TOOLS) -> DataFrame:
    """The ``k`` most used tools: calls, p50, p95, and share of all tool time."""
    timed = timed_calls(calls)
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)").cast("double")
    top = most_common(timed, named(), k, "seq", (rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), F.sum("duration_ms").alias("_ms")), "tool")
    total = timed.agg(F.sum("duration_ms").alias("_total"))
    return top.crossJoin(F.broadcast(total)).select("tool", "n", "p50_ms", "p95_ms", share(F.col("_ms"), F.col("_total"), 3).alias("time_share"))  # one row


def long_calls(calls: DataFrame) -> DataFrame:
    """For each threshold the share of calls and of time at or above it."""
    over = lambda t: F.col("duration_ms") >= t
    sums = timed_calls(calls).agg(
        F.count("*").alias("_n"),
        F.sum("duration_ms").alias("_ms"),
        F.array(*[F.struct(F.lit(t).alias("over_ms"), F.count_if(over(t)).alias("n"), F.sum(F.when(over(t), F.col("duration_ms"))).alias("ms")) for t in LONG_MS]).alias("_tiers"),
    )
    rows = sums.select("_n", "_ms", F.explode("_tiers").alias("t"))
    return rows.select("t.over_ms", share(F.col("t.n"), F.col("_n"), 4).alias("call_share"), share(F.coalesce("t.ms", F.lit(0)), F.col("_ms"), 4).alias("time_share"))


def busy_share(trace: Trace) -> DataFrame:
    """Tool time as a share of tool and model time."""
    tools = timed_calls(trace.tool_calls).agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("tool_ms"))
    model = trace.api_calls.where("ts_last >= ts").agg(F.coalesce(F.sum(F.col("ts_last") - F.col("ts")), F.lit(0)).alias("model_ms"))
    both = tools.crossJoin(model)  # one row each
    return both.select("tool_ms", "model_ms", F.round(F.col("model_ms") / 3_600_000, 1).alias("model_hours"), share(F.col("tool_ms"), F.col("tool_ms") + F.col("model_ms"), 3).alias("tool_share"))


def fan_out(api_calls: DataFrame) -> DataFrame:
    """Model calls that issue tools, and those that issue two or more."""
    n = F.coalesce(F.col("blocks.tool_use"), F.lit(0))
    sums = api_calls.agg(F.count("*").alias("api_calls"), F.count_if(n >= 1).alias("_with"), F.count_if(n >= 2).alias("_parallel"), F.coalesce(F.max(n), F.lit(0)).alias("fanout_max"))
    return sums.select("api_calls", share(F.col("_with"), F.col("api_calls"), 3).alias("with_tools_share"), share(F.col("_parallel"), F.col("_with"), 3).alias("parallel_share"), "fanout_max")


def agents_per_session(trace: Trace) -> DataFrame:
    per = trace.sessions.where("agent is not null").groupBy("session").agg(F.count("*").alias("_n"))
    return dist_of(per, "_n")


def spawn_depths(trace: Trace) -> DataFrame:
    return trace.sessions.where("agent is not null and spawn_depth is not null").groupBy("spawn_depth").agg(F.count("*").alias("n"))


def agent_end_status(trace: Trace) -> DataFrame:
    status = F.coalesce(F.nullif("end_status", F.lit("")), F.lit("unknown"))
    return most_common(trace.sessions.where("agent is not null"), status, name="end_status")


def agent_runtime(trace: Trace) -> DataFrame:
    """Distribution of an agent's minutes, with the share that ran in the background."""
    agents = trace.sessions.where("agent is not null").withColumn("_minutes", (F.col("t_end") - F.col("t_start")) / 60_000)
    return dist_of(agents, "_minutes", F.round(share(F.count_if(F.coalesce("background", F.lit(False))), F.count("*")), 3).alias("background_share"))


def parallel_overlap(calls: DataFrame) -> DataFrame:
    """Share of timed calls that start before an earlier call of their stream ended."""
    placed = with_overlap(timed_calls(calls).where("ts is not null and ts_result is not null"))
    return placed.agg(F.count_if("overlaps").alias("overlapped"), F.count("*").alias("streamed")).withColumn("share", share(F.col("overlapped"), F.col("streamed"), 3))


def notification_lag(trace: Trace) -> DataFrame:
    """Distribution of seconds from an agent's end to notifications of it."""
    ended = trace.sessions.where("agent is not null and t_end is not null").groupBy(F.col("session").alias("_s"), F.col("agent").alias("_a")).agg(F.max_by("t_end", "seq").alias("_end"))
    lags = trace.notifications.join(ended, (F.col("session") == F.col("_s")) & (F.col("agent_ref") == F.col("_a"))).where(F.col("ts") >= F.col("_end"))
    return dist_of(lags.select(((F.col("ts") - F.col("_end")) / 1000).alias("_lag")), "_lag")


def tokens(api_calls: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.col("usage")[k]), F.lit(0)).alias(f"tokens_{k}") for k in ("in", "out", "cache_read", "cache_create")]
    return api_calls.agg(*sums)


def cache_ratio() -> Column:
    """Cached share of a call's input tokens, null where it has none."""
    usage = lambda k: F.coalesce(F.col("usage")[k], F.lit(0))
    total = usage("in") + usage("cache_read") + usage("cache_create")
    return F.when(total > 0, usage("cache_read") / total)


def cache_read_ratio(api_calls: DataFrame) -> DataFrame:
    """Distribution of the cached share, each rounded to four digits first."""
    return dist_of(api_calls.select(F.round(cache_ratio(), 4).alias("_r")), "_r")


def turns(trace: Trace) -> DataFrame:
    """Distribution of a turn's seconds, and the share with background agents pending."""
    rows = trace.turns.withColumn("_s", F.col("duration_ms") / 1000)
    pending = F.count_if(F.coalesce("pending_background_agents", F.lit(0)) > 0)
    return dist_of(rows, "_s", F.round(share(pending, F.count("*")), 3).alias("pending_share"))
