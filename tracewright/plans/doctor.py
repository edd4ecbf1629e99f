"""What went wrong and what it cost, over one log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import rounded_rank, share
from tracewright.plans.characterize import cache_ratio, named
from tracewright.schema import Trace

#: End statuses that account for a run, tools whose names may be shared, and
#: one outside corpus's figures, given beside ours as a comparison and not as a norm, each
#: with how far it was confirmed elsewhere.
ACCOUNTED = ("completed", "failed")
SHAREABLE_TOOLS = (
    "Bash Read Edit Write Glob Grep NotebookEdit WebFetch WebSearch Agent Task TodoWrite ToolSearch SendMessage AskUserQuestion ExitPlanMode Skill".split()
)
REFERENCE = {
    "tool_share_of_busy_time": (0.79, "a second, independent corpus gave the same"),
    "cache_read_share_p50": (0.991, "a second, independent corpus gave the same"),
    "unaccounted_run_rate": (0.165, "seen on one machine, confirmed nowhere else"),
}
POINTS = (0.5, 0.95, 0.99)


def findings(trace: Trace) -> DataFrame:
    """One row of counters; one conditional aggregation over the three kinds it reads."""
    events = trace.events.where(F.col("ev").isin("session", "tool_call", "api_call"))
    is_ = lambda kind: F.col("ev") == kind
    agent = is_("session") & F.col("agent").isNotNull()
    call, api = is_("tool_call"), is_("api_call")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    sums = events.agg(
        F.count_if(is_("session") & F.col("agent").isNull()).alias("sessions"),
        F.count_if(agent).alias("agents"),
        F.count_if(agent & ~F.coalesce(F.col("end_status").isin(*ACCOUNTED), F.lit(False))).alias("unaccounted"),
        F.count_if(call & ~F.coalesce(F.col("status") == "matched", F.lit(False))).alias("never_returned"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & F.coalesce("is_error", F.lit(False))).alias("tool_errors"),
        total(call, F.col("duration_ms")).alias("tool_ms_total"),
        total(api, F.greatest(F.lit(0), F.when(F.col("ts").isNotNull() & F.col("ts_last").isNotNull(), F.col("ts_last") - F.col("ts")))).alias("model_ms_total"),
        F.coalesce(F.max(F.when(call, F.col("duration_ms"))), F.lit(0)).alias("slowest_call_ms"),
        *[total(api, F.col("usage")[k]).alias(f"tokens_{k}") for k in ("in", "out", "cache_read", "cache_create")],
    )
    rate = lambda a, b, name: share(F.col(a), F.col(b), 4).alias(name)
    return sums.select(
        "*",
        rate("unaccounted", "agents", "unaccounted_rate"),
        rate("tool_errors", "tool_calls", "tool_error_rate"),
        share(F.col("tool_ms_total"), F.col("tool_ms_total") + F.col("model_ms_total"), 4).alias("tool_share_of_busy_time"),
    )


def duration_ranks(calls: DataFrame) -> DataFrame:
    """p50, p95 and p99 of call durations at the half-even rank; one row, none over no calls."""
    return rounded_rank(calls, "duration_ms", POINTS)


def cache_share_rank(api_calls: DataFrame) -> DataFrame:
    return rounded_rank(api_calls.select(cache_ratio().alias("ratio")), "ratio", (0.5,))


def unaccounted_examples(trace: Trace, k: int = 5) -> DataFrame:
    """The ``k`` longest agent runs without a recorded outcome."""
    runs = trace.sessions.where(F.col("agent").isNotNull() & ~F.coalesce(F.col("end_status").isin(*ACCOUNTED), F.lit(False)))
    minutes = (F.col("t_end") - F.col("t_start")) / 60_000
    ordered = runs.withColumn("runtime_min", minutes).orderBy(F.coalesce("runtime_min", F.lit(0.0)).desc(), "seq").limit(k)
    return ordered.select("agent", "agent_type", F.col("end_status").alias("status"), "runtime_min", "background")


def time_by_tool(calls: DataFrame, k: int | None = None) -> DataFrame:
    """Milliseconds by tool, most first."""
    per = calls.where("duration_ms is not null").groupBy(named().alias("tool")).agg(F.sum("duration_ms").alias("ms"), F.min("seq").alias("_first")).orderBy(F.desc("ms"), "_first")
    return (per.limit(k) if k else per).drop("_first")


def time_by_shareable_tool(calls: DataFrame) -> DataFrame:
    """Milliseconds by tool, every name that is not on the list as ``other``."""
    tool = F.when(named().isin(*SHAREABLE_TOOLS), named()).otherwise("other")
    return calls.where("duration_ms is not null").groupBy(tool.alias("tool")).agg(F.sum("duration_ms").alias("ms"))


def long_tail(calls: DataFrame) -> DataFrame:
    """Share of calls and time at or above 10, 30 and 60 s, of all calls with a duration."""
    over = lambda t: F.col("duration_ms") >= t
    tiers = (10_000, 30_000, 60_000)
    sums = calls.where("duration_ms is not null").agg(
        F.count("*").alias("_n"), F.sum("duration_ms").alias("_ms"), F.array(*[F.struct(F.lit(t).alias("over_ms"), F.count_if(over(t)).alias("n"), F.sum(F.when(over(t), F.col("duration_ms"))).alias("ms")) for t in tiers]).alias("_t")
    )
    rows = sums.select("_n", "_ms", F.explode("_t").alias("t"))
    return rows.select("t.over_ms", share(F.col("t.n"), F.col("_n")).alias("call_share"), share(F.coalesce("t.ms", F.lit(0)), F.col("_ms")).alias("time_share"))
