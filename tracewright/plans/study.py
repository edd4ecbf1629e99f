"""Why runs fail: summary, errors, long tail, repeats, context size, and endings.

Each function is one plan over a trace's views and returns a table; :mod:`tracewright.report`
gathers them into a study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import nearest_rank, rate_columns, share, trend_test, two_proportion_z
from tracewright.operators.joins import asof_forward, with_context, within_after
from tracewright.operators.sequences import repeat_runs, unresolved, with_next_call, with_position
from tracewright.operators.topk import most_common, top_per_group
from tracewright.schema import Trace, sort_time, stream_window

#: Tools that wait on a person, and on another agent.
HUMAN_WAIT_TOOLS = ("AskUserQuestion", "ExitPlanMode")
AGENT_WAIT_TOOLS = ("Agent", "Monitor", "TaskStop", "SendMessage")
TIERS_MS = (10_000, 30_000, 60_000, 300_000, 600_000, 1_800_000)
LONG_MS = 60_000
BIN_TOKENS, MAX_BIN, MIN_BIN_CALLS = 25_000, 12, 200
AFTER_COMPACT_MS = 600_000
STUCK_RUN = 5
THIN_CALLS = 2


def errored() -> Column:
    return F.coalesce(F.col("is_error"), F.lit(False))


def counted_in_order(calls: DataFrame, groups: dict[str, Column], counts: Column | None = None, **also: Column) -> DataFrame:
    """groups, n and ``also`` (counts too), and ``first``, for breaking ties as a visit of all
    calls would: streams as first seen, then time, then log position.

    ``counts`` says which calls count; the others still tell where a stream is first seen.
    Calls are combined by stream and group before anything is ordered, so what moves is
    small and no window runs over calls.
    """
    counts = F.lit(True) if counts is None else counts
    per = calls.groupBy("session", "agent", *[c.alias(n) for n, c in groups.items()]).agg(
        F.min("seq").alias("_seq"), F.count_if(counts).alias("n"), F.min(F.when(counts, F.struct(sort_time(), F.col("seq")))).alias("_at"), *[F.count_if(counts & c).alias(n) for n, c in also.items()]
    )
    placed = per.withColumn("_seen", F.min("_seq").over(stream_window())).where("n > 0")
    return placed.groupBy(*groups).agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in also], F.min(F.struct("_seen", "_at")).alias("first"))


def commonest(counted: DataFrame, k: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), F.asc("first")).limit(k).drop("first")


def error_rate(calls: DataFrame) -> DataFrame:
    """One row: n errors of all calls with their interval."""
    return calls.agg(F.count_if(errored()).alias("n"), F.count("*").alias("of")).select("n", "of", *rate_columns("n", "of"))


def error_rate_by_tool(calls: DataFrame, k: int = 14) -> DataFrame:
    """The ``k`` most used tools with their error rates; a null name takes a place, then goes."""
    top = commonest(counted_in_order(calls, {"tool": F.col("name")}, errors=errored()), k)
    return top.where("tool is not null").select("tool", F.col("errors").alias("n"), F.col("n").alias("of")).select("tool", "n", "of", *rate_columns("n", "of"))


def after_error_tool_call(calls: DataFrame) -> DataFrame:
    """What the next call of the stream does after an error: label, n, of, rate."""
    errors = with_next_call(calls).where(errored())
    counted = errors.groupBy(F.col("after").alias("label")).agg(F.count("*").alias("n"))
    return _of_all(counted)


def after_error_model_response(calls: DataFrame, api_calls: DataFrame) -> DataFrame:
    """What the first model call at or after an error's result does: label, n, of, rate."""
    uses_tools = F.coalesce(F.col("blocks.tool_use"), F.lit(0)) > 0
    found = asof_forward(calls.where(errored()).select("session", "agent", "ts_result", "seq"), api_calls, ["session", "agent"], "ts_result", "ts", uses_tools, "acts")
    label = (
        F.when(F.col("ts_result").isNull(), "no_result_timestamp")
        .when(F.col("acts").isNull(), "no_further_model_call")
        .when(F.col("acts"), "kept_acting")
        .otherwise("text_only_response")
    )
    return _of_all(found.groupBy(label.alias("label")).agg(F.count("*").alias("n")))


def _of_all(counted: DataFrame) -> DataFrame:
    """Adds ``of``, the sum of all n: a window over as many rows as there are labels."""
    from pyspark.sql import Window

    return counted.withColumn("of", F.sum("n").over(Window.partitionBy())).select("label", "n", "of", *rate_columns("n", "of"))


def agent_calls(trace: Trace) -> DataFrame:
    """One row per agent stream, also those without calls: key, end_status, agent_type,
    n_calls, n_errors, has_unresolved, last_errored."""
    calls = with_position(trace.tool_calls.where("agent is not null"))
    flagged = calls.withColumn("_open", unresolved(calls))
    per = flagged.groupBy("session", "agent").agg(
        F.count("*").alias("n_calls"),
        F.count_if(errored()).alias("n_errors"),
        F.bool_or("_open").alias("has_unresolved"),
        F.bool_or(F.col("is_last") & errored()).alias("last_errored"),
    )
    streams = trace.streams.where("agent is not null").select("session", "agent", "stream_ord", "end_status", "agent_type")
    zeros = {"n_calls": 0, "n_errors": 0, "has_unresolved": False, "last_errored": False}
    return streams.join(per, ["session", "agent"], "left").fillna(zeros)


def unresolved_by_status(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """Agent runs with calls, by end status: streams, unresolved, final_errored."""
    return (
        (agents if agents is not None else agent_calls(trace))
        .where("n_calls > 0")
        .groupBy(F.coalesce("end_status", F.lit("unknown")).alias("end_status"))
        .agg(F.count("*").alias("of"), F.count_if("has_unresolved").alias("n"), F.count_if("last_errored").alias("final_errored"))
        .select("end_status", "n", "of", "final_errored", *rate_columns("n", "of"))
    )


def long_versus_short(calls: DataFrame, at_ms: int = LONG_MS) -> DataFrame:
    """Error rates of calls from ``at_ms`` up and below it, with z."""
    long = F.col("duration_ms") >= at_ms
    sums = calls.where("duration_ms is not null").agg(
        F.count_if(long & errored()).alias("long_n"), F.count_if(long).alias("long_of"), F.count_if(~long & errored()).alias("short_n"), F.count_if(~long).alias("short_of")
    )
    return sums.withColumn("z", two_proportion_z(*[F.col(c) for c in ("long_n", "long_of", "short_n", "short_of")]))


def call_class() -> Column:
    """errored, then waiting on a person, then on an agent, else heavy work."""
    return (
        F.when(errored(), "errored")
        .when(F.col("name").isin(*HUMAN_WAIT_TOOLS), "waiting_on_human")
        .when(F.col("name").isin(*AGENT_WAIT_TOOLS) | F.coalesce("background", F.lit(False)), "waiting_on_agent")
        .otherwise("heavy_work")
    )


def _tiers() -> Column:
    return F.filter(F.array(*[F.lit(t) for t in TIERS_MS]), lambda t: t <= F.col("duration_ms"))


def _by_tier(calls: DataFrame) -> DataFrame:
    return calls.where("duration_ms is not null").withColumn("tier_ms", F.explode(_tiers()))


def longtail_tiers(calls: DataFrame) -> DataFrame:
    """tier_ms, calls, their share of all timed calls and of all tool time; empty tiers are left out.

    One pass: conditional sums over the tiers, then one row becomes one per tier.
    """
    timed = calls.where("duration_ms is not null")
    sums = timed.agg(
        F.count("*").alias("of"),
        F.sum("duration_ms").alias("total_ms"),
        F.array(*[F.struct(F.lit(t).alias("tier_ms"), F.count_if(F.col("duration_ms") >= t).alias("n"), F.sum(F.when(F.col("duration_ms") >= t, F.col("duration_ms"))).alias("ms")) for t in TIERS_MS]).alias("tiers"),
    )
    rows = sums.select("of", "total_ms", F.explode("tiers").alias("t")).select("t.*", "of", "total_ms").where("n > 0")
    return rows.select("tier_ms", "n", "of", *rate_columns("n", "of"), F.round(100 * share(F.col("ms"), F.col("total_ms")), 2).alias("time_pct"))


def longtail_composition(calls: DataFrame) -> DataFrame:
    """tier_ms, class, calls and milliseconds, with the class's share of the tier's calls and time."""
    from pyspark.sql import Window

    per = _by_tier(calls).groupBy("tier_ms", call_class().alias("class")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    tier = Window.partitionBy("tier_ms")  # at most four classes
    per = per.withColumns({"of": F.sum("n").over(tier), "tier_total_ms": F.sum("ms").over(tier)})
    return per.select("tier_ms", "class", "n", "of", *rate_columns("n", "of"), "ms", F.round(100 * share(F.col("ms"), F.col("tier_total_ms")), 2).alias("time_pct"))


def longtail_by_tool(calls: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent tools of each tier."""
    tiered = calls.withColumn("tier_ms", F.explode_outer(_tiers()))  # a call below all tiers stays, uncounted
    counted = counted_in_order(tiered, {"tier_ms": F.col("tier_ms"), "tool": F.col("name")}, F.col("tier_ms").isNotNull())
    return top_per_group(counted, ["tier_ms"], [F.desc("n"), F.asc("first")], k).drop("first")


def duration_quantiles(calls: DataFrame) -> DataFrame:
    timed = calls.where("duration_ms is not null")
    return timed.agg(F.count("*").alias("timed_calls"), F.round(F.sum("duration_ms") / 3_600_000, 1).alias("total_hours"), *nearest_rank("duration_ms"), F.max("duration_ms").cast("double").alias("max"))


def extreme_calls(calls: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` longest calls, of equal ones those visited first.

    Only calls as long as the ``k``-th longest are placed among the streams.
    """
    timed = calls.where("duration_ms is not null")
    least = timed.orderBy(F.desc("duration_ms")).limit(k).agg(F.min("duration_ms").alias("_least"))
    seen = timed.groupBy(F.col("session").alias("_session"), F.col("agent").alias("_agent")).agg(F.min("seq").alias("_seen"))
    longest = timed.join(F.broadcast(least), F.col("duration_ms") >= F.col("_least"))  # one row
    placed = longest.join(seen, F.col("session").eqNullSafe(F.col("_session")) & F.col("agent").eqNullSafe(F.col("_agent")))
    ordered = placed.orderBy(F.desc("duration_ms"), F.asc("_seen"), sort_time(), "seq").limit(k)
    return ordered.select(F.col("name").alias("tool"), "duration_ms", F.round(F.col("duration_ms") / 60_000, 1).alias("minutes"), call_class().alias("class"), "is_error", "background", "result_chars", "seq")


def never_returned(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_if(F.col("status") == "unmatched").alias("n"), F.count("*").alias("of")).select("n", "of", *rate_columns("n", "of"))


def never_returned_by_tool(calls: DataFrame, k: int = 6) -> DataFrame:
    return commonest(counted_in_order(calls, {"tool": F.col("name")}, F.coalesce(F.col("status") == "unmatched", F.lit(False))), k)


def repeat_summary(calls: DataFrame, strict: bool = False, runs: DataFrame | None = None) -> DataFrame:
    """One row on runs of repeated calls: runs, calls_in_runs of all calls, streams with
    any and with a stuck run, errors_in_runs, and quantiles of length.

    Here and below, ``runs``, ``agents`` and ``joined`` are what :func:`repeat_runs`,
    :func:`agent_calls` and :func:`with_context` give, where a report has kept them.
    """
    runs = runs if runs is not None else repeat_runs(calls, strict)
    of_runs = runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("length"), F.lit(0)).alias("calls_in_runs"), F.coalesce(F.sum("errors_in_run"), F.lit(0)).alias("errors_in_runs"), *nearest_rank("length"), F.max("length").cast("double").alias("max"))
    per_stream = runs.groupBy("session", "agent").agg(F.max("length").alias("longest")).agg(F.count("*").alias("repeat_streams"), F.count_if(F.col("longest") >= STUCK_RUN).alias("stuck_streams"))
    totals = calls.groupBy("session", "agent").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_calls"), F.count("*").alias("streams"))
    return of_runs.crossJoin(per_stream).crossJoin(totals)  # one row each


def repeat_lengths(calls: DataFrame, strict: bool = False, k: int = 12, runs: DataFrame | None = None) -> DataFrame:
    """How many runs have each of the ``k`` smallest lengths."""
    return (runs if runs is not None else repeat_runs(calls, strict)).groupBy("length").agg(F.count("*").alias("runs")).orderBy("length").limit(k)


def repeat_by_tool(calls: DataFrame, strict: bool = False, k: int = 8, runs: DataFrame | None = None) -> DataFrame:
    return most_common(runs if runs is not None else repeat_runs(calls, strict), "tool", k, "first_seq", name="tool")


def longest_runs(calls: DataFrame, strict: bool = False, k: int = 5, runs: DataFrame | None = None) -> DataFrame:
    return (runs if runs is not None else repeat_runs(calls, strict)).orderBy(F.desc("length"), F.asc("first_seq")).limit(k)


def stuck_and_ending(trace: Trace, agents: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Agent runs with calls, with and without a stuck run: how many ended badly."""
    agents = (agents if agents is not None else agent_calls(trace)).where("n_calls > 0")
    stuck = (runs if runs is not None else repeat_runs(trace.tool_calls)).where(F.col("agent").isNotNull() & (F.col("length") >= STUCK_RUN)).select("session", "agent").distinct().withColumn("stuck", F.lit(True))
    bad = F.coalesce(F.col("end_status").isin("failed", "killed"), F.lit(False))
    flagged = agents.join(stuck, ["session", "agent"], "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))
    return flagged.groupBy("stuck").agg(F.count_if(bad).alias("n"), F.count("*").alias("of")).select("stuck", "n", "of", *rate_columns("n", "of"))


def context_bin() -> Column:
    return F.least(F.floor(F.col("context_tokens") / BIN_TOKENS), F.lit(MAX_BIN)).cast("int")


def bin_label(index: Column) -> Column:
    low = index * (BIN_TOKENS // 1000)
    return F.when(index == MAX_BIN, F.format_string("%03dk+", low)).otherwise(F.format_string("%03d-%03dk", low, low + BIN_TOKENS // 1000))


def context_error_rate(calls: DataFrame, api_calls: DataFrame, mode: str = "strict", joined: DataFrame | None = None) -> DataFrame:
    """Error rate by the size of the context that the calling model held."""
    joined = (joined if joined is not None else with_context(calls, api_calls, mode)).where("context_tokens is not null")
    binned = joined.groupBy(context_bin().alias("bin")).agg(F.count_if(errored()).alias("n"), F.count("*").alias("of"))
    return binned.select("bin", bin_label(F.col("bin")).alias("label"), "n", "of", *rate_columns("n", "of"))


def context_join_counts(calls: DataFrame, api_calls: DataFrame, mode: str = "strict", joined: DataFrame | None = None) -> DataFrame:
    return (joined if joined is not None else with_context(calls, api_calls, mode)).agg(F.count("context_tokens").alias("joined"), F.count_if(F.col("context_tokens").isNull()).alias("unjoinable"))


def context_trend(calls: DataFrame, api_calls: DataFrame, mode: str = "strict", min_calls: int = MIN_BIN_CALLS, joined: DataFrame | None = None) -> DataFrame:
    bins = context_error_rate(calls, api_calls, mode, joined).where(F.col("of") >= min_calls).withColumn("score", F.col("bin").cast("double"))
    return trend_test(bins, [])


def context_trend_by_tool(calls: DataFrame, api_calls: DataFrame, k: int = 3, mode: str = "strict", min_calls: int = MIN_BIN_CALLS, joined: DataFrame | None = None) -> DataFrame:
    """The trend within each of the ``k`` busiest tools, free of shifts in the mix of tools."""
    busy = commonest(counted_in_order(calls, {"tool": F.col("name")}, F.coalesce(F.col("name") != "", F.lit(False))), k).select("tool")
    joined = (joined if joined is not None else with_context(calls, api_calls, mode)).where("context_tokens is not null").join(F.broadcast(busy), F.col("name") == F.col("tool"))  # k rows
    bins = joined.groupBy("tool", context_bin().alias("bin")).agg(F.count_if(errored()).alias("n"), F.count("*").alias("of"))
    return trend_test(bins.where(F.col("of") >= min_calls).withColumn("score", F.col("bin").cast("double")), ["tool"])


def context_composition(calls: DataFrame, api_calls: DataFrame, k: int = 4, mode: str = "strict", min_calls: int = MIN_BIN_CALLS, joined: DataFrame | None = None) -> DataFrame:
    """The ``k`` tools that make up most of each bin, with their share of it."""
    from pyspark.sql import Window

    groups = {"bin": context_bin(), "tool": F.coalesce(F.nullif("name", F.lit("")), F.lit("?"))}
    per = counted_in_order(joined if joined is not None else with_context(calls, api_calls, mode), groups, F.col("context_tokens").isNotNull())
    per = per.withColumn("of", F.sum("n").over(Window.partitionBy("bin"))).where(F.col("of") >= min_calls)
    top = top_per_group(per, ["bin"], [F.desc("n"), F.asc("first")], k)
    return top.select("bin", "tool", "n", "of", F.round(100 * F.col("n") / F.col("of"), 1).alias("pct"))


def compaction_window(calls: DataFrame, compacts: DataFrame) -> DataFrame:
    """Error rate of calls within ten minutes after a compaction of their stream, beside all
    calls', with z; and the compactions themselves."""
    near = within_after(calls, compacts, ["session", "agent"], "ts", AFTER_COMPACT_MS)
    sums = near.agg(F.count_if(F.col("near") & errored()).alias("near_n"), F.count_if("near").alias("near_of"), F.count_if(errored()).alias("all_n"), F.count("*").alias("all_of"))
    events = compacts.groupBy("session", "agent").agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("compactions"), F.count("*").alias("streams"))
    return sums.crossJoin(events).withColumn("z", two_proportion_z(*[F.col(c) for c in ("near_n", "near_of", "all_n", "all_of")]))


def compaction_triggers(compacts: DataFrame) -> DataFrame:
    return compacts.groupBy(F.coalesce(F.nullif("trigger", F.lit("")), F.lit("unknown")).alias("trigger")).agg(F.count("*").alias("n"))


def end_status_rates(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """Agent runs by end status, null counted as unknown."""
    streams = agents if agents is not None else trace.streams.where("agent is not null")
    counted = streams.groupBy(F.coalesce(F.nullif("end_status", F.lit("")), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    return _of_all(counted).withColumnRenamed("label", "end_status")


def hard_failures_by_type(trace: Trace, k: int = 6, agents: DataFrame | None = None) -> DataFrame:
    streams = agents if agents is not None else trace.streams.where("agent is not null")
    return most_common(streams.where("end_status in ('failed', 'killed')"), "agent_type", k, "stream_ord", name="agent_type")


def recovery(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """Runs with and without a tool error: how many completed, of all and of those whose
    outcome is known (a null status counts as known here, ``unknown`` doesn't)."""
    runs = (agents if agents is not None else agent_calls(trace)).where("n_calls > 0").withColumn("had_error", F.col("n_errors") > 0)
    done, unknown = F.col("end_status") == "completed", F.col("end_status").eqNullSafe("unknown")
    return runs.groupBy("had_error").agg(F.count_if(done).alias("n"), F.count("*").alias("of"), F.count_if(~unknown).alias("known"), F.count_if(unknown).alias("unknown")).select("had_error", "n", "of", "known", "unknown", *rate_columns("n", "of"))


def recovery_test(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """z of completion with errors against without, over all runs and over known outcomes."""
    wide = recovery(trace, agents).agg(*[F.coalesce(F.max(F.when(F.col("had_error") == flag, F.col(c))), F.lit(0)).alias(f"{side}_{c}") for side, flag in (("error", True), ("clean", False)) for c in ("n", "of", "known")])
    z = lambda of: two_proportion_z(F.col("error_n"), F.col(f"error_{of}"), F.col("clean_n"), F.col(f"clean_{of}"))
    return wide.withColumns({"z": z("of"), "z_known": z("known")})


def thin_evidence(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """Completed runs by number of calls; runs without calls count."""
    n = F.col("n_calls")
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").when(n < 10, "3-9").otherwise("10+")
    done = (agents if agents is not None else agent_calls(trace)).where("end_status = 'completed'")
    return done.groupBy(bucket.alias("calls")).agg(F.count("*").alias("runs"), F.count_if(n <= THIN_CALLS).alias("thin"))


def run_length(trace: Trace, agents: DataFrame | None = None) -> DataFrame:
    """Quantiles of calls per agent run, runs without calls included."""
    return (agents if agents is not None else agent_calls(trace)).agg(F.count("*").alias("runs"), *nearest_rank("n_calls"), F.max("n_calls").cast("double").alias("max"))


def summary(trace: Trace) -> DataFrame:
    """One row on what the log holds."""
    streams = trace.streams
    over_streams = streams.agg(
        F.count("*").alias("streams"),
        F.count_if(F.col("agent").isNull()).alias("main_sessions"),
        F.count("agent").alias("agent_runs"),
        F.count_distinct("project").alias("distinct_projects"),
        F.round((F.max(F.nullif("t_end", F.lit(0))) - F.min(F.nullif("t_start", F.lit(0)))) / 86_400_000, 1).alias("span_days"),
    )
    events = trace.events
    count = lambda kind: F.count_if(F.col("ev") == kind)
    over_events = events.where(F.col("ev").isin("tool_call", "api_call", "prompt", "turn", "compact")).agg(
        count("tool_call").alias("tool_calls"),
        F.count_distinct(F.when(F.col("ev") == "api_call", F.col("uuid"))).alias("api_calls"),
        count("prompt").alias("prompts"),
        count("turn").alias("turns"),
        count("compact").alias("compactions"),
        F.count_distinct(F.when(F.col("ev") == "tool_call", F.nullif("name", F.lit("")))).alias("distinct_tools"),
    )
    return over_streams.crossJoin(over_events)  # one row each


def top_models(trace: Trace, k: int = 6) -> DataFrame:
    calls = trace.api_calls.where("model is not null and model != ''").withColumn("ts_result", F.lit(None).cast("long"))
    return commonest(counted_in_order(calls, {"model": F.col("model")}), k)
