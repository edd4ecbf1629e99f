"""Reports: aggregated tables gathered into dictionaries, and rendered as text.

Only tables whose size is fixed by the report (one row, or one per tool, status, tier or
bin) reach the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracewright.functions.stats import Z95
from tracewright.plans import characterize, doctor, overtime, study
from tracewright.schema import Trace

DIST = ("n", "mean", "p50", "p90", "p95", "p99", "max")


def _row(df: DataFrame) -> dict:
    return df.first().asDict(True)


def _gather(**tables: DataFrame) -> dict[str, list]:
    """All rows of small tables, by name; their jobs run side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return dict(zip(tables, pool.map(lambda t: t.collect(), tables.values()), strict=True))


def _dist(row: dict) -> dict:
    return {k: row[k] for k in DIST}


def _map(df: DataFrame, key: str, value: str = "n") -> dict:
    return {r[key]: r[value] for r in df.collect()}


def _rate(n: int, of: int, z: float = Z95) -> dict:
    """A share with its Wilson interval, from counts already gathered."""
    if not 0 <= n <= of:
        raise ValueError("need 0 <= numerator <= denominator")
    if of == 0:
        return {"n": 0, "of": 0, "pct": 0.0, "ci95_pct": [0.0, 0.0]}
    p, zz = n / of, z * z
    centre, spread = p + zz / (2 * of), z * math.sqrt((p * (1 - p) + zz / (4 * of)) / of)
    low, high = max(0.0, (centre - spread) / (1 + zz / of)), min(1.0, (centre + spread) / (1 + zz / of))
    return {"n": n, "of": of, "pct": round(100 * p, 3), "ci95_pct": [round(100 * low, 3), round(100 * high, 3)]}


def _test(z: float, a: tuple[int, int], b: tuple[int, int]) -> dict:
    share = lambda x: x[0] / x[1] if x[1] else 0.0
    none = not a[1] or not b[1]
    return {"z": z, "p": math.erfc(abs(z) / math.sqrt(2)), "a": 0.0 if none else share(a), "b": 0.0 if none else share(b)}


def _trend(row: dict) -> dict:
    return {"z": row["z"], "p": math.erfc(abs(row["z"]) / math.sqrt(2))} | ({"note": row["note"]} if row["note"] else {})


def _quantiles(row: dict) -> dict:
    return {} if row["max"] is None else {k: row[k] for k in ("p50", "p90", "p95", "p99", "max")}


def characterization(trace: Trace, manifest: dict | None = None) -> dict:
    """Corpus, arrivals, tool latency, structure and context of a log."""
    manifest = manifest or {}
    corpus, prompts = _row(characterize.corpus(trace)), _row(characterize.prompts_per_session(trace.prompts))
    calls, api = trace.tool_calls, trace.api_calls
    counts, durations, busy = _row(characterize.tool_counts(calls)), _row(characterize.tool_durations(calls)), _row(characterize.busy_share(trace))
    fan, agents, runtime = _row(characterize.fan_out(api)), _row(characterize.agents_per_session(trace)), _row(characterize.agent_runtime(trace))
    turns, tokens = _row(characterize.turns(trace)), _row(characterize.tokens(api))
    return {
        "corpus": {
            **{k: corpus[k] for k in ("sessions", "agents", "span_days", "session_hours_total")},
            "session_wall_minutes": _dist(corpus),
            "models": _map(characterize.models(trace), "model"),
            "harness_versions": len(manifest.get("versions_seen") or []),
            "source_lines": sum((manifest.get("lines_by_type") or {}).values()),
        },
        "arrivals": {
            "prompts": prompts["prompts"],
            "prompts_per_session": _dist(prompts),
            "inter_arrival_s": _dist(_row(characterize.inter_arrival(trace.prompts))),
            "queue_ops": _map(characterize.queue_ops(trace), "op"),
            "queue_delivered_share": _row(characterize.queue_delivered(trace))["share"],
        },
        "tool_latency": {
            **{k: counts[k] for k in ("calls_matched", "calls_unmatched", "calls_orphan")},
            "duration_ms": _dist(durations),
            "total_hours": durations["total_hours"],
            "error_rate": counts["error_rate"],
            "background_share": counts["background_share"],
            "by_tool": {r["tool"]: {k: r[k] for k in ("n", "p50_ms", "p95_ms", "time_share")} for r in characterize.by_tool(calls).collect()},
            "long_calls": {f"over_{r['over_ms'] // 1000}s": {"call_share": r["call_share"], "time_share": r["time_share"]} for r in characterize.long_calls(calls).collect()},
            "model_hours_total": busy["model_hours"],
            "tool_share_of_busy_time": busy["tool_share"],
        },
        "structure": {
            "api_calls": fan["api_calls"],
            "api_calls_with_tools_share": fan["with_tools_share"],
            "parallel_fanout_share": fan["parallel_share"],
            "fanout_max": fan["fanout_max"],
            "sessions_with_agents": agents["n"],
            "agents_per_spawning_session": _dist(agents),
            "spawn_depth": {str(k): n for k, n in sorted(_map(characterize.spawn_depths(trace), "spawn_depth").items())},
            "agent_end_status": _map(characterize.agent_end_status(trace), "end_status"),
            "background_agent_share": runtime["background_share"],
            "agent_runtime_minutes": _dist(runtime),
            "tool_parallel_overlap_share": _row(characterize.parallel_overlap(calls))["share"],
            "notification_lag_s": _dist(_row(characterize.notification_lag(trace))),
        },
        "context": {
            "tokens_total": {k.removeprefix("tokens_"): v for k, v in tokens.items()},
            "cache_read_ratio": _dist(_row(characterize.cache_read_ratio(api))),
            "turns": turns["n"],
            "turn_duration_s": _dist(turns),
            "turns_with_pending_background_share": turns["pending_share"],
            "compactions": trace.compacts.count(),
        },
    }


def findings(trace: Trace) -> dict:
    """What went wrong and what it cost, as named fields."""
    row = _row(doctor.findings(trace))
    ranks = doctor.duration_ranks(trace.tool_calls).first()
    cache = doctor.cache_share_rank(trace.api_calls).first()
    tokens = {k: row.pop(f"tokens_{k}") for k in ("in", "out", "cache_read", "cache_create")}
    errors = row.pop("tool_errors")
    return row | {
        "tool_errors": errors,
        **{f"duration_p{p}_ms": (ranks[f"p{p}"] or 0) if ranks else 0 for p in (50, 95, 99)},
        "cache_read_share_p50": round(cache["p50"] or 0.0, 4) if cache else 0.0,
        "tokens": tokens,
        "by_tool_ms": _map(doctor.time_by_tool(trace.tool_calls), "tool", "ms"),
    }


SHARED = (
    "sessions agents unaccounted unaccounted_rate never_returned tool_calls tool_error_rate tool_share_of_busy_time tool_ms_total model_ms_total "
    "slowest_call_ms duration_p50_ms duration_p95_ms duration_p99_ms cache_read_share_p50 tokens"
).split()


def shareable(trace: Trace, manifest: dict | None = None) -> dict:
    """The aggregate that may be shared: the fields named here and no others.

    It is built by naming what goes in, so a new field of the log can't travel by default.
    """
    found = findings(trace)
    by_tool = _map(doctor.time_by_shareable_tool(trace.tool_calls), "tool", "ms")
    out = {"aggregate_version": 1, **{k: found[k] for k in SHARED}, "tool_ms_by_builtin": dict(sorted(by_tool.items()))}
    return out | {k: manifest[k] for k in ("corpus_id", "schema_version", "tool_version") if manifest and k in manifest}


@dataclass(frozen=True)
class Kept:
    """What several analyses read, computed once and kept while a report is made: runs of
    repeated calls (by strictness), agent runs with their counts, and calls with the size
    of their context."""

    runs: dict[bool, DataFrame]
    agents: DataFrame
    joined: DataFrame

    @staticmethod
    def of(trace: Trace, mode: str = "strict") -> Kept:
        calls = trace.tool_calls
        joined = study.with_context(calls, trace.api_calls, mode).select("session", "agent", "ts", "ts_result", "seq", "name", "is_error", "context_tokens")
        return Kept({strict: study.repeat_runs(calls, strict).persist() for strict in (False, True)}, study.agent_calls(trace).persist(), joined.persist())

    def release(self) -> None:
        for table in (*self.runs.values(), self.agents, self.joined):
            table.unpersist()


def study_errors(trace: Trace, kept: Kept) -> dict:
    calls = trace.tool_calls
    got = _gather(
        overall=study.error_rate(calls),
        by_tool=study.error_rate_by_tool(calls),
        next_call=study.after_error_tool_call(calls),
        response=study.after_error_model_response(calls, trace.api_calls),
        status=study.unresolved_by_status(trace, kept.agents),
        long=study.long_versus_short(calls),
    )
    overall, long = got["overall"][0], got["long"][0]
    rates = lambda rows: {r["label"]: _rate(r["n"], r["of"]) for r in sorted(rows, key=lambda r: -r["n"])}
    status = {r["end_status"]: r for r in got["status"]}
    done = status["completed"].asDict() if "completed" in status else {"n": 0, "of": 0, "final_errored": 0}
    return {
        "overall_error_rate": _rate(overall["n"], overall["of"]),
        "error_rate_by_tool": {r["tool"]: _rate(r["n"], r["of"]) for r in got["by_tool"]},
        "after_error_next_tool_call": rates(got["next_call"]),
        "after_error_model_response": rates(got["response"]),
        "declared_complete_with_unresolved_error": {
            "rate": _rate(done["n"], done["of"]),
            "final_call_errored_rate": _rate(done["final_errored"], done["of"]),
            "by_end_status": {s: _rate(r["n"], r["of"]) for s, r in status.items()},
        },
        "error_rate_long_vs_short": {
            "ge_60s": _rate(long["long_n"], long["long_of"]),
            "lt_60s": _rate(long["short_n"], long["short_of"]),
            "test": _test(long["z"], (long["long_n"], long["long_of"]), (long["short_n"], long["short_of"])),
        },
    }


def study_longtail(trace: Trace, kept: Kept) -> dict:
    calls = trace.tool_calls
    got = _gather(
        totals=study.duration_quantiles(calls),
        never=study.never_returned(calls),
        tiers=study.longtail_tiers(calls),
        parts=study.longtail_composition(calls),
        by_tool=study.longtail_by_tool(calls),
        extremes=study.extreme_calls(calls),
        never_by_tool=study.never_returned_by_tool(calls),
    )
    totals, never = got["totals"][0].asDict(), got["never"][0]
    tiers = {r["tier_ms"]: {"calls": r["n"], "share_of_calls": _rate(r["n"], r["of"]), "share_of_tool_time_pct": r["time_pct"], "composition_by_calls": {}, "composition_by_time_pct": {}, "by_tool": []} for r in got["tiers"]}
    for r in sorted(got["parts"], key=lambda r: -r["n"]):
        tiers[r["tier_ms"]]["composition_by_calls"][r["class"]] = _rate(r["n"], r["of"])
    for r in sorted(got["parts"], key=lambda r: -r["ms"]):
        tiers[r["tier_ms"]]["composition_by_time_pct"][r["class"]] = r["time_pct"]
    for r in sorted(got["by_tool"], key=lambda r: -r["n"]):
        tiers[r["tier_ms"]]["by_tool"].append([r["tool"], r["n"]])
    return {
        "timed_calls": totals["timed_calls"],
        "total_tool_hours": totals["total_hours"] or 0.0,
        "duration_quantiles_ms": _quantiles(totals),
        "tiers": {f"ge_{t // 1000}s": v for t, v in sorted(tiers.items())},
        "extremes": [{k: r[k] for k in ("tool", "minutes", "class", "is_error", "background", "result_chars")} for r in got["extremes"]],
        "never_returned": {"count": never["n"], "rate": _rate(never["n"], never["of"]), "by_tool": [[r["tool"], r["n"]] for r in got["never_by_tool"]]},
    }


def study_looping(trace: Trace, kept: Kept) -> dict:
    calls, sides = trace.tool_calls, (("upper_bound", False), ("lower_bound", True))
    tables = {"ends": study.stuck_and_ending(trace, kept.agents, kept.runs[False])}
    for label, strict in sides:
        runs = kept.runs[strict]
        tables |= {
            f"{label} summary": study.repeat_summary(calls, strict, runs),
            f"{label} lengths": study.repeat_lengths(calls, strict, runs=runs),
            f"{label} longest": study.longest_runs(calls, strict, runs=runs),
            f"{label} by tool": study.repeat_by_tool(calls, strict, runs=runs),
        }
    got, out = _gather(**tables), {}
    for label, _ in sides:
        r = got[f"{label} summary"][0].asDict()
        out |= {"total_tool_calls": r["total_calls"], "streams_with_tool_calls": r["streams"], "stuck_run_threshold": study.STUCK_RUN}
        out[label] = {
            "runs": r["runs"],
            "share_of_calls_inside_a_repeat_run": _rate(r["calls_in_runs"], r["total_calls"]),
            "share_of_streams_with_any_repeat": _rate(r["repeat_streams"], r["streams"]),
            "share_of_streams_with_a_stuck_run": _rate(r["stuck_streams"], r["streams"]),
            "run_length_distribution": {x["length"]: x["runs"] for x in got[f"{label} lengths"]},
            "run_length_quantiles": _quantiles(r),
            "longest_runs": [{k: x[k] for k in ("length", "tool", "args_shape", "start_ts", "errors_in_run")} for x in got[f"{label} longest"]],
            "runs_by_tool": [[x["tool"], x["n"]] for x in got[f"{label} by tool"]],
            "errors_inside_runs": r["errors_in_runs"],
        }
    ends = {r["stuck"]: (r["n"], r["of"]) for r in got["ends"]}
    stuck, free = ends.get(True, (0, 0)), ends.get(False, (0, 0))
    out["stuck_run_vs_bad_ending"] = {"agent_streams_scored": stuck[1] + free[1], "with_stuck_run": _rate(*stuck), "without_stuck_run": _rate(*free)}
    return out


def study_context(trace: Trace, kept: Kept) -> dict:
    calls, api, joined = trace.tool_calls, trace.api_calls, kept.joined
    got = _gather(
        counts=study.context_join_counts(calls, api, joined=joined),
        bins=study.context_error_rate(calls, api, joined=joined),
        trend=study.context_trend(calls, api, joined=joined),
        window=study.compaction_window(calls, trace.compacts),
        composition=study.context_composition(calls, api, joined=joined),
        by_tool=study.context_trend_by_tool(calls, api, joined=joined),
        triggers=study.compaction_triggers(trace.compacts),
    )
    trend, window = got["trend"][0].asDict(), got["window"][0]
    composition: dict = {}
    for r in sorted(got["composition"], key=lambda r: (r["bin"], -r["n"])):
        composition.setdefault(f"{r['bin'] * study.BIN_TOKENS // 1000:03d}k", {})[r["tool"]] = r["pct"]
    return {
        "calls_joined_to_context_size": got["counts"][0]["joined"],
        "calls_unjoinable": got["counts"][0]["unjoinable"],
        "error_rate_by_context_bin": {r["label"]: _rate(r["n"], r["of"]) for r in sorted(got["bins"], key=lambda r: r["bin"])},
        "bins_used_in_trend_test": trend["bins_used"],
        "min_calls_per_bin_for_trend": study.MIN_BIN_CALLS,
        "trend_test": _trend(trend | ({"note": "too few bins"} if trend["bins_used"] < 3 else {})),
        "trend_test_stratified_by_tool": {r["tool"]: {"bins_used": r["bins_used"], "trend_test": _trend(r.asDict())} for r in got["by_tool"]},
        "tool_composition_by_context_bin_pct": composition,
        "compaction": {
            "events": window["compactions"],
            "streams_with_any_compaction": window["streams"],
            "by_trigger": {r["trigger"]: r["n"] for r in got["triggers"]},
            "post_compaction_window_minutes": study.AFTER_COMPACT_MS // 60_000,
            "error_rate_after_compaction": _rate(window["near_n"], window["near_of"]),
            "baseline_error_rate": _rate(window["all_n"], window["all_of"]),
            "test": _test(window["z"], (window["near_n"], window["near_of"]), (window["all_n"], window["all_of"])),
        },
    }


def study_termination(trace: Trace, kept: Kept) -> dict:
    agents = kept.agents
    got = _gather(
        statuses=study.end_status_rates(trace, agents),
        groups=study.recovery(trace, agents),
        test=study.recovery_test(trace, agents),
        thin=study.thin_evidence(trace, agents),
        hard=study.hard_failures_by_type(trace, agents=agents),
        length=study.run_length(trace, agents),
    )
    statuses = {r["end_status"]: (r["n"], r["of"]) for r in sorted(got["statuses"], key=lambda r: -r["n"])}
    total = next(iter(statuses.values()))[1] if statuses else 0
    groups = {r["had_error"]: r for r in got["groups"]}
    none = {"n": 0, "of": 0, "known": 0, "unknown": 0}
    error, clean = (groups[k].asDict() if k in groups else none for k in (True, False))
    test, thin = got["test"][0], got["thin"]
    bad = statuses.get("failed", (0, 0))[0] + statuses.get("killed", (0, 0))[0]
    return {
        "agent_runs": total,
        "end_status_counts": {s: n for s, (n, _) in statuses.items()},
        "end_status_rates": {s: _rate(n, of) for s, (n, of) in statuses.items()},
        "recovery": {
            "runs_containing_at_least_one_tool_error": error["of"],
            "error_runs_completed_rate": _rate(error["n"], error["of"]),
            "runs_with_no_tool_error": clean["of"],
            "clean_runs_completed_rate": _rate(clean["n"], clean["of"]),
            "test": _test(test["z"], (error["n"], error["of"]), (clean["n"], clean["of"])),
            "known_status_only": {"error_runs": _rate(error["n"], error["known"]), "clean_runs": _rate(clean["n"], clean["known"]), "test": _test(test["z_known"], (error["n"], error["known"]), (clean["n"], clean["known"]))},
            "unknown_status_share": {"error_runs": _rate(error["unknown"], error["of"]), "clean_runs": _rate(clean["unknown"], clean["of"])},
        },
        "hard_failures": {"failed_or_killed": _rate(bad, total), "by_agent_type": [[r["agent_type"], r["n"]] for r in got["hard"]]},
        "thin_evidence": {"rate": _rate(sum(r["thin"] for r in thin), sum(r["runs"] for r in thin)), "completed_runs_by_tool_call_count": {r["calls"]: r["runs"] for r in thin}},
        "run_length": {"tool_calls_per_agent_run": _quantiles(got["length"][0].asDict())},
    }


def study_summary(trace: Trace, kept: Kept) -> dict:
    got = _gather(summary=study.summary(trace), models=study.top_models(trace))
    return got["summary"][0].asDict(True) | {"top_models": [[r["model"], r["n"]] for r in got["models"]]}


ANALYSES = {"summary": study_summary, "looping": study_looping, "errors": study_errors, "longtail": study_longtail, "context": study_context, "termination": study_termination}


def study_report(trace: Trace, only: tuple[str, ...] | None = None) -> dict:
    """The named analyses, all by default."""
    unknown = set(only or ()) - ANALYSES.keys()
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(sorted(unknown))}; known: {', '.join(ANALYSES)}")
    chosen = {name: run for name, run in ANALYSES.items() if only is None or name in only}
    kept = Kept.of(trace)
    try:
        with ThreadPoolExecutor(len(chosen)) as pool:  # their jobs are small and share the executors
            found = {name: pool.submit(run, trace, kept) for name, run in chosen.items()}
            return {name: f.result() for name, f in found.items()}
    finally:
        kept.release()


def snapshot(trace: Trace, label: str, generated_at: str | None = None) -> dict:
    types = {r["agent_type"]: {k: r[k] for k in r.asDict() if k != "agent_type"} for r in overtime.by_agent_type(trace).collect()}
    return {"label": label, "generated_at": generated_at, **_row(overtime.snapshot(trace)), "by_agent_type": types}


def drift(before: dict, after: dict, at: str = "") -> list[str]:
    """Where two reports differ, as paths."""
    if isinstance(before, dict) and isinstance(after, dict):
        return [d for k in sorted({*before, *after}, key=str) for d in drift(before.get(k), after.get(k), f"{at}/{k}")]
    return [] if before == after else [f"{at}: {before!r} -> {after!r}"]


# Text


def fmt_ms(ms: float) -> str:
    return f"{ms:.0f} ms" if ms < 1000 else f"{ms / 1000:.1f} s" if ms < 60_000 else f"{ms / 60_000:.1f} min"


def pct(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def compared(name: str) -> str:
    """An outside corpus's figure with how far it holds; a comparison, not a norm."""
    value, note = doctor.REFERENCE[name]
    return f"one outside corpus had {pct(value)} ({note})"


def render_findings(trace: Trace) -> str:
    f = findings(trace)
    out = [f"# {f['sessions']} sessions, {f['agents']} agent runs", "", "## Runs without a recorded outcome", ""]
    out += [f"{f['unaccounted']} of {f['agents']} ({pct(f['unaccounted_rate'])}); {compared('unaccounted_run_rate')}.", ""]
    for e in doctor.unaccounted_examples(trace).collect():
        ran = f"{e['runtime_min']:.0f} min" if e["runtime_min"] else "an unknown time"
        out.append(f"- {e['agent_type'] or 'agent'} ran {ran}" + ", in the background" * bool(e["background"]))
    out += ["", "## Calls that never returned", "", f"{f['never_returned']} of {f['tool_calls']}; error rate {pct(f['tool_error_rate'])}.", "", "## Where the time went", ""]
    out += [f"Tools took {pct(f['tool_share_of_busy_time'])} of busy time ({fmt_ms(f['tool_ms_total'])}; models {fmt_ms(f['model_ms_total'])}); {compared('tool_share_of_busy_time')}.", "", "| at least | calls | tool time |", "|---|---|---|"]
    out += [f"| {r['over_ms'] // 1000} s | {pct(r['call_share'])} | {pct(r['time_share'])} |" for r in doctor.long_tail(trace.tool_calls).collect()] if f["tool_ms_total"] else []
    out += ["", f"Slowest {fmt_ms(f['slowest_call_ms'])}, p50 {fmt_ms(f['duration_p50_ms'])}, p95 {fmt_ms(f['duration_p95_ms'])}.", ""]
    out += [f"- {tool}: {fmt_ms(ms)} ({pct(ms / f['tool_ms_total'] if f['tool_ms_total'] else 0)})" for tool, ms in list(f["by_tool_ms"].items())[:5]]
    t = f["tokens"]
    out += ["", "## What it cost", "", f"cache-read {t['cache_read']:,}, cache-write {t['cache_create']:,}, output {t['out']:,}, raw input {t['in']:,}; the median call reads {pct(f['cache_read_share_p50'])} of its input from cache; {compared('cache_read_share_p50')}."]
    return "\n".join(out) + "\n"


def render_tree(title: str, tree: dict, depth: int = 1) -> str:
    """A report as Markdown: a heading for each level, a line for each value."""
    out = [f"{'#' * min(depth, 6)} {title}", ""]
    flat = {k: v for k, v in tree.items() if not isinstance(v, dict) or {"n", "of", "pct"} <= v.keys() or set(DIST) <= v.keys()}
    for k, v in flat.items():
        if isinstance(v, dict) and "pct" in v:
            v = f"{v['pct']:.2f}% [{v['ci95_pct'][0]:.2f}, {v['ci95_pct'][1]:.2f}] ({v['n']}/{v['of']})"
        elif isinstance(v, dict):
            v = ", ".join(f"{a} {b:g}" for a, b in v.items())
        out.append(f"- {k}: {v}")
    text = "\n".join(out) + "\n\n"
    return text + "".join(render_tree(str(k), v, depth + 1) for k, v in tree.items() if k not in flat)


def render_gate(rows: list[dict]) -> str:
    bad = [r for r in rows if r["regressed"]]
    out = [f"# {len(bad)} regression(s)" if bad else "# No regressions", ""]
    out += [f"- {r['metric']} ({r['rule']}): {r['base']:.4g} -> {r['current']:.4g}" + (f", z = {r['z']:.2f}, p = {r['p']:.2g}; 95%: {r['base_lo_pct']:.2f} to {r['base_hi_pct']:.2f}%, then {r['current_lo_pct']:.2f} to {r['current_hi_pct']:.2f}%" if r["z"] is not None else "") for r in bad]
    out += [f"- skipped {r['metric']}: nothing to compare" for r in rows if r["skipped"]]
    out += [f"- reported only, {r['metric']}: {r['base']:.4g} -> {r['current']:.4g}" for r in rows if not r["gated"]]
    return "\n".join(out) + "\n"


def render_timeline(snapshots: list[dict], moved: list[dict]) -> str:
    """Snapshots side by side in order of time, what moved from first to last, and the last
    one's agent types, those with most runs without an outcome first."""
    last = snapshots[-1]
    show = lambda value, unit: "n/a" if value is None else pct(value) if unit == "rate" else fmt_ms(value)
    out = ["# Over time", ""]
    out += ["There is one snapshot alone, so nothing to compare it with.", ""] if len(snapshots) == 1 else []
    out += ["| | " + " | ".join(str(s["label"]) for s in snapshots) + " |", "|---" * (len(snapshots) + 1) + "|"]
    out += [f"| {m} | " + " | ".join(show(s.get(m), unit) for s in snapshots) + " |" for m, (unit, _) in overtime.WATCHED.items()]
    hidden = last["agents"] - last["resolvable_runs"]
    out += ["", f"{hidden:g} of the last snapshot's runs are of a kind whose outcome is never recorded; the resolvable rate leaves them out."] if hidden else []
    out += ["", "## What moved", ""]
    told = []
    for r in moved:
        unit, worse = overtime.WATCHED[r["metric"]]
        if r["change"] is not None and abs(r["change"]) >= overtime.MOVED[unit]:
            told.append(f"- {r['metric']} {'rose' if r['change'] > 0 else 'fell'} by {show(abs(r['change']), unit)} ({r['verdict'] or 'reported only'})")
    out += told or ["- nothing by enough to tell"]
    out += ["", f"## Agent types of {last['label']}", "", "Their names are the user's own; keep this table to yourself.", ""]
    types = sorted(last.get("by_agent_type", {}).items(), key=lambda kv: (-kv[1]["unaccounted"], kv[0]))
    out += ["| type | runs | no outcome | outcome never recorded | rate of the rest | tool time |", "|---|---|---|---|---|---|"] if types else ["no agent runs"]
    for name, t in types:
        rate = t["unaccounted_resolvable"] / t["resolvable_runs"] if t["resolvable_runs"] else None
        out.append(f"| {name} | {t['runs']} | {t['unaccounted']} | {t['unresolvable']} | {pct(rate)} | {fmt_ms(t['tool_ms'])} |")
    return "\n".join(out) + "\n"


def render_headlines(found: dict) -> str:
    """A study's overall rates, a line each: every rate that stands at the top of an analysis."""
    out = []
    for analysis, tree in found.items():
        for name, value in tree.items():
            if isinstance(value, dict) and {"n", "of", "pct", "ci95_pct"} <= value.keys():
                out.append(f"{analysis}, {name}: {value['pct']:.2f}% [{value['ci95_pct'][0]:.2f}, {value['ci95_pct'][1]:.2f}] ({value['n']}/{value['of']})")
    return "\n".join(out) + "\n"
