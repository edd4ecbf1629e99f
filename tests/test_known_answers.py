"""Hand-checkable corpora: the expected numbers follow from the few events given."""

import json
import math

import pytest

from tracewright import report
from tracewright.functions.stats import dist, rounded_rank, trend_test
from tracewright.plans import characterize, doctor, overtime, study, workload
from tracewright.schema import Trace, event_schema
from tracewright.sources import events


@pytest.fixture(scope="module")
def log(spark):
    """A trace from dictionaries of events, in order."""

    def make(rows):
        lines = [json.dumps({"session": "s"} | r | {"seq": i}) for i, r in enumerate(rows)]
        frame = spark.createDataFrame([(x,) for x in lines], "value string")
        from pyspark.sql import functions as F

        return Trace(frame.select(F.from_json("value", event_schema().add("seq", "long")).alias("e")).select("e.*"))

    return make


def call(ts, ms=1000, name="Bash", error=False, status="matched", agent=None, shape="k:i", **more):
    done = status == "matched"
    return {"ev": "tool_call", "agent": agent, "ts": ts, "ts_result": ts + ms if done else None, "duration_ms": ms if done else None, "name": name, "args_shape": shape, "is_error": error, "result_chars": 10, "status": status, "id": f"t{ts}"} | more


def api(ts, last=None, agent=None, uuid=None, tools=0, **usage):
    return {"ev": "api_call", "agent": agent, "ts": ts, "ts_last": last, "uuid": uuid or f"a{ts}", "blocks": {"tool_use": tools}, "usage": usage or None}


def run(agent, status=None, **more):
    return {"ev": "session", "agent": agent, "end_status": status, "ts": 1} | more


def test_distribution_and_ranks(spark):
    rows = spark.createDataFrame([(10,), (20,), (30,), (40,)], "v long")
    d = rows.agg(*dist("v")).first()
    assert (d.n, d["mean"], d.p50, d.p99, d["max"]) == (4, 25.0, 20.0, 40.0, 40.0)
    assert rows.where("v > 99").agg(*dist("v")).first().asDict() == {"n": 0, "mean": 0.0, "p50": 0.0, "p90": 0.0, "p95": 0.0, "p99": 0.0, "max": 0.0}
    ranks = rounded_rank(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long"), "v", (0.5,))
    assert ranks.first().p50 == 3  # half-even of 1.5 is index 2


def test_ranks_of_every_length(spark):
    for n in (1, 2, 5, 18, 101):
        values = sorted((i * 7) % 13 for i in range(n))
        found = rounded_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", (0.5, 0.95, 0.99)).first()
        assert [found.p50, found.p95, found.p99] == [values[min(n - 1, round(q * (n - 1)))] for q in (0.5, 0.95, 0.99)]


def test_long_calls_hold_most_of_the_time(log):
    t = log([call(0, 1000), call(2000, 9000), call(20_000, 90_000)])
    over = {r.over_ms: (r.call_share, r.time_share) for r in characterize.long_calls(t.tool_calls).collect()}
    assert over[10_000] == (0.3333, 0.9)


def test_overlap_and_fan_out(log):
    t = log([call(0, 10_000), call(5000, 3000), call(20_000, 1000), api(0, tools=2), api(1, tools=1)])
    assert characterize.parallel_overlap(t.tool_calls).first().share == 0.333
    assert characterize.fan_out(t.api_calls).first().parallel_share == 0.5


def test_notification_lag(log):
    t = log([run("x", t_start=0, t_end=10_000), {"ev": "notification", "ts": 25_000, "agent_ref": "x"}, {"ev": "notification", "ts": 5000, "agent_ref": "x"}])
    lag = characterize.notification_lag(t).first()
    assert (lag.n, lag["max"]) == (1, 15.0)


def test_outcomes_and_calls_that_never_returned(log):
    t = log([run(None), run("a"), run("b", "unknown"), run("c", "failed"), run("d", "completed"), call(0), call(1, status="unmatched"), call(2, status="orphan_result")])
    f = doctor.findings(t).first()
    assert (f.sessions, f.agents, f.unaccounted, f.never_returned, f.tool_calls) == (1, 4, 2, 2, 3)
    s = overtime.snapshot(t).first()
    assert (s.unaccounted_rate, s.duration_p50_ms) == (0.5, 1000)


def test_workflow_runs_are_not_resolvable(log):
    s = overtime.snapshot(log([run("a", workflow="wf_1")])).first()
    assert (s.unaccounted, s.resolvable_runs, s.unaccounted_resolvable) == (1, 0, 0)
    types = overtime.by_agent_type(log([run("a", agent_type=""), run("b", agent_type="k", t_start=5, t_end=9), call(0, agent="b")])).collect()
    assert {r.agent_type: (r.runs, r.tool_ms, r.runtime_ms) for r in types} == {"(untyped)": (1, 0, 0), "k": (1, 1000, 4)}


def test_long_tail_share_of_a_snapshot(log):
    assert overtime.snapshot(log([call(0, 60_000), call(1, 30_000), call(2, 10_000)])).first().longtail_share_60s == 0.6


def test_gate_tells_noise_from_a_shift(log, spark):
    def side(bad, of):
        return overtime.snapshot(log([run(f"g{i}", "completed" if i >= bad else None) for i in range(of)]))

    flagged = lambda a, b: {r.metric for r in overtime.gate(a, b).collect() if r.regressed}
    assert flagged(side(2, 20), side(3, 20)) == set()
    assert flagged(side(200, 2000), side(300, 2000)) == {"unaccounted_resolvable_rate"}
    assert flagged(side(300, 2000), side(200, 2000)) == set()
    rows = {r.metric: r for r in overtime.gate(side(200, 2000), side(300, 2000)).collect()}
    told = rows["unaccounted_resolvable_rate"]
    assert told.p == pytest.approx(math.erfc(told.z / math.sqrt(2)), rel=1e-9) and told.p < 1e-5
    assert told.base_lo_pct < 10 < told.base_hi_pct < told.current_lo_pct < 15 < told.current_hi_pct
    assert rows["tool_error_rate"].skipped and rows["tool_error_rate"].p is None and rows["tool_error_rate"].base_lo_pct is None
    with pytest.raises(Exception, match="not a valid snapshot"):
        overtime.validate(side(2, 20).withColumn("unaccounted", __import__("pyspark").sql.functions.lit(99).cast("long"))).collect()


def test_trend_notes(spark):
    bins = lambda rows: spark.createDataFrame(rows, "score double, n long, of long")
    assert trend_test(bins([(0.0, 1, 10), (1.0, 2, 10)]), []).first().note == "too few bins"
    assert trend_test(bins([(float(i), 10, 10) for i in range(4)]), []).first().note == "degenerate"
    assert trend_test(bins([(float(i), 10 + 20 * i, 100) for i in range(4)]), []).first().z > 5


def test_what_follows_an_error(log):
    t = log([
        call(1, 1, error=True), call(10, 1, error=True), call(20, 1, shape="k:s1", error=True), call(30, 1, "Read"), call(40, 1, "Read", error=True),
        call(1, 1, error=False, agent="x"), call(5, 1, agent="x"), api(21, tools=1), api(41),
    ])
    after = {r.label: r.n for r in study.after_error_tool_call(t.tool_calls).collect()}
    assert after == {"retry_identical_shape": 1, "same_tool_different_arguments": 1, "switched_tool": 1, "no_further_tool_call": 1}
    model = {r.label: r.n for r in study.after_error_model_response(t.tool_calls, t.api_calls).collect()}
    assert model == {"kept_acting": 3, "text_only_response": 1}
    assert (study.error_rate(t.tool_calls).first().n, study.error_rate(t.tool_calls).first().of) == (4, 7)


def test_repeats_by_both_bounds(log):
    t = log([call(i, 1, result_chars=c) for i, c in enumerate((10, 10, 99, 99), 1)])
    upper, lower = (study.repeat_summary(t.tool_calls, s).first() for s in (False, True))
    assert (upper.runs, lower.runs, upper.calls_in_runs, lower.calls_in_runs) == (1, 2, 4, 4)
    nulls = log([call(i, 1, name=None, shape=None) for i in (1, 2)])
    assert study.repeat_summary(nulls.tool_calls).first().runs == 1


def test_tiers_include_their_bound(log):
    tiers = {r.tier_ms: r.n for r in study.longtail_tiers(log([call(1, 59_999), call(2, 60_000), call(3, 61_000)]).tool_calls).collect()}
    assert tiers == {10_000: 3, 30_000: 3, 60_000: 2}


def test_classes_of_long_calls(log):
    t = log([call(1, 60_000, "AskUserQuestion"), call(2, 60_000, "Agent"), call(3, 60_000, background=True), call(4, 60_000, error=True), call(5, 60_000)])
    found = {r["class"]: r.n for r in study.longtail_composition(t.tool_calls).where("tier_ms = 60000").collect()}
    assert found == {"waiting_on_human": 1, "waiting_on_agent": 2, "errored": 1, "heavy_work": 1}


def test_recovery_and_thin_evidence(log):
    t = log([run("a", "completed"), run("b", "completed"), run("c"), call(1, agent="b", error=True), call(2, agent="b"), call(1, agent="c", error=True)])
    found = {r.had_error: (r.n, r.of, r.known, r.unknown) for r in study.recovery(t).collect()}
    assert found == {True: (1, 2, 2, 0)}  # a run without calls is in no group; a null status counts as known
    assert {r.calls: r.runs for r in study.thin_evidence(t).collect()} == {"0": 1, "1-2": 1}
    status = {r.end_status: (r.n, r.of) for r in study.unresolved_by_status(t).collect()}
    assert status == {"completed": (0, 1), "unknown": (1, 1)}


def test_context_joins_the_last_call_of_an_id(log):
    t = log([api(1, uuid="u", **{"in": 1}), api(2, uuid="u", **{"in": 30_000, "cache_read": 500_000}), call(3, api_uuid="u"), call(4, api_uuid="gone"), call(5, api_uuid="")])
    assert tuple(study.context_join_counts(t.tool_calls, t.api_calls).first()) == (1, 2)
    assert [r.label for r in study.context_error_rate(t.tool_calls, t.api_calls).collect()] == ["300k+"]


def test_calls_after_a_compaction(log):
    t = log([{"ev": "compact", "ts": 1000}, {"ev": "compact", "ts": 0}, {"ev": "compact", "ts": 2000, "agent": "x"}, call(999), call(1000, error=True), call(601_000), call(601_001), call(1500, agent="x")])
    w = study.compaction_window(t.tool_calls, t.compacts).first()
    assert (w.near_of, w.near_n, w.compactions, w.streams) == (2, 1, 3, 2)


def test_turns_gaps_and_replay(log):
    t = log([{"ev": "prompt", "ts": 0}, api(5000, 6000, uuid="a"), api(8000, 9000, uuid="b"), {"ev": "prompt", "ts": 20_000}, api(21_000, 22_000, uuid="c")])
    steps = {r.uuid: r for r in workload.steps(t).collect()}
    assert [(steps[u].pre_gap_ms, steps[u].turn) for u in "abc"] == [(5000, 0), (2000, 0), (1000, 1)]
    done = workload.replay(t)
    assert sorted((r.turn, r.traced_ms, r.latency_ms) for r in done.collect()) == [(0, 9000, 9000), (1, 2000, 2000)]
    assert workload.fidelity(done).first()["max"] == 0.0


@pytest.mark.parametrize("wait, background, overhead, latency", [(7000, False, 1000, 8000), (10, True, 0, 1010)])
def test_spawns_wait_or_dont_as_the_log_shows(log, wait, background, overhead, latency):
    t = log([{"ev": "prompt", "ts": 0}, api(0, 1000, uuid="p"), call(1000, wait, "Agent", api_uuid="p", spawned_agent="k"), api(1000, 7000, agent="k", uuid="q")])
    settled = workload.reconcile(workload.tools(t), workload.turns(workload.steps(t))).first()
    assert (settled.background, settled.overhead_ms) == (background, overhead)
    assert {r.agent: r.latency_ms for r in workload.replay(t).collect()} == {None: latency, "k": 6000}


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_agents_that_wait_for_agents_are_settled_at_any_depth(log, depth):
    """Each agent thinks for a second, then waits for the next, whose call adds 10 ms; the
    deepest waits for a tool of 5000 ms."""
    rows = [{"ev": "prompt", "ts": 0}]
    for i in range(depth + 1):
        agent, left = (f"k{i}" if i else None), 1000 * (depth - i) + 5000 + 10 * (depth - i)
        link = {"spawned_agent": f"k{i + 1}"} if i < depth else {}
        rows += [api(1000 * i, 1000 * (i + 1), agent=agent, uuid=f"u{i}"), call(1000 * (i + 1), left, "Agent" if link else "Bash", agent=agent, api_uuid=f"u{i}", **link)]
    found = {r.agent: (r.latency_ms, r.traced_ms) for r in workload.replay(log(rows)).collect()}
    assert found == {(f"k{i}" if i else None): (1000 * (depth - i + 1) + 5000 + 10 * (depth - i),) * 2 for i in range(depth + 1)}


def test_agents_that_wait_in_a_circle_raise(log):
    rows = [api(0, 1000, agent="a", uuid="p"), call(1000, 5000, "Agent", agent="a", api_uuid="p", spawned_agent="b"), api(1000, 2000, agent="b", uuid="q"), call(2000, 5000, "Agent", agent="b", api_uuid="q", spawned_agent="a")]
    with pytest.raises(ValueError, match="circle"):
        workload.replay(log(rows))


def test_policies(spark):
    def pick(policy, rows, k, now=0.0):
        queue = spark.createDataFrame([("q", i, *r) for i, r in enumerate(rows)], "queue_id string, pos int, ready_ms double, service_ms double, waiters int, warm int")
        return [r.pos for r in workload.select_requests(queue, policy, k, now).orderBy("rank").collect()]

    assert pick("fifo", [(r, 1.0, 0, 0) for r in (5.0, 1.0, 3.0, 1.0)], 3) == [1, 3, 2]
    assert pick("combined", [(0.0, 1.0, w, x) for w, x in ((0, 0), (2, 0), (2, 1), (0, 1))], 4) == [2, 1, 3, 0]
    assert pick("sjf", [(0.0, 9.0, 0, 0), (70_000.0, 1.0, 0, 0)], 2, 70_000.0) == [0, 1]
    assert pick("unblock", [(0.0, 1.0, 0, 0), (0.0, 1.0, 3, 0)], -1) == []
    with pytest.raises(Exception, match="not a number"):
        pick("sjf", [(float("nan"), 1.0, 0, 0)], 1)
    with pytest.raises(ValueError):
        workload.policy_order("best", None)


def test_replicas_shift_rigidly(log):
    t = log([{"ev": "prompt", "ts": 0}, api(0, 10), {"ev": "prompt", "ts": 100}, api(100, 110)])
    rows = workload.replicate(workload.turns(workload.steps(t)), 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.session, []).append(r.arrival_ms)
    assert sorted(by) == ["r1:s", "r2:s", "s"] and all(max(v) - min(v) == 100 for v in by.values())
    with pytest.raises(ValueError):
        workload.replicate(workload.turns(workload.steps(t)), 0)


def test_logs_round_trip_and_modes(spark, log, tmp_path):
    t = log([run(None), call(1, error=True), api(2, 3)])
    events.write_table(t, f"{tmp_path}/events")
    assert study.error_rate(events.open_log(spark, str(tmp_path)).tool_calls).first().n == 1
    with open(tmp_path / "log.jsonl", "w") as f:
        f.write('{"ev":"tool_call","session":"s","is_error":true,"ts":1}\n{broken\n')
    assert study.error_rate(events.read_jsonl(spark, f"{tmp_path}/log.jsonl", "lenient").tool_calls).first().n == 1
    with pytest.raises(Exception):  # noqa: B017
        events.read_jsonl(spark, f"{tmp_path}/log.jsonl").tool_calls.collect()
    with pytest.raises(FileNotFoundError):
        events.open_log(spark, f"{tmp_path}/none")


def test_shared_aggregate_names_its_fields(log):
    t = log([run("a"), call(1, name="mcp__private"), call(5000, name="Bash")])
    shared = report.shareable(t, {"corpus_id": "t_1", "secret": "x", "schema_version": 1})
    assert shared["tool_ms_by_builtin"] == {"Bash": 1000, "other": 1000} and "private" not in json.dumps(shared) and "secret" not in shared
    assert "0 sessions, 1 agent runs" in report.render_findings(t)


def test_reports_of_a_small_and_an_empty_log(log):
    for rows in ([run(None, t_start=1, t_end=60_001), run("a", "completed"), call(1, agent="a", error=True), api(1, 5, **{"in": 10, "cache_read": 90}), {"ev": "prompt", "ts": 1}], []):
        t = log(rows) if rows else log([run(None)]).__class__(log([run(None)]).events.limit(0))
        found = report.study_report(t)
        assert found.keys() == report.ANALYSES.keys()
        assert report.characterization(t)["corpus"]["sessions"] == len(rows[:1])
        assert report.findings(t)["tool_calls"] == (1 if rows else 0)
        assert report.drift(found, found) == [] and report.render_tree("Study", found).startswith("# Study")
    with pytest.raises(ValueError):
        report.study_report(t, ("nothing",))


def test_a_view_reads_its_kind_and_its_columns(spark, log, tmp_path):
    events.write_table(log([run(None), call(1, error=True), api(2, 3)]), f"{tmp_path}/events")
    plan = study.error_rate(events.read_table(spark, f"{tmp_path}/events").tool_calls)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ev" in plan and "ReadSchema: struct<is_error:boolean>" in plan
    assert plan.count("Exchange") <= 2
