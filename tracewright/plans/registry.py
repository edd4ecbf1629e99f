"""All queries of the trace analytics over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.stats import Z95
from tracewright.plans import characterize, doctor, overtime, raw, replication, study, workload
from tracewright.sources.bridge import trace, with_views

Query = Callable[[SparkSession, str], DataFrame]


def _wilson(n: str, of: str, sign: str) -> str:
    p, z = f"({n}::double / {of})", repr(Z95)
    centre, spread = f"({p} + {z} * {z} / (2.0 * {of}))", f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4.0 * {of})) / {of}))"
    return f"case when {of} = 0 then 0.0 else round(100 * greatest(0.0, least(1.0, ({centre} {sign} {spread}) / (1 + {z} * {z} / {of}))), 3) end"


def _rate(n: str = "n", of: str = "of") -> str:
    return f"case when {of} = 0 then 0.0 else round(100 * ({n}::double / {of}), 3) end as pct, {_wilson(n, of, '-')} as lo_pct, {_wilson(n, of, '+')} as hi_pct"


def _z(a: str, a_of: str, b: str, b_of: str) -> str:
    pooled = f"(({a} + {b})::double / ({a_of} + {b_of}))"
    return f"case when {a_of} = 0 or {b_of} = 0 or {pooled} in (0, 1) then 0.0 else ({a}::double / {a_of} - {b}::double / {b_of}) / sqrt({pooled} * (1 - {pooled}) * (1.0 / {a_of} + 1.0 / {b_of})) end"


def _p(z: str) -> str:
    """Two-sided p of a z to six digits: by a series, which converges for |z| <= 7, and 0 beyond."""
    return f"case when {z} = 0 then 1.0 when abs({z}) > 7 then 0.0 else 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 150), lambda i: exp(2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2) + (2 * i + 1) * ln(abs({z}) / sqrt(2))))) end"


def _dist(c: str) -> str:
    ranks = ", ".join(f"coalesce(quantile_disc({c}, {q}), 0)::double as p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99))
    return f"count({c}) as n, coalesce(round(avg({c}), 2), 0.0) as mean, {ranks}, coalesce(max({c}), 0)::double as max"


def _nearest(c: str) -> str:
    return ", ".join(f"quantile_disc({c}, {q})::double as p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99)) + f", max({c})::double as max"


def _share(n: str, of: str, digits: int | None = None) -> str:
    value = f"case when coalesce({of}, 0) = 0 then 0.0 else {n}::double / {of} end"
    return f"round({value}, {digits})" if digits is not None else value


def _rank(c: str, q: float) -> str:
    return f"list_sort(list({c}))[1 + round_even({q} * (count({c}) - 1), 0)::int]"


STREAM = "partition by session, agent order by sort_ts, seq"
CLASS = """case when is_error then 'errored' when name in ('AskUserQuestion', 'ExitPlanMode') then 'waiting_on_human'
    when name in ('Agent', 'Monitor', 'TaskStop', 'SendMessage') or background then 'waiting_on_agent' else 'heavy_work' end"""
FIRST = "calls as (select *, min(seq) over (partition by session, agent) as stream_ord from tool_calls), ordered as (select *, row_number() over (order by stream_ord, sort_ts, seq) as first from calls)"
ISLANDS = """{p}marks as (select *, case when row_number() over s = 1 or lag(name) over s is distinct from name or lag(args_shape) over s is distinct from args_shape {strict} then 1 else 0 end as starts
    from tool_calls window s as (partition by session, agent order by sort_ts, seq)),
{p}numbered as (select *, sum(starts) over (partition by session, agent order by sort_ts, seq) as island from {p}marks),
{p}runs as (select session, agent, count(*) as length, any_value(name) as tool, any_value(args_shape) as args_shape, arg_min(ts, sort_ts::hugeint * 10000000 + seq) as start_ts,
    count(*) filter (is_error) as errors_in_run, arg_min(seq, sort_ts::hugeint * 10000000 + seq) as first_seq from {p}numbered group by session, agent, island having count(*) >= 2)"""
BY_SIZE = "or lag(result_chars) over s is distinct from result_chars"
UPPER, LOWER, LOW = ISLANDS.format(strict="", p=""), ISLANDS.format(strict=BY_SIZE, p=""), ISLANDS.format(strict=BY_SIZE, p="low_")
EXACT = ISLANDS.format(strict="", p="exact_").replace("from tool_calls", "from (select * replace (args_shape || ':' || (result_chars % 9)::varchar as args_shape) from tool_calls)")
AGENTS = f"""placed as (select *, row_number() over (partition by session, agent order by sort_ts, seq) as pos, lead(seq) over (partition by session, agent order by sort_ts, seq) is null as is_last from tool_calls where agent is not null),
opened as (select *, is_error and coalesce(max(case when not is_error then pos end) over (partition by session, agent, name) < pos, true) as open from placed),
per as (select session, agent, count(*) as n_calls, count(*) filter (is_error) as n_errors, bool_or(open) as has_unresolved, bool_or(is_last and is_error) as last_errored from opened group by session, agent),
firsts as (select session, agent, min(seq) as stream_ord from (select session, agent, seq from tool_calls union all select session, agent, seq from sessions union all select session, null, seq from prompts) group by session, agent),
agents as (select s.session, s.agent, s.end_status, s.agent_type, f.stream_ord, coalesce(n_calls, 0) as n_calls, coalesce(n_errors, 0) as n_errors, coalesce(has_unresolved, false) as has_unresolved, coalesce(last_errored, false) as last_errored
    from sessions s join firsts f on f.session = s.session and f.agent = s.agent left join per p on p.session = s.session and p.agent = s.agent where s.agent is not null)"""
CONTEXT = "joined as (select t.*, a.context_tokens, least(a.context_tokens // 25000, 12)::int as bin from tool_calls t left join api_calls a on t.api_uuid = a.uuid)"
COUNTERS = """counters as (select
    (select count(*) from sessions where agent is null) as sessions, (select count(*) from sessions where agent is not null) as agents,
    (select count(*) from sessions where agent is not null and coalesce(end_status, '') not in ('completed', 'failed')) as unaccounted,
    (select count(*) from sessions where agent is not null and workflow is null) as resolvable_runs,
    (select count(*) from sessions where agent is not null and workflow is null and coalesce(end_status, '') not in ('completed', 'failed')) as unaccounted_resolvable,
    (select count(*) from tool_calls where status <> 'matched') as never_returned, (select count(*) from tool_calls) as tool_calls,
    (select count(*) from tool_calls where is_error) as tool_errors, (select coalesce(sum(duration_ms), 0)::bigint from tool_calls) as tool_ms_total,
    (select coalesce(sum(greatest(0, ts_last - ts)), 0)::bigint from api_calls) as model_ms_total, (select coalesce(max(duration_ms), 0) from tool_calls) as slowest_call_ms,
    (select coalesce(sum(case when duration_ms >= 60000 then duration_ms end), 0)::bigint from tool_calls) as long_ms,
    (select coalesce(sum(tok_in), 0)::bigint from api_calls) as tokens_in, (select coalesce(sum(tok_out), 0)::bigint from api_calls) as tokens_out,
    (select coalesce(sum(cache_read), 0)::bigint from api_calls) as tokens_cache_read, (select coalesce(sum(cache_create), 0)::bigint from api_calls) as tokens_cache_create)"""
TIERS = "(select unnest([10000, 30000, 60000, 300000, 600000, 1800000]) as tier_ms)"
RATIO = "case when tok_in + cache_read + cache_create > 0 then cache_read::double / (tok_in + cache_read + cache_create) end"


def _trend_by_tool_sql(least: int) -> str:
    return f"""with {CONTEXT}, {FIRST}, busy as (select name as tool from ordered where name is not null group by name order by count(*) desc, min(first) limit 3),
        c as (select tool, bin::double as x, count(*) filter (is_error)::double as s, count(*)::double as t from joined join busy on name = tool where context_tokens is not null group by 1, 2 having count(*) >= {least}),
        m as (select tool, count(*) as bins_used, sum(t) as t, sum(s) as s, sum(t * x) as tx, sum(s * x) as sx, sum(t * x * x) as txx from c group by 1),
        v as (select *, s / t as p, tx / t as mean from m), n as (select *, case when bins_used < 3 then 'too few bins' when p in (0, 1) or p * (1 - p) * (txx - t * mean * mean) <= 0 then 'degenerate' end as note from v)
        select tool, bins_used, round(case when note is null then (sx - s * mean) / sqrt(p * (1 - p) * (txx - t * mean * mean)) else 0.0 end, 6) as z, note from n"""


def _composition_sql(least: int) -> str:
    return f"""with {CONTEXT}, {FIRST}, c as (select bin, coalesce(j.name, '?') as tool, count(*) as n, min(o.first) as f from joined j join ordered o using (seq) where context_tokens is not null group by 1, 2),
        d as (select *, (sum(n) over (partition by bin))::bigint as of from c)
        select bin, tool, n, of, round(100 * n / of, 1) as pct from d where of >= {least} qualify row_number() over (partition by bin order by n desc, f) <= 4"""


def _long_tail(where: str, tiers: str, digits: str) -> str:
    r = (lambda e: f"round({e}, {digits})") if digits else (lambda e: e)
    return f"""with s as (select count(*) as n, sum(duration_ms)::double as ms from tool_calls where {where}),
    t as (select unnest({tiers}) as over_ms)
    select over_ms, {r("(select count(*) from tool_calls where " + where + " and duration_ms >= over_ms)::double / s.n")} as call_share,
    {r("coalesce((select sum(duration_ms) from tool_calls where " + where + " and duration_ms >= over_ms), 0)::double / s.ms")} as time_share from t, s"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduling queues of up to some hundred requests from orders, one per priority and status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    return o.select(
        F.concat("o_orderpriority", "o_orderstatus").alias("queue_id"),
        key.alias("pos"),
        (F.col("o_custkey") % 1000 * 100).cast("double").alias("ready_ms"),
        F.round(F.col("o_totalprice"), 0).cast("double").alias("service_ms"),
        (key % 4).cast("int").alias("waiters"),
        (key % 3 % 2).cast("int").alias("warm"),
    )


def _select(policy: str) -> Query:
    return lambda spark, d: workload.select_requests(_queue(spark, d), policy, 8, 100_000.0).select("queue_id", "pos", "rank")


_POLICY_SQL = {
    "fifo": "ready_ms, pos",
    "sjf": "late, late_at, service_ms, pos",
    "unblock": "late, late_at, -waiters, pos",
    "affinity": "late, late_at, 1 - warm, pos",
    "combined": "late, late_at, -waiters, 1 - warm, pos",
}


def _select_sql(policy: str) -> str:
    # within the late, late_at and pos decide alone
    keys = _POLICY_SQL[policy]
    for c in ("service_ms", "-waiters", "1 - warm"):
        if policy != "fifo":
            keys = keys.replace(f" {c},", f" case when late = 1 then {c} end,")
    return f"""with q as (select o_orderpriority || o_orderstatus as queue_id, o_orderkey as pos, (o_custkey % 1000 * 100)::double as ready_ms, round(o_totalprice, 0) as service_ms,
    o_orderkey % 4 as waiters, o_orderkey % 3 % 2 as warm from orders),
    l as (select *, case when 100000 - ready_ms >= 60000 then 0 else 1 end as late, case when 100000 - ready_ms >= 60000 then ready_ms end as late_at from q),
    r as (select queue_id, pos, row_number() over (partition by queue_id order by {keys.replace("late_at", "late_at nulls first")}) as rank from l)
    select * from r where rank <= 8"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("job"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("arrival"), (F.col("o_orderkey") % 90).alias("duration"))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.operators.sequences import replay_completion

    return replay_completion(_jobs(spark, sf_dir), ["stream"], "arrival", "duration", ["arrival", "job"])


def _bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a shape (their length) beside those that share their bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("s"), F.length("text")).alias("shape"), F.md5(F.col("text").cast("binary")).alias("exact"))
    of = lambda c: docs.groupBy(c).agg(F.count("*").alias("n")).agg(F.count("*").alias(f"{c}_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(f"{c}_repeated"))
    return of("shape").crossJoin(of("exact"))  # one row each


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, type and day."""
    from tracewright.operators.sequences import first_of
    from tracewright.sources.bridge import base_events

    day = base_events(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / 86_400_000))
    return first_of(day, ["user_id", "event_type", "day"], ["event_id"]).select("event_id", "user_id", "event_type", "day")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.functions.shapes import args_shape, parsed

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(parsed(F.col("props")).alias("v")).groupBy(args_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))


def _long_short_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tool's error rate of calls of a minute and over against its shorter ones, with p."""
    from tracewright.functions.stats import significant, two_proportion_z, two_sided_p
    from tracewright.sources.bridge import trace

    calls = trace(spark, sf_dir).tool_calls.where("duration_ms is not null")
    long = F.col("duration_ms") >= 60_000
    sides = {"long": long, "short": ~long}
    counts = calls.groupBy("name").agg(*[c for s, on in sides.items() for c in (F.count_if(on & F.col("is_error")).alias(f"{s}_n"), F.count_if(on).alias(f"{s}_of"))])
    tested = counts.select("name", two_proportion_z(*[F.col(c) for c in ("long_n", "long_of", "short_n", "short_of")]).alias("z"))
    return tested.select("name", F.round("z", 6).alias("z"), F.round(two_sided_p(F.col("z")), 6).alias("p"), significant(F.col("z")).alias("significant"))


def _varied_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of values of every type, written around each event's own."""
    from tracewright.functions.shapes import args_shape, parsed

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    around = lambda before, after: F.concat(F.lit(before), value, F.lit(after))
    json = (
        F.when(kind == 0, around("[", ', "x", {}]'))
        .when(kind == 1, around('"', '"'))
        .when(kind == 2, around('{"b": true, "a": null, "z": ', ".5}"))
        .when(kind == 3, "null")
        .when(kind == 4, around('{"s": "', ' \\u00e9\\n", "deep": {"x": [], "y": {}}, "-": -3}'))
        .when(kind == 5, around("-", "e2"))
        .otherwise("{}")
    )
    return e.select(parsed(json).alias("v")).groupBy(args_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))


def _spelled_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes, sizes and signatures that hang on how a value is spelled: whole floats, repeated keys, bare strings among blocks."""
    from tracewright.functions.shapes import args_shape, content_chars, exact_signature, parsed

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 8
    around = lambda before, after: F.concat(F.lit(before), value, F.lit(after))
    json = (
        F.when(kind == 0, around('{"a": ', ".0}"))
        .when(kind == 1, around('{"a": "x", "a": ', "}"))
        .when(kind == 2, around('{"deep": {"x": 1, "x": ', "}}"))
        .when(kind == 3, around('["', '", {"text": "de", "content": 5, "thinking": "f"}, null, 7, ["no"]]'))
        .when(kind == 4, around('[{"text": 5}, {"content": "', '"}]'))
        .when(kind == 5, around('"', '"'))
        .when(kind == 6, around('{"big": 1234567890123456789', ', "e": 1e2}'))
        .otherwise(around('{"a": ', ', "b": [1.0]}'))
    )
    other = F.when(kind == 0, around('{"a": ', "}")).when(kind == 7, around('{"b": [1.00], "a": ', "}")).otherwise(json)
    rows = e.select(parsed(json).alias("v"), parsed(other).alias("w"))
    same = exact_signature(F.col("v")) == exact_signature(F.col("w"))
    return rows.groupBy(args_shape(F.col("v")).alias("shape"), content_chars(F.col("v")).alias("chars"), same.alias("same")).agg(F.count("*").alias("n"))


def _mixed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some tools under names that may be shared, others not."""
    calls = trace(spark, sf_dir).tool_calls
    name = F.when(F.col("name") == "click", "Bash").when(F.col("name") == "view", "Read").otherwise(F.col("name"))
    return doctor.time_by_shareable_tool(calls.withColumn("name", name))


def _turn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant message with the latest user message at or before it."""
    from tracewright.operators.joins import asof_backward

    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    user = talk.where("role = 'user'").groupBy("conv_id", "turn").count()
    return asof_backward(talk.where("role = 'assistant'").select("conv_id", "turn"), user, ["conv_id"], "turn", "turn", F.col("turn"), "prompt_turn")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the sessions, by their hash, against the other."""
    whole = trace(spark, sf_dir)
    half = lambda late: overtime.snapshot(type(whole)(whole.events.where((F.md5(F.col("session").cast("binary")) >= "8") == late)))
    return overtime.gate(half(False), half(True))


#: A gated proportion's metric, part and whole in the SQL below.
GATED = (("unaccounted_resolvable_rate", "could_gone", "could"), ("never_returned_rate", "lost", "calls"), ("tool_error_rate", "errors", "calls"))


def _gate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).where("rule = 'proportion'").select("metric", F.round("p", 6).alias("p"), "base_lo_pct", "base_hi_pct", "current_lo_pct", "current_hi_pct")


def _gate_evidence_sql() -> str:
    bounds = lambda n, of: ", ".join(f"{_wilson(f'{s}.{n}', f'{s}.{of}', sign)} as {side}_{end}_pct" for s, side in (("b", "base"), ("c", "current")) for sign, end in (("-", "lo"), ("+", "hi")))
    rows = [f"select '{metric}' as metric, {_z(f'c.{n}', f'c.{of}', f'b.{n}', f'b.{of}')} as z, {bounds(n, of)} from b, c where b.{of} > 0 and c.{of} > 0" for metric, n, of in GATED]
    return f"""with t as (select md5(session) >= '8' as late, count(*) as calls, count(*) filter (status <> 'matched') as lost, count(*) filter (is_error) as errors from tool_calls group by 1),
    s as (select md5(session) >= '8' as late, count(*) as could, count(*) filter (coalesce(end_status, '') not in ('completed', 'failed')) as could_gone from sessions where agent is not null and workflow is null group by 1),
    b as (select * from t join s using (late) where not late), c as (select * from t join s using (late) where late), rows_ as ({" union all ".join(rows)})
    select metric, round({_p("z")}, 6) as p, base_lo_pct, base_hi_pct, current_lo_pct, current_hi_pct from rows_"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("metric", "rule", F.round("base", 6).alias("base"), F.round("current", 6).alias("current"), F.round("z", 6).alias("z"), "gated", "skipped", "regressed")


def _gate_sql() -> str:
    rank = lambda c, q: f"list_sort(list({c}) filter ({c} is not null))[1 + round_even({q} * (count({c}) - 1), 0)::int]"
    late = "md5(session) >= '8' as late"
    rows = []
    for metric, n, of in GATED:
        void = f"(b.{of} = 0 or c.{of} = 0)"
        z = f"case when not {void} then {_z(f'c.{n}', f'c.{of}', f'b.{n}', f'b.{of}')} end"
        rows.append(f"select '{metric}' as metric, 'proportion' as rule, {_share(f'b.{n}', f'b.{of}')} as base, {_share(f'c.{n}', f'c.{of}')} as current, {z} as z, true as gated, {void} as skipped, coalesce({z} > {Z95!r}, false) as regressed from b, c")
    for metric, least in overtime.THRESHOLDS.items():
        b, c = f"b.{metric}", f"c.{metric}"
        rows.append(f"select '{metric}', 'threshold', {b}, {c}, null, true, false, {c} > {b} * 1.1 and abs({c} - {b}) >= {least} from b, c")
    rows += [f"select '{metric}', 'report', b.{metric}, c.{metric}, null, false, false, false from b, c" for metric in overtime.UNGATED]
    return f"""with t as (select {late}, count(*) as calls, count(*) filter (status <> 'matched') as lost, count(*) filter (is_error) as errors, sum(duration_ms) as tool_ms, sum(duration_ms) filter (duration_ms >= 60000) as long_ms,
        {rank("duration_ms", 0.5)}::double as duration_p50_ms, {rank("duration_ms", 0.95)}::double as duration_p95_ms from tool_calls group by 1),
    a as (select {late}, sum(greatest(0, ts_last - ts)) as model_ms, {rank(f"({RATIO})", 0.5)} as cache_read_share_p50 from api_calls group by 1),
    r as (select {late}, workflow is null as could, coalesce(end_status, '') not in ('completed', 'failed') as gone from sessions where agent is not null),
    s as (select late, count(*) as agents, count(*) filter (gone) as unaccounted, count(*) filter (could) as could, count(*) filter (could and gone) as could_gone from r group by 1),
    sides as (select *, coalesce(long_ms, 0)::double / tool_ms as longtail_share_60s, unaccounted::double / agents as unaccounted_rate, tool_ms::double / (tool_ms + model_ms) as tool_share_of_busy_time from t join a using (late) join s using (late)),
    b as (select * from sides where not late), c as (select * from sides where late), rows_ as ({" union all ".join(rows)})
    select metric, rule, round(base, 6) as base, round(current, 6) as current, round(z, 6) as z, gated, skipped, regressed from rows_"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily error counts as a timeline of snapshots."""
    from tracewright.sources.bridge import base_events

    day = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd")
    daily = base_events(spark, sf_dir).groupBy(day.alias("generated_at")).agg(F.count("*").alias("calls"), F.count_if(F.col("k") % 7 == 0).alias("errors"), F.min("event_id").alias("ord"))
    return overtime.timeline(daily, ("calls", "errors")).drop("ord")


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main threads' snapshot against agents'."""
    whole = trace(spark, sf_dir)
    side = lambda cond: overtime.snapshot(type(whole)(whole.events.where(cond)))
    return overtime.what_moved(side("agent is null"), side("agent is not null"), {"tool_error_rate": ("rate", 1), "duration_p95_ms": ("ms", 1), "tool_share_of_busy_time": ("rate", None)})


def _bracket_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes against exact signatures, here the event's own value."""
    calls = trace(spark, sf_dir).tool_calls
    return replication.bracket(calls, calls.withColumn("args_shape", F.concat("args_shape", F.lit(":"), F.col("result_chars") % 9)))


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = workload.turns(workload.steps(trace(spark, sf_dir)))
    return workload.replicate(turns, 3).groupBy("replica").agg(F.count("*").alias("turns"), F.count_distinct("session").alias("sessions"))


_T = lambda plan: lambda spark, d: plan(trace(spark, d))
_C = lambda plan, *a: lambda spark, d: plan(trace(spark, d).tool_calls, *a)
_A = lambda plan: lambda spark, d: plan(trace(spark, d).api_calls)
_CA = lambda plan, *a: lambda spark, d: (lambda t: plan(t.tool_calls, t.api_calls, *a))(trace(spark, d))
_ROUND = lambda q, **digits: lambda spark, d: (lambda df: df.withColumns({c: F.round(c, n) for c, n in digits.items()}))(q(spark, d))

_ALL: dict[str, tuple[Query, str | None]] = {
    # errors
    "error_rate_by_tool_wilson": (
        _C(study.error_rate_by_tool),
        f"with {FIRST}, c as (select name, count(*) as of, count(*) filter (is_error) as n, min(first) as f from ordered group by name order by of desc, f limit 14) select name as tool, n, of, {_rate()} from c where name is not null",
    ),
    "error_rate_overall": (_C(study.error_rate), f"with c as (select count(*) filter (is_error) as n, count(*) as of from tool_calls) select n, of, {_rate()} from c"),
    "after_error_next_call": (
        _C(study.after_error_tool_call),
        f"""with l as (select is_error, case when lead(seq) over s is null then 'no_further_tool_call'
        when lead(name) over s is not distinct from name and lead(args_shape) over s is not distinct from args_shape then 'retry_identical_shape'
        when lead(name) over s is not distinct from name then 'same_tool_different_arguments' else 'switched_tool' end as label from tool_calls window s as ({STREAM})),
        c as (select label, count(*) as n from l where is_error group by label), o as (select *, (sum(n) over ())::bigint as of from c) select label, n, of, {_rate()} from o""",
    ),
    "after_error_next_model": (
        _CA(study.after_error_model_response),
        f"""with e as (select t.seq, t.ts_result, (select a.tool_use from api_calls a where a.session = t.session and a.agent is not distinct from t.agent and a.ts >= t.ts_result order by a.ts, a.seq limit 1) as use from tool_calls t where is_error),
        c as (select case when ts_result is null then 'no_result_timestamp' when use is null then 'no_further_model_call' when use > 0 then 'kept_acting' else 'text_only_response' end as label, count(*) as n from e group by 1),
        o as (select *, (sum(n) over ())::bigint as of from c) select label, n, of, {_rate()} from o""",
    ),
    "unresolved_errors": (
        _T(study.unresolved_by_status),
        f"with {AGENTS}, c as (select coalesce(end_status, 'unknown') as end_status, count(*) as of, count(*) filter (has_unresolved) as n, count(*) filter (last_errored) as final_errored from agents where n_calls > 0 group by 1) select *, {_rate()} from c",
    ),
    "error_long_vs_short": (
        _ROUND(_C(study.long_versus_short), z=6),
        f"""with c as (select count(*) filter (duration_ms >= 60000 and is_error) as long_n, count(*) filter (duration_ms >= 60000) as long_of,
        count(*) filter (duration_ms < 60000 and is_error) as short_n, count(*) filter (duration_ms < 60000) as short_of from tool_calls where duration_ms is not null)
        select *, round({_z("long_n", "long_of", "short_n", "short_of")}, 6) as z from c""",
    ),
    "error_long_vs_short_p": (
        _long_short_p,
        f"""with c as (select event_type, count(*) filter (duration_ms >= 60000 and is_error) as long_n, count(*) filter (duration_ms >= 60000) as long_of,
        count(*) filter (duration_ms < 60000 and is_error) as short_n, count(*) filter (duration_ms < 60000) as short_of from (select *, name as event_type from tool_calls) where duration_ms is not null group by 1),
        t as (select event_type as name, {_z("long_n", "long_of", "short_n", "short_of")} as z from c)
        select name, round(z, 6) as z, round(p, 6) as p, p < 0.05 as significant from (
          select name, z, case when z = 0 then 1.0 else 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 150), lambda n: exp(2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2) + (2 * n + 1) * ln(abs(z) / sqrt(2))))) end as p from t)""",
    ),
    # the long tail
    "longtail_tiers": (
        _C(study.longtail_tiers),
        f"""with s as (select count(*) as of, sum(duration_ms)::double as total from tool_calls where duration_ms is not null),
        c as (select tier_ms, count(*) as n, sum(duration_ms)::double as ms from tool_calls, {TIERS} where duration_ms >= tier_ms group by 1)
        select tier_ms, n, of, {_rate()}, round(100 * (ms / total), 2) as time_pct from c, s""",
    ),
    "longtail_composition": (
        _C(study.longtail_composition),
        f"""with c as (select tier_ms, {CLASS} as class, count(*) as n, sum(duration_ms)::bigint as ms from tool_calls, {TIERS} where duration_ms >= tier_ms group by 1, 2),
        o as (select *, (sum(n) over (partition by tier_ms))::bigint as of, (sum(ms) over (partition by tier_ms))::bigint as total from c)
        select tier_ms, class, n, of, {_rate()}, ms, round(100 * (ms::double / total), 2) as time_pct from o""",
    ),
    "longtail_by_tool": (
        _C(study.longtail_by_tool),
        f"""with {FIRST}, c as (select tier_ms, name as tool, count(*) as n, min(first) as f from ordered, {TIERS} where duration_ms >= tier_ms group by 1, 2)
        select tier_ms, tool, n from c qualify row_number() over (partition by tier_ms order by n desc, f) <= 8""",
    ),
    "longtail_quantiles": (_C(study.duration_quantiles), f"select count(*) as timed_calls, round(sum(duration_ms) / 3600000, 1) as total_hours, {_nearest('duration_ms')} from tool_calls where duration_ms is not null"),
    "extreme_calls": (
        _C(study.extreme_calls),
        f"with {FIRST} select name as tool, duration_ms, round(duration_ms / 60000, 1) as minutes, {CLASS} as class, is_error, background, result_chars, seq from ordered where duration_ms is not null order by duration_ms desc, first limit 15",
    ),
    "never_returned": (_C(study.never_returned), f"with c as (select count(*) filter (status = 'unmatched') as n, count(*) as of from tool_calls) select n, of, {_rate()} from c"),
    "never_returned_by_tool": (_C(study.never_returned_by_tool), f"with {FIRST}, c as (select name as tool, count(*) as n, min(first) as f from ordered where status = 'unmatched' group by 1 order by n desc, f limit 6) select tool, n from c"),
    # repeats
    **{
        f"repeat_runs_{label}": (
            _C(study.repeat_summary, strict),
            f"""with {sql}, a as (select count(*) as runs, coalesce(sum(length), 0)::bigint as calls_in_runs, coalesce(sum(errors_in_run), 0)::bigint as errors_in_runs, {_nearest("length")} from runs),
            p as (select session, agent, max(length) as longest from runs group by 1, 2), b as (select count(*) as repeat_streams, count(*) filter (longest >= 5) as stuck_streams from p),
            t as (select count(*) as total_calls from tool_calls), s as (select count(*) as streams from (select distinct session, agent from tool_calls)) select * from a, b, t, s""",
        )
        for label, strict, sql in (("upper", False, UPPER), ("lower", True, LOWER))
    },
    "repeat_lengths": (_C(study.repeat_lengths), f"with {UPPER} select length, count(*) as runs from runs group by 1 order by 1 limit 12"),
    "repeat_by_tool": (_C(study.repeat_by_tool), f"with {UPPER}, c as (select tool, count(*) as n, min(first_seq) as f from runs group by 1 order by n desc, f limit 8) select tool, n from c"),
    "longest_runs": (_C(study.longest_runs), f"with {UPPER} select * from runs order by length desc, first_seq limit 5"),
    "stuck_streams": (
        _T(study.stuck_and_ending),
        f"""with {UPPER}, {AGENTS}, k as (select distinct session, agent from runs where length >= 5 and agent is not null),
        c as (select k.session is not null as stuck, count(*) filter (coalesce(end_status in ('failed', 'killed'), false)) as n, count(*) as of from agents a left join k on k.session = a.session and k.agent = a.agent where n_calls > 0 group by 1)
        select stuck, n, of, {_rate()} from c""",
    ),
    # context size
    "context_bin_error_rate": (
        _CA(study.context_error_rate),
        f"""with {CONTEXT}, c as (select bin, count(*) filter (is_error) as n, count(*) as of from joined where context_tokens is not null group by 1)
        select bin, case when bin = 12 then printf('%03dk+', bin * 25) else printf('%03d-%03dk', bin * 25, bin * 25 + 25) end as label, n, of, {_rate()} from c""",
    ),
    "context_join_counts": (_CA(study.context_join_counts), f"with {CONTEXT} select count(context_tokens) as joined, count(*) filter (context_tokens is null) as unjoinable from joined"),
    "context_trend_z": (
        _ROUND(_CA(study.context_trend), z=6),
        f"""with {CONTEXT}, c as (select bin::double as x, count(*) filter (is_error)::double as s, count(*)::double as t from joined where context_tokens is not null group by 1 having count(*) >= 200),
        m as (select count(*) as bins_used, sum(t) as t, sum(s) as s, sum(t * x) as tx, sum(s * x) as sx, sum(t * x * x) as txx from c),
        v as (select *, s / t as p, tx / t as mean from m), n as (select *, case when bins_used < 3 then 'too few bins' when p in (0, 1) or p * (1 - p) * (txx - t * mean * mean) <= 0 then 'degenerate' end as note from v)
        select bins_used, round(case when note is null then (sx - s * mean) / sqrt(p * (1 - p) * (txx - t * mean * mean)) else 0.0 end, 6) as z, note from n""",
    ),
    "context_trend_by_tool": (_ROUND(_CA(study.context_trend_by_tool, 3, "strict", 20), z=6), _trend_by_tool_sql(20)),
    "context_trend_by_tool_full_bins": (_ROUND(_CA(study.context_trend_by_tool), z=6), _trend_by_tool_sql(study.MIN_BIN_CALLS)),
    "context_composition_topk": (_CA(study.context_composition, 4, "strict", 20), _composition_sql(20)),
    "context_composition_full_bins": (_CA(study.context_composition), _composition_sql(study.MIN_BIN_CALLS)),
    "compaction_window_errors": (
        _ROUND(lambda spark, d: study.compaction_window(trace(spark, d).tool_calls, trace(spark, d).compacts), z=6),
        f"""with m as (select t.is_error, exists (select 1 from compacts c where c.session = t.session and c.agent is not distinct from t.agent and t.ts - c.ts between 0 and 600000) as near from tool_calls t),
        c as (select count(*) filter (near and is_error) as near_n, count(*) filter (near) as near_of, count(*) filter (is_error) as all_n, count(*) as all_of from m),
        e as (select count(*) as compactions, count(distinct session) as streams from compacts) select *, round({_z("near_n", "near_of", "all_n", "all_of")}, 6) as z from c, e""",
    ),
    "compaction_triggers": (lambda spark, d: study.compaction_triggers(trace(spark, d).compacts), "select trigger, count(*) as n from compacts group by 1"),
    # endings
    "end_status_rates": (
        _T(study.end_status_rates),
        f"with c as (select coalesce(end_status, 'unknown') as end_status, count(*) as n from sessions where agent is not null group by 1), o as (select *, (sum(n) over ())::bigint as of from c) select end_status, n, of, {_rate()} from o",
    ),
    "hard_failures_by_type": (_T(study.hard_failures_by_type), f"with {AGENTS}, c as (select agent_type, count(*) as n, min(stream_ord) as f from agents where end_status in ('failed', 'killed') group by 1 order by n desc, f limit 6) select agent_type, n from c"),
    "recovery_rates": (
        _T(study.recovery),
        f"""with {AGENTS}, c as (select n_errors > 0 as had_error, count(*) filter (end_status = 'completed') as n, count(*) as of, count(*) filter (end_status is distinct from 'unknown') as known,
        count(*) filter (end_status = 'unknown') as unknown from agents where n_calls > 0 group by 1) select *, {_rate()} from c""",
    ),
    "recovery_test": (
        _ROUND(_T(study.recovery_test), z=6, z_known=6),
        f"""with {AGENTS}, c as (select n_errors > 0 as e, end_status = 'completed' as done, end_status is distinct from 'unknown' as known from agents where n_calls > 0),
        w as (select count(*) filter (e and done) as error_n, count(*) filter (e) as error_of, count(*) filter (e and known) as error_known, count(*) filter (not e and done) as clean_n, count(*) filter (not e) as clean_of, count(*) filter (not e and known) as clean_known from c)
        select *, round({_z("error_n", "error_of", "clean_n", "clean_of")}, 6) as z, round({_z("error_n", "error_known", "clean_n", "clean_known")}, 6) as z_known from w""",
    ),
    "thin_evidence": (
        _T(study.thin_evidence),
        f"with {AGENTS} select case when n_calls = 0 then '0' when n_calls <= 2 then '1-2' when n_calls < 10 then '3-9' else '10+' end as calls, count(*) as runs, count(*) filter (n_calls <= 2) as thin from agents where end_status = 'completed' group by 1",
    ),
    "run_length": (_T(study.run_length), f"with {AGENTS} select count(*) as runs, {_nearest('n_calls')} from agents"),
    "study_summary": (
        _T(study.summary),
        """with k as (select session, agent from tool_calls union select session, agent from sessions union select session, null from prompts union select 'c' || conv_id, null from conversations where role in ('user', 'assistant')),
        a as (select count(*) as streams, count(*) filter (agent is null) as main_sessions, count(agent) as agent_runs from k),
        b as (select count(distinct project) as distinct_projects, round((max(t_end) - min(t_start)) / 86400000, 1) as span_days from sessions)
        select a.*, b.*, (select count(*) from tool_calls) as tool_calls, (select count(*) from api_calls) as api_calls, (select count(*) from prompts) as prompts, (select count(*) from turns) as turns,
        (select count(*) from compacts) as compactions, (select count(distinct name) from tool_calls) as distinct_tools from a, b""",
    ),
    "top_models": (
        _T(study.top_models),
        """with f as (select session, agent, min(seq) as stream_ord from (select session, agent, seq from tool_calls union all select session, agent, seq from sessions) group by 1, 2),
        o as (select a.model, row_number() over (order by (select min(b.seq) from api_calls b where b.session = a.session and b.agent is not distinct from a.agent), ts, seq) as first from api_calls a)
        select model, count(*) as n from o group by 1 order by n desc, min(first) limit 6""",
    ),
    # distributions
    "corpus_stats": (
        _T(characterize.corpus),
        f"""with m as (select *, case when agent is null then (t_end - t_start) / 60000 end as minutes from sessions)
        select count(*) filter (agent is null) as sessions, count(agent) as agents, coalesce(round((max(t_end) filter (agent is null) - min(t_start) filter (agent is null)) / 86400000, 1), 0.0) as span_days,
        coalesce(round(sum(t_end - t_start) filter (agent is null) / 3600000, 1), 0.0) as session_hours_total, {_dist("minutes")} from m""",
    ),
    "models": (_T(characterize.models), "select model, count(*) as n from api_calls group by 1"),
    "prompts_per_session": (lambda spark, d: characterize.prompts_per_session(trace(spark, d).prompts), f"with p as (select session, count(*) as c from prompts group by 1) select coalesce(sum(c), 0)::bigint as prompts, {_dist('c')} from p"),
    "inter_arrival": (
        lambda spark, d: characterize.inter_arrival(trace(spark, d).prompts),
        f"with g as (select ts - lag(ts) over (partition by session order by ts, seq) as gap from prompts), s as (select gap / 1000 as s from g where gap > 0) select {_dist('s')} from s",
    ),
    "queue_ops": (_T(characterize.queue_ops), "select coalesce(op, '?') as op, count(*) as n from queue_ops group by 1"),
    "queue_delivered": (_T(characterize.queue_delivered), "with c as (select (select count(*) from prompts) as prompts, (select count(*) from queue_ops where op = 'dequeue') as delivered) select *, round(delivered::double / prompts, 3) as share from c"),
    "tool_counts": (
        _C(characterize.tool_counts),
        """with c as (select count(*) filter (status = 'matched') as calls_matched, count(*) filter (status = 'unmatched') as calls_unmatched, count(*) filter (status = 'orphan_result') as calls_orphan,
        count(*) filter (status = 'matched' and is_error) as e, count(*) filter (status = 'matched' and background) as b from tool_calls)
        select calls_matched, calls_unmatched, calls_orphan, round(e::double / calls_matched, 4) as error_rate, round(b::double / calls_matched, 4) as background_share from c""",
    ),
    "duration_dist_nearest_rank": (_C(characterize.tool_durations), f"select {_dist('duration_ms')}, coalesce(round(sum(duration_ms) / 3600000, 1), 0.0) as total_hours from tool_calls where status = 'matched' and duration_ms >= 0"),
    "latency_by_tool": (
        _C(characterize.by_tool),
        """with c as (select coalesce(name, '?') as tool, count(*) as n, quantile_disc(duration_ms, 0.5)::double as p50_ms, quantile_disc(duration_ms, 0.95)::double as p95_ms, sum(duration_ms)::double as ms, min(seq) as f
        from tool_calls where status = 'matched' and duration_ms >= 0 group by 1), t as (select sum(ms) as total from c) select tool, n, p50_ms, p95_ms, round(ms / total, 3) as time_share from c, t order by n desc, f limit 12""",
    ),
    "long_calls": (_C(characterize.long_calls), _long_tail("status = 'matched' and duration_ms >= 0", "[10000, 30000, 60000]", "4")),
    "busy_time_share": (
        _T(characterize.busy_share),
        """with c as (select (select sum(duration_ms)::bigint from tool_calls where status = 'matched' and duration_ms >= 0) as tool_ms, (select sum(ts_last - ts)::bigint from api_calls where ts_last >= ts) as model_ms)
        select tool_ms, model_ms, round(model_ms / 3600000, 1) as model_hours, round(tool_ms::double / (tool_ms + model_ms), 3) as tool_share from c""",
    ),
    "fan_out": (
        _A(characterize.fan_out),
        """with c as (select count(*) as api_calls, count(*) filter (tool_use >= 1) as w, count(*) filter (tool_use >= 2) as p, max(tool_use) as fanout_max from api_calls)
        select api_calls, round(w::double / api_calls, 3) as with_tools_share, round(p::double / w, 3) as parallel_share, fanout_max from c""",
    ),
    "agents_per_session": (_T(characterize.agents_per_session), f"with p as (select session, count(*) as c from sessions where agent is not null group by 1) select {_dist('c')} from p"),
    "spawn_depths": (_T(characterize.spawn_depths), "select spawn_depth::int as spawn_depth, count(*) as n from sessions where agent is not null group by 1"),
    "agent_end_status": (_T(characterize.agent_end_status), "select coalesce(end_status, 'unknown') as end_status, count(*) as n from sessions where agent is not null group by 1"),
    "agent_runtime": (
        _T(characterize.agent_runtime),
        f"with m as (select (t_end - t_start) / 60000 as minutes, background from sessions where agent is not null) select {_dist('minutes')}, round(count(*) filter (background)::double / count(*), 3) as background_share from m",
    ),
    "parallel_overlap": (
        _C(characterize.parallel_overlap),
        """with o as (select ts < max(ts_result) over (partition by session, agent order by ts, ts_result, seq rows between unbounded preceding and 1 preceding) as over from tool_calls where status = 'matched' and duration_ms >= 0),
        c as (select count(*) filter (over) as overlapped, count(*) as streamed from o) select *, round(overlapped::double / streamed, 3) as share from c""",
    ),
    "notification_lag": (
        _T(characterize.notification_lag),
        f"with l as (select (n.ts - s.t_end) / 1000 as lag from notifications n join sessions s on n.session = s.session and n.agent_ref = s.agent where n.ts >= s.t_end) select {_dist('lag')} from l",
    ),
    "tokens": (_A(characterize.tokens), "select sum(tok_in)::bigint as tokens_in, sum(tok_out)::bigint as tokens_out, sum(cache_read)::bigint as tokens_cache_read, sum(cache_create)::bigint as tokens_cache_create from api_calls"),
    "cache_read_ratio": (_A(characterize.cache_read_ratio), f"with r as (select round({RATIO}, 4) as r from api_calls) select {_dist('r')} from r"),
    "turn_durations": (
        _T(characterize.turns),
        f"with t as (select duration_ms / 1000 as s, pending from turns) select {_dist('s')}, round(count(*) filter (pending > 0)::double / count(*), 3) as pending_share from t",
    ),
    # one log's findings
    "doctor_findings": (
        _T(doctor.findings),
        f"""with {COUNTERS} select sessions, agents, unaccounted, never_returned, tool_calls, tool_errors, tool_ms_total, model_ms_total, slowest_call_ms, tokens_in, tokens_out, tokens_cache_read, tokens_cache_create,
        {_share("unaccounted", "agents", 4)} as unaccounted_rate, {_share("tool_errors", "tool_calls", 4)} as tool_error_rate, {_share("tool_ms_total", "(tool_ms_total + model_ms_total)", 4)} as tool_share_of_busy_time from counters""",
    ),
    "duration_quantile_half_even": (_C(doctor.duration_ranks), f"select {', '.join(f'{_rank("duration_ms", q)} as p{round(100 * q)}' for q in (0.5, 0.95, 0.99))} from tool_calls where duration_ms is not null"),
    "cache_share_half_even": (_A(doctor.cache_share_rank), f"with r as (select {RATIO} as r from api_calls) select {_rank('r', 0.5)} as p50 from r where r is not null"),
    "unaccounted_examples": (
        _T(doctor.unaccounted_examples),
        """select agent, agent_type, end_status as status, (t_end - t_start) / 60000 as runtime_min, background from sessions
        where agent is not null and coalesce(end_status, '') not in ('completed', 'failed') order by runtime_min desc, seq limit 5""",
    ),
    "time_by_tool": (_C(doctor.time_by_tool), "select coalesce(name, '?') as tool, sum(duration_ms)::bigint as ms from tool_calls where duration_ms is not null group by 1"),
    "time_by_shareable_tool": (_C(doctor.time_by_shareable_tool), "select 'other' as tool, sum(duration_ms)::bigint as ms from tool_calls where duration_ms is not null"),
    "time_by_shareable_tool_mixed": (
        _mixed_tools,
        "select case name when 'click' then 'Bash' when 'view' then 'Read' else 'other' end as tool, sum(duration_ms)::bigint as ms from tool_calls where duration_ms is not null group by 1",
    ),
    "doctor_long_tail": (_ROUND(_C(doctor.long_tail), call_share=9, time_share=9), _long_tail("duration_ms is not null", "[10000, 30000, 60000]", "9")),
    # over time
    "snapshot": (
        _T(overtime.snapshot),
        f"""with {COUNTERS}, r as (select {', '.join(f'{_rank("duration_ms", q)} as duration_p{round(100 * q)}_ms' for q in (0.5, 0.95, 0.99))} from tool_calls where duration_ms is not null),
        q as (select {RATIO} as r from api_calls), c as (select {_rank("r", 0.5)} as cache_read_share_p50 from q where r is not null)
        select sessions, agents, unaccounted, resolvable_runs, unaccounted_resolvable, tool_calls, never_returned, tool_errors, tool_ms_total, model_ms_total, tokens_in, tokens_out, tokens_cache_read, tokens_cache_create, r.*, c.*,
        {_share("long_ms", "tool_ms_total")} as longtail_share_60s, {_share("unaccounted", "agents")} as unaccounted_rate, {_share("unaccounted_resolvable", "resolvable_runs")} as unaccounted_resolvable_rate,
        {_share("never_returned", "tool_calls")} as never_returned_rate, {_share("tool_errors", "tool_calls")} as tool_error_rate, {_share("tool_ms_total", "(tool_ms_total + model_ms_total)")} as tool_share_of_busy_time from counters, r, c""",
    ),
    "types_by_unaccounted": (
        _T(overtime.types_by_unaccounted),
        """with t as (select coalesce(nullif(agent_type, ''), '(untyped)') as agent_type, count(*) as runs, count(*) filter (coalesce(end_status, '') not in ('completed', 'failed')) as unaccounted,
            count(*) filter (workflow is null) as resolvable_runs, count(*) filter (workflow is null and coalesce(end_status, '') not in ('completed', 'failed')) as unaccounted_resolvable from sessions where agent is not null group by 1)
        select row_number() over (order by unaccounted desc, agent_type) as rank, agent_type, runs, unaccounted, case when resolvable_runs > 0 then unaccounted_resolvable::double / resolvable_runs end as resolvable_rate from t""",
    ),
    "by_agent_type": (
        _T(overtime.by_agent_type),
        """with a as (select *, coalesce(agent_type, '(untyped)') as type, coalesce(end_status, '') not in ('completed', 'failed') as un from sessions where agent is not null),
        r as (select type as agent_type, count(*) as runs, count(*) filter (un) as unaccounted, count(*) filter (workflow is not null) as unresolvable, count(*) filter (workflow is null) as resolvable_runs,
        count(*) filter (workflow is null and un) as unaccounted_resolvable, sum(t_end - t_start)::bigint as runtime_ms from a group by 1),
        t as (select type as agent_type, sum(duration_ms)::bigint as tool_ms from tool_calls c join a on c.agent = a.agent where duration_ms is not null group by 1)
        select r.*, coalesce(tool_ms, 0) as tool_ms from r left join t using (agent_type)""",
    ),
    "gate_two_halves": (_gate, _gate_sql()),
    "gate_evidence": (_gate_evidence, _gate_evidence_sql()),
    "timeline": (
        _timeline,
        """with d as (select strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as generated_at, count(*) as calls, count(*) filter (k % 7 = 0) as errors from base group by 1)
        select generated_at, calls, errors, row_number() over w as position, calls - first_value(calls) over w as calls_from_first, calls - lag(calls) over w as calls_from_previous,
        errors - first_value(errors) over w as errors_from_first, errors - lag(errors) over w as errors_from_previous from d window w as (order by generated_at)""",
    ),
    "what_moved": (
        _ROUND(_moved, before=9, after=9, change=9),
        """with t as (select agent is null as main, count(*) as calls, count(*) filter (is_error) as errors, sum(duration_ms)::double as tool_ms,
            list_sort(list(duration_ms) filter (duration_ms is not null))[1 + round_even(0.95 * (count(duration_ms) - 1), 0)::int] as p95 from tool_calls group by 1),
        a as (select agent is null as main, sum(greatest(0, ts_last - ts))::double as model_ms from api_calls group by 1),
        s as (select t.main, errors::double / calls as error_rate, p95::double as p95, tool_ms / (tool_ms + model_ms) as busy from t join a on a.main = t.main),
        b as (select m.error_rate as e0, g.error_rate as e1, m.p95 as d0, g.p95 as d1, m.busy as s0, g.busy as s1 from s m, s g where m.main and not g.main),
        r as (select 'tool_error_rate' as metric, e0 as before, e1 as after, 0.01 as least, true as judged from b union all select 'duration_p95_ms', d0, d1, 1000.0, true from b union all select 'tool_share_of_busy_time', s0, s1, 0.01, false from b)
        select metric, round(before, 9) as before, round(after, 9) as after, round(after - before, 9) as change,
        case when abs(after - before) < least then 'flat' when not judged then null when after > before then 'worse' else 'better' end as verdict from r""",
    ),
    # one corpus against another
    "replication_by_session": (
        _T(replication.by_session),
        f"""with {UPPER}, {LOW},
        nx as (select session, is_error, lead(name) over s is not distinct from name and lead(args_shape) over s is not distinct from args_shape and lead(seq) over s is not null as retry from tool_calls window s as ({STREAM})),
        c as (select session, count(*) as calls, count(*) filter (is_error) as e, count(*) filter (is_error and retry) as r from nx group by 1),
        n as (select session, count(*) as streams from (select distinct session, agent from tool_calls) group by 1),
        hi as (select session, count(*) as k from (select distinct session, agent from runs where length >= 5) group by 1), lo as (select session, count(*) as k from (select distinct session, agent from low_runs where length >= 5) group by 1),
        d as (select session, count(*) as runs, count(*) filter (end_status = 'completed') as done from sessions where agent is not null group by 1)
        select session, calls, round(100 * (e::double / calls), 3) as error_pct, round(100 * ({_share("r", "e")}), 3) as retry_pct, round(100 * (coalesce(lo.k, 0)::double / streams), 3) as stuck_lower_pct,
        round(100 * (coalesce(hi.k, 0)::double / streams), 3) as stuck_upper_pct, round(100 * ({_share("coalesce(done, 0)", "runs")}), 3) as finished_pct
        from c join n using (session) left join hi using (session) left join lo using (session) left join d using (session)""",
    ),
    "bracket_position": (
        _ROUND(_bracket_position, lower_pct=9, upper_pct=9, exact_pct=9, position=9),
        f"""with {UPPER}, {LOW}, {EXACT}, n as (select (select count(*) from tool_calls)::double as calls, (select coalesce(sum(length), 0)::bigint from low_runs) as low, (select coalesce(sum(length), 0)::bigint from runs) as high, (select coalesce(sum(length), 0)::bigint from exact_runs) as exact),
        p as (select 100 * (low / calls) as lower_pct, 100 * (high / calls) as upper_pct, 100 * (exact / calls) as exact_pct from n)
        select round(lower_pct, 9) as lower_pct, round(upper_pct, 9) as upper_pct, round(exact_pct, 9) as exact_pct, round(case when upper_pct <> lower_pct then (exact_pct - lower_pct) / (upper_pct - lower_pct) end, 9) as position from p""",
    ),
    # workloads
    "asof_turn_split": (
        _turn_split,
        "select a.conv_id, a.turn, (select max(u.turn) from conversations u where u.conv_id = a.conv_id and u.role = 'user' and u.turn <= a.turn) as prompt_turn from conversations a where a.role = 'assistant'",
    ),
    "pre_gap": (
        lambda spark, d: workload.steps(trace(spark, d)).select("session", "agent", "uuid", "arrival_ts", "service_ms", "pre_gap_ms", "ready_ts"),
        """with e as (select t.api_uuid, max(t.ts_result) as tools_end from tool_calls t where not background and ts_result is not null and api_uuid is not null group by 1),
        c as (select a.*, greatest(ts_last, ts) as last, greatest(ts_last, ts, coalesce(tools_end, 0)) as ready_ts, s.t_start from api_calls a join sessions s on s.session = a.session and s.agent is not distinct from a.agent left join e on e.api_uuid = a.uuid where a.agent is not null),
        g as (select *, least(t_start, min(ts) over (partition by session, agent)) as arrival_ts from c)
        select session, agent, uuid::varchar as uuid, arrival_ts, greatest(last - ts, 1) as service_ms, greatest(ts - coalesce(lag(ready_ts) over (partition by session, agent order by ts, seq), arrival_ts), 0) as pre_gap_ms, ready_ts from g""",
    ),
    "turns_replayed": (lambda spark, d: workload.replay(trace(spark, d)).select("session", "agent", "turn", "n_steps", "latency_ms", "traced_ms"), None),
    "stream_replay_closed_form": (
        _replay,
        """with recursive o as (select o_custkey as stream, o_orderkey as job, date_diff('day', date '1992-01-01', o_orderdate::date) as arrival, o_orderkey % 90 as duration, row_number() over (partition by o_custkey order by date_diff('day', date '1992-01-01', o_orderdate::date), o_orderkey) as i from orders),
        r as (select stream, job, arrival, duration, i, arrival + duration as completion from o where i = 1 union all select o.stream, o.job, o.arrival, o.duration, o.i, greatest(o.arrival, r.completion) + o.duration from r join o on o.stream = r.stream and o.i = r.i + 1)
        select stream, job, arrival, duration, completion from r""",
    ),
    "replicate_workload": (_replicas, None),
    **{f"policy_select_{p}": (_select(p), _select_sql(p)) for p in workload.POLICIES},
    # shapes
    "dedup_first_wins": (_dedup, "select event_id, user_id, event_type, ms // 86400000 as day from base qualify row_number() over (partition by user_id, event_type, ms // 86400000 order by event_id) = 1"),
    "args_shape": (_shapes, "select 'k:i' as shape, count(*) as n from events"),
    "args_shape_varied": (
        _varied_shapes,
        """with v as (select event_id % 7 as i, length(props->>'$.k') as l from events)
        select case i when 0 then 'a3' when 1 then 's' || l when 2 then 'a:n,b:b,z:f' when 3 then 'n' when 4 then '-:i,deep:o2,s:s' || (l + 3) when 5 then 'f' else '' end as shape, count(*) as n from v group by 1""",
    ),
    "args_shape_spelling": (
        _spelled_shapes,
        """with v as (select event_id % 8 as i, length(props->>'$.k') as l from events)
        select case i when 0 then 'a:f' when 1 then 'a:i' when 2 then 'deep:o1' when 3 then 'a5' when 4 then 'a2' when 5 then 's' || l when 6 then 'big:i,e:f' else 'a:i,b:a1' end as shape,
               cast(case i when 3 then l + 3 when 4 then l when 5 then l else 0 end as bigint) as chars, i <> 0 as same, count(*) as n from v group by all""",
    ),
    "shape_vs_exact_bracket": (
        _bracket,
        """with s as (select count(*) as n from documents group by length(text)), e as (select count(*) as n from documents group by text)
        select (select count(*) from s) as shape_keys, (select coalesce(sum(n), 0)::bigint from s where n > 1) as shape_repeated, (select count(*) from e) as exact_keys, (select coalesce(sum(n), 0)::bigint from e where n > 1) as exact_repeated""",
    ),
    # raw transcripts and trajectories
    **raw.QUERIES,
    "trajectory_verdicts": (
        raw.adapted_verdicts,
        f"""with {raw.RECORDS}, calls as (select *, {raw.ARGS_SHAPE} as shape from acted where tool),
        runs_ as (select *, row_number() over (partition by agent order by ms, event_id) - row_number() over (partition by agent, action, shape order by ms, event_id) as run from calls),
        stuck as (select distinct agent from (select agent from runs_ group by agent, action, shape, run having count(*) >= 5)),
        ends as (select agent, chunk % 2 = 0 as resolved, count(*) filter (tool and seen and bad) > 0 as failed, chunk % 10 = 5 as looped from acted group by agent, chunk),
        told as (select 'stuck_run' as signal, agent in (select agent from stuck) as present, resolved from ends union all select 'tool_error', failed, resolved from ends union all select 'flagged_as_loop', looped, resolved from ends),
        c as (select signal, present, count(*) filter (resolved) as n, count(*) as of from told group by 1, 2),
        t as (select signal, coalesce(max(n) filter (present), 0) as n1, coalesce(max(of) filter (present), 0) as of1, coalesce(max(n) filter (not present), 0) as n0, coalesce(max(of) filter (not present), 0) as of0 from c group by 1),
        z as (select signal, {_z("n1", "of1", "n0", "of0")} as z from t)
        select signal, present, n, of, {_rate()}, round(z, 6) as z, round({_p("z")}, 6) as p from c join z using (signal)""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
