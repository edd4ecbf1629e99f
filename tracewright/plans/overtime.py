"""Movement over time: snapshots of a log, timelines of snapshots, and a regression gate."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.stats import Z95, rounded_rank, share, two_proportion_z, two_sided_p, wilson_bound
from tracewright.plans.doctor import ACCOUNTED, POINTS
from tracewright.schema import Trace

LONG_MS = 60_000
UNTYPED = "(untyped)"
COUNTS = "agents unaccounted resolvable_runs unaccounted_resolvable tool_calls never_returned tool_errors".split()

#: metric: (numerator, denominator, the direction that is worse).
PROPORTIONS = {
    "unaccounted_resolvable_rate": ("unaccounted_resolvable", "resolvable_runs", 1),
    "never_returned_rate": ("never_returned", "tool_calls", 1),
    "tool_error_rate": ("tool_errors", "tool_calls", 1),
}
#: metric: the least change that counts.
THRESHOLDS = {"duration_p50_ms": 1000.0, "duration_p95_ms": 1000.0, "longtail_share_60s": 0.01}
UNGATED = ("unaccounted_rate", "tool_share_of_busy_time", "cache_read_share_p50")
#: What a timeline shows: metric, its unit, and the direction that is worse if it has one.
WATCHED: dict[str, tuple[str, int | None]] = {
    "unaccounted_rate": ("rate", None),
    "unaccounted_resolvable_rate": ("rate", 1),
    "never_returned_rate": ("rate", 1),
    "tool_error_rate": ("rate", 1),
    "longtail_share_60s": ("rate", 1),
    "duration_p50_ms": ("ms", 1),
    "duration_p95_ms": ("ms", 1),
    "duration_p99_ms": ("ms", 1),
    "tool_share_of_busy_time": ("rate", None),
    "cache_read_share_p50": ("rate", None),
}
TOLERANCE = 0.1
MOVED = {"rate": 0.01, "ms": 1000.0}


def _resolvable() -> Column:
    """Whether a run's outcome can be recorded at all: workflow workers' can't."""
    return F.col("workflow").isNull()


def _unaccounted() -> Column:
    return ~F.coalesce(F.col("end_status").isin(*ACCOUNTED), F.lit(False))


def snapshot(trace: Trace) -> DataFrame:
    """One row of counters, rates and quantiles of a log."""
    events = trace.events.where(F.col("ev").isin("session", "tool_call", "api_call"))
    is_ = lambda kind: F.col("ev") == kind
    agent = is_("session") & F.col("agent").isNotNull()
    call, api = is_("tool_call"), is_("api_call")
    ms = F.when(call, F.col("duration_ms"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = events.agg(
        F.count_if(is_("session") & F.col("agent").isNull()).alias("sessions"),
        F.count_if(agent).alias("agents"),
        F.count_if(agent & _unaccounted()).alias("unaccounted"),
        F.count_if(agent & _resolvable()).alias("resolvable_runs"),
        F.count_if(agent & _resolvable() & _unaccounted()).alias("unaccounted_resolvable"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & ~F.coalesce(F.col("status") == "matched", F.lit(False))).alias("never_returned"),
        F.count_if(call & F.coalesce("is_error", F.lit(False))).alias("tool_errors"),
        total(ms).alias("tool_ms_total"),
        total(F.when(api & F.col("ts").isNotNull() & F.col("ts_last").isNotNull(), F.greatest(F.lit(0), F.col("ts_last") - F.col("ts")))).alias("model_ms_total"),
        total(F.when(ms >= LONG_MS, ms)).alias("_long_ms"),
        *[total(F.when(api, F.col("usage")[k])).alias(f"tokens_{k}") for k in ("in", "out", "cache_read", "cache_create")],
    )
    known = F.col("usage.in").isNotNull() & F.col("usage.cache_read").isNotNull() & F.col("usage.cache_create").isNotNull()
    whole = F.col("usage.in") + F.col("usage.cache_read") + F.col("usage.cache_create")
    shares = F.when(known & (whole > 0), F.col("usage.cache_read") / whole)
    both = F.when(call, F.struct(F.lit("duration").alias("of"), ms.cast("double").alias("v"))).when(api, F.struct(F.lit("cache").alias("of"), shares.alias("v")))
    found = rounded_rank(events.select(both.alias("_x")).where("_x.v is not null").select("_x.of", "_x.v"), "v", POINTS, ("of",))
    of = lambda name, p: F.max(F.when(F.col("of") == name, F.col(f"p{p}")))
    ranks = found.agg(
        *[F.coalesce(of("duration", p).cast("long"), F.lit(0)).alias(f"duration_p{p}_ms") for p in (50, 95, 99)],
        F.coalesce(of("cache", 50), F.lit(0.0)).alias("cache_read_share_p50"),
    )
    return sums.crossJoin(ranks).select(  # one row each
        *[c for c in sums.columns if c != "_long_ms"],
        *ranks.columns,
        share(F.col("_long_ms"), F.col("tool_ms_total")).alias("longtail_share_60s"),
        share(F.col("unaccounted"), F.col("agents")).alias("unaccounted_rate"),
        share(F.col("unaccounted_resolvable"), F.col("resolvable_runs")).alias("unaccounted_resolvable_rate"),
        share(F.col("never_returned"), F.col("tool_calls")).alias("never_returned_rate"),
        share(F.col("tool_errors"), F.col("tool_calls")).alias("tool_error_rate"),
        share(F.col("tool_ms_total"), F.col("tool_ms_total") + F.col("model_ms_total")).alias("tool_share_of_busy_time"),
    )


def by_agent_type(trace: Trace) -> DataFrame:
    """Runs, outcomes, tool time and run time by agent type.

    Tool time goes by agent id alone, and by the last session event of that id.
    """
    kind = F.coalesce(F.nullif("agent_type", F.lit("")), F.lit(UNTYPED))
    agents = trace.sessions.where("agent is not null").withColumn("agent_type", kind)
    spent = F.when(F.col("t_start").isNotNull() & F.col("t_end").isNotNull(), F.greatest(F.lit(0), F.col("t_end") - F.col("t_start")))
    runs = agents.groupBy("agent_type").agg(
        F.count("*").alias("runs"),
        F.count_if(_unaccounted()).alias("unaccounted"),
        F.count_if(~_resolvable()).alias("unresolvable"),
        F.count_if(_resolvable()).alias("resolvable_runs"),
        F.count_if(_resolvable() & _unaccounted()).alias("unaccounted_resolvable"),
        F.coalesce(F.sum(spent), F.lit(0)).alias("runtime_ms"),
    )
    type_of = agents.groupBy("agent").agg(F.max_by("agent_type", "seq").alias("agent_type"))
    tool_ms = trace.tool_calls.where("agent is not null and duration_ms is not null").groupBy("agent").agg(F.sum("duration_ms").alias("ms"))
    per_type = tool_ms.join(type_of, "agent").groupBy("agent_type").agg(F.sum("ms").alias("tool_ms"))
    return runs.join(per_type, "agent_type", "left").withColumn("tool_ms", F.coalesce("tool_ms", F.lit(0)))


def types_by_unaccounted(trace: Trace) -> DataFrame:
    """Agent types by runs without a recorded outcome, most first, then by name."""
    order = Window.orderBy(F.desc("unaccounted"), "agent_type")  # a row per agent type
    rate = F.when(F.col("resolvable_runs") > 0, F.col("unaccounted_resolvable") / F.col("resolvable_runs"))
    return by_agent_type(trace).select(F.row_number().over(order).alias("rank"), "agent_type", "runs", "unaccounted", rate.alias("resolvable_rate"))


def validate(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` unchanged; running it raises at a negative count or one above its whole."""
    inside = F.lit(True)
    for c in COUNTS:
        inside = inside & (F.col(c) >= 0)
    for part, whole, _ in PROPORTIONS.values():
        inside = inside & (F.col(part) <= F.col(whole))
    checked = F.when(inside & (F.col("unaccounted") <= F.col("agents")), F.col("agents")).otherwise(F.raise_error(F.lit("not a valid snapshot")).cast("long"))
    return snapshots.withColumn("agents", checked)


def timeline(snapshots: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Metrics of each snapshot with its change from the first and from the one before.

    In order of ``generated_at``, missing or unreadable times last, then as given
    (``ord``).  A change from or to a null is null.
    """
    at = F.expr("try_to_timestamp(generated_at)")
    order = Window.partitionBy().orderBy(at.asc_nulls_last(), "ord")  # as many rows as snapshots
    rows = snapshots.withColumn("position", F.row_number().over(order))
    for m in metrics:
        rows = rows.withColumns({f"{m}_from_first": F.col(m) - F.first(m).over(order), f"{m}_from_previous": F.col(m) - F.lag(m).over(order)})
    return rows


def what_moved(first: DataFrame, last: DataFrame, kinds: dict[str, tuple[str, int | None]]) -> DataFrame:
    """metric, before, after, change, verdict.  ``kinds`` gives each metric's unit (rate or
    ms) and the direction that is worse, if any; changes under the unit's floor are ``flat``
    and a metric without a direction gets no verdict."""
    rows = None
    both = first.select(*[F.col(m).cast("double").alias(f"b_{m}") for m in kinds]).crossJoin(last.select(*[F.col(m).cast("double").alias(f"a_{m}") for m in kinds]))  # one row each
    entries = []
    for m, (unit, worse) in kinds.items():
        change = F.col(f"a_{m}") - F.col(f"b_{m}")
        verdict = F.when(change.isNull(), None).when(F.abs(change) < MOVED[unit], "flat")
        verdict = verdict.otherwise(F.lit(None).cast("string")) if worse is None else verdict.when(change * worse > 0, "worse").otherwise("better")
        entries.append(F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after"), change.alias("change"), verdict.alias("verdict")))
    rows = both.select(F.explode(F.array(*entries)).alias("r"))
    return rows.select("r.*")


def gate(base: DataFrame, current: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """metric, rule, base, current, z, p, both sides' 95% intervals in percent, gated, skipped,
    regressed of two one-row snapshots.

    A proportion regresses if it is worse and the difference is significant; a threshold
    metric if it grew by over ``tolerance`` and by its least change at least.  A zero
    denominator skips its metric.  Other metrics are reported only.
    """
    names = sorted({*THRESHOLDS, *UNGATED, *[c for p in PROPORTIONS.values() for c in p[:2]]})
    side = lambda df, s: df.select(*[F.col(c).cast("double").alias(f"{s}_{c}") for c in names])
    both = side(base, "b").crossJoin(side(current, "c"))  # one row each
    null, no = F.lit(None).cast("double"), F.lit(False)
    ci = lambda n, of: [F.round(100 * wilson_bound(n, of, sign), 3) for sign in (-1, 1)]
    sides = ("base_lo_pct", "base_hi_pct", "current_lo_pct", "current_hi_pct")

    def row(metric: str, rule: str, b: Column, c: Column, z: Column, gated: bool, skipped: Column, bad: Column, bounds: list[Column] | None = None) -> Column:
        evidence = [F.when(z.isNotNull(), x).otherwise(null).alias(n) for x, n in zip(bounds or [null] * 4, sides, strict=True)]
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(rule).alias("rule"), b.alias("base"), c.alias("current"), z.alias("z"), two_sided_p(z).alias("p"), *evidence, F.lit(gated).alias("gated"), skipped.alias("skipped"), F.coalesce(bad, no).alias("regressed")
        )

    entries = []
    for m, (n, of, worse) in PROPORTIONS.items():
        b_n, b_of, c_n, c_of = (F.col(x) for x in (f"b_{n}", f"b_{of}", f"c_{n}", f"c_{of}"))
        malformed = F.coalesce((b_of <= 0) | (c_of <= 0) | (b_n > b_of) | (c_n > c_of) | (b_n < 0) | (c_n < 0), F.lit(True))
        z = F.when(~malformed, two_proportion_z(c_n, c_of, b_n, b_of))
        entries.append(row(m, "proportion", share(b_n, b_of), share(c_n, c_of), z, True, malformed, ~malformed & (z * worse > Z95), [*ci(b_n, b_of), *ci(c_n, c_of)]))
    for m, floor in THRESHOLDS.items():
        b, c = F.col(f"b_{m}"), F.col(f"c_{m}")
        entries.append(row(m, "threshold", b, c, null, True, b.isNull() | c.isNull(), (c > b * (1 + tolerance)) & (F.abs(c - b) >= floor)))
    for m in UNGATED:
        entries.append(row(m, "report", F.col(f"b_{m}"), F.col(f"c_{m}"), null, False, no, no))
    return both.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def snapshot_id(label: str, generated_at: str | None) -> str:
    """The name that a snapshot has in a table: equal for equal label and time."""
    return "s" + hashlib.sha256(json.dumps([label, generated_at]).encode()).hexdigest()[:16]  # a letter first, so that no reader takes it for a number


def write_snapshot(trace: Trace, path: str, label: str, generated_at: str | None) -> None:
    """A log's snapshot into the table at ``path``, a folder of its own in it: a snapshot of
    the same label and time is replaced, so a run that is repeated leaves one row."""
    kinds = by_agent_type(trace)
    types = kinds.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent_type", F.struct(*[c for c in kinds.columns if c != "agent_type"])))))).alias("by_agent_type"))  # a row per type
    row = snapshot(trace).crossJoin(types).withColumns({"label": F.lit(label), "generated_at": F.lit(generated_at).cast("string"), "snapshot_id": F.lit(snapshot_id(label, generated_at))})  # one row each
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of a table written by :func:`write_snapshot`, with ``ord`` to part those of one time."""
    return validate(spark.read.option("mergeSchema", True).parquet(path).withColumn("snapshot_id", F.col("snapshot_id").cast("string")).withColumn("ord", F.col("snapshot_id")))
