"""Command line: export, characterize, doctor, study, over-time, workload."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewright import report
from tracewright.plans import overtime, workload
from tracewright.sources import events, trajectories, transcripts
from tracewright.storage import new_path, scratch

TABLE = ".snapshots"
SALT = os.path.expanduser("~/.config/tracewright/salt")


def session() -> SparkSession:
    return SparkSession.builder.appName("tracewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _print(value: dict, path: str | None) -> None:
    text = json.dumps(value, indent=2, sort_keys=True, default=str) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def _export(spark: SparkSession, root: str, out: str | None):
    """(trace, manifest) of transcripts, written below ``out`` or where the caller's scratch is.
    What is written on the way goes with the scratch."""
    started = time.monotonic()
    if not events.exists(spark, root):
        raise FileNotFoundError(f"no transcripts at {root}")
    salt = events.load_or_create_salt(SALT, os.environ.get("TRACEWRIGHT_SALT"))
    listed = transcripts.list_files(spark, root)
    done = transcripts.export(spark, root, salt)
    at = f"{out or new_path(spark, 'export')}/events"
    events.write_table(done.trace, at)
    trace = events.read_table(spark, at)
    done = transcripts.Export(trace.events, done.anomalies, done.counts)
    vanished = len(listed - transcripts.list_files(spark, root))
    manifest = transcripts.manifest(done, root, salt, datetime.now(UTC).isoformat(timespec="seconds"), transcripts.count_journals(spark, root), vanished=vanished, duration_s=round(time.monotonic() - started, 2))
    if out:
        events.write_manifest(spark, manifest, out)
    return trace, manifest


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    with scratch(spark), scratch(spark):  # the narrow rows are written to keep, so into the outer one
        _, manifest = _export(spark, a.root, a.out)
    odd = manifest["anomalies"]
    print(f"{manifest['files']} files, {sum(manifest['events_by_type'].values())} events -> {a.out}")
    if any(odd[k] for k in ("unknown_line_types", "unknown_system_subtypes")) and not a.allow_unknown:
        print(f"unknown kinds: {odd['unknown_line_types']} {odd['unknown_system_subtypes']}", file=sys.stderr)
        return 2
    return 0


def characterize(spark: SparkSession, a: argparse.Namespace) -> int:
    stats = report.characterization(events.open_log(spark, a.traces), events.read_manifest(spark, a.traces))
    if a.out:
        os.makedirs(a.out, exist_ok=True)
        _print(stats, f"{a.out}/stats.json")
        with open(f"{a.out}/report.md", "w", encoding="utf-8") as f:
            f.write(report.render_tree("Workload", stats))
    else:
        _print(stats, None)
    return 0


def doctor(spark: SparkSession, a: argparse.Namespace) -> int:
    """Findings of a log, or of transcripts exported once on the fly and not kept."""
    with scratch(spark), scratch(spark):
        if a.traces:
            trace, manifest = events.open_log(spark, a.traces, "lenient"), events.read_manifest(spark, a.traces, True)
        else:
            trace, manifest = _export(spark, a.root, None)
        if a.share:
            _print(report.shareable(trace, manifest), a.share)
            with open(a.share, encoding="utf-8") as f:
                sys.stdout.write(f.read())
        elif a.json:
            _print(report.findings(trace), None)
        else:
            sys.stdout.write(report.render_findings(trace))
    return 0


def study(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        found = report.study_report(events.open_log(spark, a.trace), tuple(a.only) if a.only else None)
    except (PySparkException, Py4JJavaError) as e:  # the latter from jobs side by side
        log = next((p for p in (f"{a.trace}/events.jsonl", a.trace) if p.endswith((".jsonl", ".json")) and events.exists(spark, p)), None)
        bad = events.first_malformed(spark, log) if log else None
        if bad:
            raise ValueError(f"{bad[0]}:{bad[1]}: malformed JSON") from e
        raise
    if a.check:
        with open(a.check, encoding="utf-8") as f:
            moved = report.drift(json.load(f), json.loads(json.dumps(found, default=str)))
        print("\n".join(moved) or "no drift")
        return 1 if moved else 0
    if a.json:
        _print(found, a.json)
        sys.stdout.write(report.render_headlines(found))
    else:
        sys.stdout.write(report.render_tree("Study", found))
    return 0


def adapt(spark: SparkSession, a: argparse.Namespace) -> int:
    done = trajectories.adapter(a.adapter)(spark, a.inputs, exact=a.shape == "exact", limit_per_file=a.limit, only_actions=tuple(a.only_actions) if a.only_actions else None)
    events.write_table(trajectories.checked(done.trace), f"{a.out}/events")
    counters = {r["counter"]: r["n"] for r in done.counters.collect()}
    kinds = {r[0]: r[1] for r in events.read_table(spark, f"{a.out}/events").events.groupBy("ev").count().collect()}
    events.write_manifest(spark, {"schema_version": 1, "adapter": a.adapter, "shape_mode": a.shape, "events_by_type": kinds | counters, "provenance": {"sources": a.inputs, "only_actions": a.only_actions}}, a.out)
    return 0


def _table(spark: SparkSession, path: str) -> list[dict]:
    """Snapshots of a table in any store, by time."""
    rows = overtime.read_snapshots(spark, path).orderBy(F.expr("try_to_timestamp(generated_at)").asc_nulls_last(), "ord").drop("ord", "snapshot_id").collect()
    return [r.asDict() | {"by_agent_type": json.loads(r.by_agent_type or "{}")} for r in rows]


def record(spark: SparkSession, a: argparse.Namespace) -> int:
    """Snapshots of logs into a table; one of the same name and time is replaced."""
    for path in a.logs:
        manifest = events.read_manifest(spark, path, tolerate_corrupt=True)
        overtime.write_snapshot(events.open_log(spark, path, "lenient"), a.table, os.path.basename(path.rstrip("/")), manifest.get("generated_at"))
    return 0


def _snapshot(spark: SparkSession, path: str) -> dict:
    """A snapshot from a log, a snapshot file, or the last of a track file or of a table,
    whose name ends in ``.snapshots``."""
    if path.rstrip("/").endswith(TABLE):
        return _table(spark, path)[-1]
    if path.endswith(".json") and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        return held["snapshots"][-1] if "snapshots" in held else held
    manifest = events.read_manifest(spark, path, tolerate_corrupt=True)
    return report.snapshot(events.open_log(spark, path, "lenient"), os.path.basename(path.rstrip("/")), manifest.get("generated_at"))


def _frame(spark: SparkSession, snapshots: list[dict]):
    names = [k for k, v in snapshots[0].items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    rows = [(s.get("label"), s.get("generated_at"), i, *[None if s.get(n) is None else float(s[n]) for n in names]) for i, s in enumerate(snapshots)]
    return spark.createDataFrame(rows, "label string, generated_at string, ord int, " + ", ".join(f"`{n}` double" for n in names))


def track(spark: SparkSession, a: argparse.Namespace) -> int:
    """Snapshots in order of time: as text, or with all their figures as JSON."""
    snapshots = [s for p in a.snapshots for s in (_table(spark, p) if p.rstrip("/").endswith(TABLE) else [_snapshot(spark, p)])]
    watched = [c for c in overtime.WATCHED if c in snapshots[0]]
    rows = [r.asDict() for r in overtime.timeline(_frame(spark, snapshots), tuple(watched)).orderBy("position").collect()]
    ordered = [snapshots[r["ord"]] for r in rows]
    kinds = {c: overtime.WATCHED[c] for c in watched}
    moved = [r.asDict() for r in overtime.what_moved(*(_frame(spark, [s]) for s in (ordered[0], ordered[-1])), kinds).collect()]
    if a.json:
        _print({"snapshots": snapshots, "timeline": rows, "moved": moved}, a.json)
    else:
        sys.stdout.write(report.render_timeline(ordered, moved))
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    """0 without regressions, 1 with, 2 where a snapshot can't be read."""
    try:
        base, current = (overtime.validate(_frame(spark, [_snapshot(spark, p)]).selectExpr("*")) for p in (a.baseline, a.current))
        rows = [r.asDict() for r in overtime.gate(base, current, a.tolerance).collect()]
    except Exception as e:
        print(f"can't compare: {e}", file=sys.stderr)
        return 2
    if a.json:
        _print({"regressions": [r for r in rows if r["regressed"]], "skipped": [r["metric"] for r in rows if r["skipped"]], "metrics": rows}, a.json)
    else:
        sys.stdout.write(report.render_gate(rows))
    return int(any(r["regressed"] for r in rows))


def replay(spark: SparkSession, a: argparse.Namespace) -> int:
    """Replay at unlimited capacity, and its error against the log."""
    done = workload.replay(events.open_log(spark, a.traces))
    row = workload.fidelity(done).first().asDict()
    _print({"turns_compared": row["n"], "abs_rel_error": row}, a.json)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, within=sub) -> argparse.ArgumentParser:
        p = within.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        p.set_defaults(run=run)
        return p

    p = command("export", export)
    p.add_argument("root")
    p.add_argument("--out", required=True)
    p.add_argument("--allow-unknown", action="store_true")
    p = command("characterize", characterize)
    p.add_argument("traces")
    p.add_argument("--out")
    p = command("doctor", doctor)
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("--traces")
    where.add_argument("--root")
    p.add_argument("--json", action="store_true")
    p.add_argument("--share")
    inner = sub.add_parser("study").add_subparsers(required=True)
    p = command("report", study, inner)
    p.add_argument("--trace", required=True)
    p.add_argument("--only", nargs="*")
    p.add_argument("--json")
    p.add_argument("--check")
    p = command("adapt", adapt, inner)
    p.add_argument("adapter")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--shape", choices=("shape", "exact"), default="shape")
    p.add_argument("--limit", type=int)
    p.add_argument("--only-actions", nargs="*")
    inner = sub.add_parser("over-time").add_subparsers(required=True)
    p = command("record", record, inner)
    p.add_argument("logs", nargs="+")
    p.add_argument("--table", required=True, help=f"a folder in any store, its name ending in {TABLE}")
    p = command("track", track, inner)
    p.add_argument("snapshots", nargs="+")
    p.add_argument("--json")
    p = command("check", check, inner)
    p.add_argument("baseline")
    p.add_argument("current")
    p.add_argument("--tolerance", type=float, default=overtime.TOLERANCE)
    p.add_argument("--json")
    p = command("replay", replay)
    p.add_argument("traces")
    p.add_argument("--json")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
