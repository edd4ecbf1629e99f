import json
import subprocess
import sys
from pathlib import Path

import pytest

from tracewright import cli, report
from tracewright.sources import events
from tracewright.streaming import live

ROOT = Path(__file__).resolve().parent.parent


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_live_views(spark, tmp_path):
    rows = [{"ev": "tool_call", "session": "s", "ts": 60_000 * m, "name": "Bash", "is_error": m % 2 == 0} for m in (0, 1, 2, 30, 200)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    log = live.follow_log(spark, str(tmp_path))
    final = drain(live.error_rates(log), "rates")
    assert [(r.calls, r.errors) for r in sorted(final, key=lambda r: r.window.start)][:2] == [(3, 2), (1, 1)]
    bursts = drain(live.sessions(log, "20 minutes"), "bursts")
    assert sorted(r.events for r in bursts) == [1, 3]


def test_appended_copies_of_lines_go(spark, tmp_path):
    line = {"uuid": "u1", "timestamp": "2025-01-01T00:00:00.000Z", "type": "user"}
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in (line, line | {"uuid": "u2"}, line)) + "\n")
    assert sorted(r.uuid for r in drain(live.first_lines(live.follow_lines(spark, str(tmp_path))), "lines")) == ["u1", "u2"]


def test_entry_imports_without_the_training_data_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "tracewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tracewright.llm" not in path.read_text(), path


def test_command_line_over_a_transcript_tree(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setenv("TRACEWRIGHT_SALT", "salt")
    tree = tmp_path / "tree" / "proj"
    tree.mkdir(parents=True)
    stamp = "2025-01-01T00:00:0{}.000Z"
    lines = [
        {"type": "user", "uuid": "u0", "timestamp": stamp.format(0), "message": {"content": "go"}},
        {"type": "assistant", "uuid": "a0", "timestamp": stamp.format(1), "message": {"id": "m", "content": [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"k": 1}}]}},
        {"type": "user", "uuid": "u1", "timestamp": stamp.format(3), "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "no"}]}},
    ]
    (tree / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    out = str(tmp_path / "out")
    assert cli.main(["export", str(tmp_path / "tree"), "--out", out]) == 0
    assert cli.main(["characterize", out, "--out", str(tmp_path / "stats")]) == 0
    assert json.loads((tmp_path / "stats" / "stats.json").read_text())["tool_latency"]["error_rate"] == 1.0
    found = str(tmp_path / "study.json")
    assert cli.main(["study", "report", "--trace", out, "--only", "errors", "--json", found]) == 0
    assert cli.main(["study", "report", "--trace", out, "--only", "errors", "--check", found]) == 0
    assert cli.main(["doctor", "--traces", out, "--json"]) == 0
    assert json.loads(capsys.readouterr().out.split("no drift\n")[-1])["tool_errors"] == 1
    assert cli.main(["over-time", "check", out, out]) == 0
    assert cli.main(["over-time", "check", out, str(tmp_path / "none")]) == 2
    track = str(tmp_path / "track.json")
    assert cli.main(["over-time", "track", out, out, "--json", track]) == 0
    assert cli.main(["over-time", "check", track, out]) == 0
    capsys.readouterr()
    assert cli.main(["over-time", "track", out]) == 0
    told = capsys.readouterr().out
    assert "one snapshot alone" in told and "| tool_error_rate | 100.0% |" in told and "- nothing by enough to tell" in told
    assert cli.main(["doctor", "--root", str(tmp_path / "tree"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["tool_errors"] == 1
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["files_vanished"] == 0
    assert cli.main(["replay", out]) == 0
    table = str(tmp_path / "all.snapshots")
    for _ in range(2):  # repeated, it leaves one row
        assert cli.main(["over-time", "record", out, "--table", table]) == 0
    assert len(cli._table(spark, table)) == 1
    told, direct = cli._snapshot(spark, table), cli._snapshot(spark, out)
    assert told["label"] == "out" and {k: told[k] for k in direct if k != "by_agent_type"} == {k: v for k, v in direct.items() if k != "by_agent_type"}
    assert cli.main(["over-time", "check", table, out]) == 0
    shared = str(tmp_path / "shared.json")
    assert cli.main(["doctor", "--traces", out, "--share", shared]) == 0
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert json.loads(Path(shared).read_text())["tool_version"] == manifest["tool_version"] and manifest["duration_s"] > 0
    (tree / "s.jsonl").write_text(json.dumps({"type": "brand-new", "uuid": "z"}) + "\n")
    assert cli.main(["export", str(tmp_path / "tree"), "--out", str(tmp_path / "out2")]) == 2
    assert cli.main(["export", str(tmp_path / "tree"), "--out", str(tmp_path / "out3"), "--allow-unknown"]) == 0


def test_a_timeline_tells_what_moved_and_ranks_agent_types():
    types = {"few": {"runs": 3, "unaccounted": 1, "unresolvable": 0, "resolvable_runs": 3, "unaccounted_resolvable": 1, "tool_ms": 100}, "many": {"runs": 4, "unaccounted": 4, "unresolvable": 4, "resolvable_runs": 0, "unaccounted_resolvable": 0, "tool_ms": 0}}
    snap = lambda label, **more: {"label": label, "agents": 7, "resolvable_runs": 3, "by_agent_type": types} | more
    moved = [
        {"metric": "tool_error_rate", "change": 0.02, "verdict": "worse"},
        {"metric": "duration_p95_ms", "change": -999.0, "verdict": "flat"},
        {"metric": "cache_read_share_p50", "change": -0.5, "verdict": None},
        {"metric": "never_returned_rate", "change": None, "verdict": None},
    ]
    text = report.render_timeline([snap("a", tool_error_rate=0.1), snap("b", tool_error_rate=0.12)], moved)
    assert "| tool_error_rate | 10.0% | 12.0% |" in text and "| duration_p50_ms | n/a | n/a |" in text
    assert "- tool_error_rate rose by 2.0% (worse)" in text and "- cache_read_share_p50 fell by 50.0% (reported only)" in text
    assert "duration_p95_ms fell" not in text and "4 of the last snapshot's runs" in text
    assert text.index("| many | 4 | 4 | 4 | n/a |") < text.index("| few | 3 | 1 | 0 | 33.3% |")


def test_the_first_malformed_line_is_named(spark, tmp_path, monkeypatch):
    log = tmp_path / "events.jsonl"
    good = json.dumps({"ev": "tool_call", "session": "s", "ts": 1, "name": "x" * 40, "status": "matched", "duration_ms": 5})
    lines = [good, ""] * 400
    log.write_text("\n".join(lines) + "\n")
    assert events.first_malformed(spark, str(log)) is None
    lines[700], lines[750] = '{"ev": "tool_', "{"
    log.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        file, at = events.first_malformed(spark, str(log))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert file.endswith("events.jsonl") and at == 701
    monkeypatch.setattr(cli, "session", lambda: spark)
    with pytest.raises(ValueError, match="events.jsonl:701: malformed JSON"):
        cli.main(["study", "report", "--trace", str(tmp_path), "--only", "errors"])


def test_places_in_a_log_of_several_files_are_unique(spark, tmp_path):
    folder = tmp_path / "a log.jsonl"
    folder.mkdir()
    for name in ("part b", "part a"):
        (folder / f"{name}.json").write_text("\n".join(json.dumps({"ev": "prompt", "session": name, "ts": i}) for i in range(3)) + "\n")
    rows = events.read_jsonl(spark, str(folder)).prompts.orderBy("seq").collect()
    assert [(r.session, r.ts) for r in rows] == [(f, i) for f in ("part a", "part b") for i in range(3)]
    assert len({r.seq for r in rows}) == 6


def test_manifests_stand_in_the_store_of_their_log(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    events.write_manifest(spark, {"label": "é"}, folder)
    assert events.read_manifest(spark, folder) == {"label": "é"} and events.read_manifest(spark, f"{folder}/none") == {}
    (tmp_path / "log" / "manifest.json").write_text("{")
    assert events.read_manifest(spark, folder, tolerate_corrupt=True) == {}
