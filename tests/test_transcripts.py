"""Export of a small transcript tree with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import VERSION
from tracewright.functions.shapes import keyed_token, token
from tracewright.sources import rendered, transcripts

SECRET = "never-in-the-log"


def stamp(ms):
    return f"2025-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}Z"


def line(kind, ms, uuid=None, **more):
    base = {"type": kind, "timestamp": stamp(ms), "sessionId": "s1", "cwd": f"/home/{SECRET}", "gitBranch": "main", "version": "1.0", "isSidechain": False}
    return base | ({"uuid": uuid} if uuid else {}) | more


def said(ms, uuid, msg, *blocks, **message):
    return line("assistant", ms, uuid, requestId="r1", message={"id": msg, "model": "m", "content": list(blocks)} | message)


def result(ms, uuid, use, content="ok", error=False):
    return line("user", ms, uuid, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": use, "content": content, "is_error": error}]})


def use(id_, name="Bash", **args):
    return {"type": "tool_use", "id": id_, "name": name, "input": args}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    agents = root / "proj" / "s1" / "subagents"
    (agents / "wf_x").mkdir(parents=True)
    main = [
        line("user", 500, "u0", message={"role": "user", "content": f"please {SECRET}"}),
        said(1000, "a1", "m1", {"type": "thinking", "thinking": "hmm"}),
        line("queue-operation", 1200, operation="enqueue", content="abc"),
        said(1500, "a2", "m1", {"type": "text", "text": "hello"}),
        said(2000, "a3", "m1", use("t1", command="x" * 15, description="y" * 10), usage={"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 11}),
        result(5000, "u1", "t1", [{"type": "text", "text": "four"}]),
        said(1000, "a1", "m1", {"type": "thinking", "thinking": "hmm"}),  # appended again
        line("queue-operation", 1200, operation="enqueue", content="abc"),
        result(5100, "u2", "t1", "late"),  # nothing waits for it any more
        said(6000, "a4", "m2", use("t2", "Agent", prompt="p", run_in_background=True), use("t3", "Agent", n=1.5, deep={"k": [1]}, none=None)),
        result(6500, "u3", "t3"),
        result(6600, "u4", "t2", "started"),
        line("user", 9000, "u5", message={"content": "<task-notification><task-id>agent-aa</task-id><status> failed </status></task-notification>"}),
        line("system", 9100, "y1", subtype="turn_duration", durationMs=8000, messageCount=3),
        line("system", 9200, "y2", subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 99}),
        line("system", 9300, "y3", subtype="brand_new"),
        line("summary", 9400),
        said(9500, "a5", "m3", use("t4", command="z")),
        {"timestamp": stamp(9600)},
    ]
    text = "\n".join(json.dumps(x) for x in main) + "\n\n{broken\n[1]\n"
    (root / "proj" / "s1.jsonl").write_text(text)
    for hex_, folder, meta in (("aa", agents, {"toolUseId": "t2", "agentType": "kind", "spawnDepth": 1}), ("bb", agents, {"toolUseId": "t3"}), ("cc", agents / "wf_x", None)):
        (folder / f"agent-{hex_}.jsonl").write_text(json.dumps(said(7000, f"{hex_}1", f"{hex_}m", {"type": "text", "text": "x"})) + "\n")
        (folder / f"agent-{hex_}.meta.json").write_text(json.dumps(meta) if meta else "{nope")
    (agents / "journal.jsonl").write_text("{}\n")
    out = transcripts.export(spark, str(root), "salt")
    return out, [r.asDict(True) for r in out.events.orderBy("seq").collect()], str(root)


def of(done, kind):
    return [e for e in done[1] if e["ev"] == kind]


def test_lines_of_one_message_are_one_call(done):
    first = next(e for e in of(done, "api_call") if e["uuid"] == "a1")
    assert (first["ts_last"] - first["ts"], first["request_id"], first["model"]) == (1000, "r1", "m")
    assert first["blocks"] == {"text": 1, "text_chars": 5, "thinking": 1, "thinking_chars": 3, "tool_use": 1, "other": 0}
    assert (first["usage"]["in"], first["usage"]["out"], first["usage"]["cache_read"], first["usage"]["cache_create"]) == (5, 7, 11, None)
    assert len([e for e in of(done, "api_call") if e["agent"] is None]) == 3


def test_calls_match_results_orphans_and_the_unmatched(done):
    calls = [(e["id"], e["status"], e["duration_ms"]) for e in of(done, "tool_call")]
    assert calls == [("t1", "matched", 3000), ("t1", "orphan_result", None), ("t3", "matched", 500), ("t2", "matched", 600), ("t4", "unmatched", None)]
    t1, orphan, t3, t2, _ = of(done, "tool_call")
    assert (t1["args_shape"], t1["api_uuid"], t1["api_message_id"], t1["result_chars"]) == ("command:s15,description:s10", "a3", "m1", 4)
    assert (orphan["name"], orphan["ts"], orphan["result_chars"]) == (None, None, 4)
    assert t3["args_shape"] == "deep:o1,n:f,none:n"
    assert (t2["background"], t3["background"], t2["spawned_agent"], t3["spawned_agent"]) == (True, False, "aa", "bb")


def test_outcomes_follow_their_precedence(done):
    ends = {e["agent"]: e for e in of(done, "session") if e["agent"]}
    assert {a: e["end_status"] for a, e in ends.items()} == {"aa": "failed", "bb": "completed", "cc": "unknown"}
    assert (ends["aa"]["agent_type"], ends["aa"]["spawn_depth"], ends["aa"]["background"]) == ("kind", 1, True)
    assert ends["cc"]["workflow"] == "wf_x"


def test_session_counts_and_order(done):
    main = next(e for e in of(done, "session") if e["agent"] is None)
    assert (main["n_lines"], main["n_duplicate_lines"], main["n_orphan_results"], main["versions"]) == (21, 2, 1, ["1.0"])
    assert main["line_types"]["assistant"] == 5
    assert done[1][0] == main
    assert [e["op"] for e in of(done, "queue_op")] == ["enqueue"]
    assert [e["text_chars"] for e in of(done, "prompt")] == [len(f"please {SECRET}")]
    assert [(e["agent_ref"], e["status"]) for e in of(done, "notification")] == [("aa", "failed")]
    assert [e["duration_ms"] for e in of(done, "turn")] == [8000] and [e["pre_tokens"] for e in of(done, "compact")] == [99]


def test_no_content_survives_and_oddities_are_listed(spark, done):
    assert SECRET not in json.dumps(done[1])
    m = transcripts.manifest(done[0], done[2], "salt", "2025-01-01T00:00:00+00:00", transcripts.count_journals(spark, done[2]))
    assert m["anomalies"]["parse_errors"] == 2
    assert m["anomalies"]["unknown_system_subtypes"] == {"brand_new": 1} and m["anomalies"]["unknown_line_types"] == {"<no type>": 1}
    assert (m["files"], m["sessions"], m["agents"], m["journals_skipped"], m["duplicate_lines"]) == (4, 1, 3, 1, 2)
    assert m["corpus_id"].startswith("t_") and len(m["corpus_id"]) == 14
    assert m["tool_version"] == VERSION and m["versions_seen"] == ["1.0"] and m["orphan_tool_results"] == 1
    assert m["lines_by_type"] == {"assistant": 8, "queue-operation": 1, "summary": 1, "system": 3, "user": 6}
    assert m["events_by_type"] == {kind: len(of(done, kind)) for kind in {e["ev"] for e in done[1]}}


def test_a_manifest_names_a_bounded_number_of_kinds(done):
    rows = {(r["section"], r["key"]): r["n"] for r in transcripts.tallies(done[0], named=2).collect()}
    types = {k: n for (section, k), n in rows.items() if section == "lines_by_type"}
    assert types == {"assistant": 8, "user": 6, "<others>": 5}


def text_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_content_is_read_once_and_never_moves(spark, done, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text(json.dumps(line("user", 1, "u", message={"content": "x"})) + "\n")
    cut = transcripts.cut_lines(transcripts.read_lines(spark, str(tmp_path)))
    assert "variant" not in cut.schema.simpleString() and "value" not in cut.columns
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan and plan.count("try_parse_json") + plan.count("parse_json(") <= 4
    for table in (done[0].events, done[0].anomalies, done[0].counts):
        told = text_of(table)
        assert "text" not in [r.rsplit(" ", 1)[-1] for r in told.splitlines() if "Relation" in r]
        assert "variant" not in told.lower()


def test_what_branches_share_is_read_once(spark):
    """A line and its usage are parsed once, not for each column that reads them."""
    plan = text_of(transcripts.cut_lines(spark.createDataFrame([("f", 1, "{}")], "file string, line long, value string")))
    assert plan.count("from_json(") == 1 and plan.count("try_parse_json(") + plan.count("parseJson(") <= 2


def test_rendered_lines_are_dealt_to_tasks_however_few_splits_a_table_has(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as event_id", "timestamp_millis(1000 * id) as ts", "id % 40 as user_id", "'x' as event_type", "1.5D as value", "'{\"k\": ' || id % 100 || '}' as props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    lines = rendered.transcript_lines(spark, str(tmp_path))
    held = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(held) == 4 and max(r.n for r in held) < 2 * min(r.n for r in held)


def test_lines_are_rendered_by_compiled_code(spark, tmp_path):
    """No line is written inside a lambda, which Spark interprets."""
    rows = spark.range(8).selectExpr("id as event_id", "timestamp_millis(id) as ts", "id as user_id", "'x' as event_type", "1D as value", "'{\"k\": 1}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert "lambda" not in text_of(rendered.transcript_lines(spark, str(tmp_path)))


def test_a_bare_string_in_a_list_hides_no_notification(spark):
    """Strings that aren't a block's text are passed over, and nothing else with them."""
    note = "<task-notification><task-id>agent-aa</task-id><status>killed</status></task-notification>"
    contents = [["bare", {"type": "text", "text": note}], [{"type": "text", "text": note}, 5, [note]], [{"type": "text", "text": {"deep": note}}, note]]
    rows = spark.createDataFrame([("f", i, json.dumps({"type": "user", "message": {"content": c}})) for i, c in enumerate(contents)], "file string, line long, value string")
    found = {r.line: ([n.status for n in r.notes], r.is_prompt) for r in transcripts.cut_lines(rows).collect()}
    assert found == {0: (["killed"], False), 1: (["killed"], False), 2: ([], True)}


def test_places_of_lines_follow_the_file_through_its_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    texts = [json.dumps({"type": "summary", "uuid": str(i)}) for i in range(3000)]
    (tmp_path / "p" / "s.jsonl").write_text("\n\n".join(texts) + "\n")
    (tmp_path / "p" / "t.jsonl").write_text("\n".join(texts[:5]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = transcripts.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        rows = lines.orderBy("file", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert [r.value for r in rows] == texts + texts[:5] and len({(r.file, r.line) for r in rows}) == 3005


def test_no_plan_shows_the_salt(spark):
    df = spark.createDataFrame([("/home",), ("",), (None,)], "cwd string").select(token(F.col("cwd"), "very-secret-salt").alias("t"))
    assert "very-secret-salt" not in df._jdf.queryExecution().toString()
    assert [r.t for r in df.collect()] == [keyed_token("/home", "very-secret-salt"), None, None]


def test_files_that_go_during_an_export_are_told(spark, tmp_path):
    tree = tmp_path / "proj"
    tree.mkdir()
    for name in ("s1", "s2"):
        (tree / f"{name}.jsonl").write_text(json.dumps(line("user", 1, name, message={"content": "x"})) + "\n")
    listed = transcripts.list_files(spark, str(tmp_path))
    lines = transcripts.read_lines(spark, str(tmp_path))
    (tree / "s2.jsonl").unlink()
    assert [r.session for r in lines.collect()] == ["s1"]
    assert len(listed - transcripts.list_files(spark, str(tmp_path))) == 1
