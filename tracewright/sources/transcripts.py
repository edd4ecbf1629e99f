"""Raw session transcripts to the content-free event log.

A transcript tree holds ``<project>/<session>.jsonl`` for main threads and
``<project>/<session>/subagents/**/agent-<hex>.jsonl`` for agents, with a
``agent-<hex>.meta.json`` beside each.  Lines are read and parsed once, where they lie, and
cut to narrow rows of ids, sizes, shapes and numbers before anything is shuffled; those are
written to the shared folder, and re-appended lines go, messages are merged, calls matched
with results, and runs given an outcome by windows and joins over them.  Nothing of content
survives but shapes, sizes, ids and numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright import VERSION
from tracewright.functions.shapes import args_shape, content_chars, is_string, keyed_token, parsed, string_of, summed_chars, token
from tracewright.operators.ordering import running
from tracewright.schema import SCHEMA_VERSION, Trace, event_schema
from tracewright.storage import materialize

#: The transcript format's line types, system subtypes, and final statuses.
HANDLED_TYPES = ("user", "assistant", "system", "queue-operation")
IGNORED_TYPES = (
    "attachment mode last-prompt permission-mode ai-title bridge-session file-history-snapshot file-history-delta agent-name "
    "frame-link summary progress custom-title pr-link relocated worktree-state agent-setting"
).split()
HANDLED_SUBTYPES = ("turn_duration", "compact_boundary")
IGNORED_SUBTYPES = (
    "away_summary local_command stop_hook_summary model_refusal_fallback scheduled_task_fire informational bridge_status model_consent_fallback"
).split()
TERMINAL = ("completed", "failed", "killed")

FILE_KEY = ["project_dir", "session", "agent_hex", "file"]
END = 1 << 40
#: Kinds, versions and oddities that a manifest names for each of its counters; what is rarer is summed as OTHERS.
NAMED = 1000
OTHERS = "<others>"


def _struct(fields: str) -> str:
    return f"struct<{','.join(f'{f}:variant' for f in fields.split())}>"


#: What is looked at of a line, its message and a content block, each read in one pass; null for what isn't an object.
LINE = _struct(
    "type uuid timestamp operation parentUuid isSidechain cwd gitBranch entrypoint version subtype origin requestId effort isMeta durationMs messageCount "
    "pendingBackgroundAgentCount compactMetadata content"
)
MESSAGE = _struct("id model stop_reason usage")
BLOCK = _struct("type id tool_use_id name input is_error text thinking content")
USAGE = "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>, service_tier string, speed string"


def _in(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _get(path: str, kind: str = "string", of: str | Column = "v") -> Column:
    return F.try_variant_get(_in(of), f"$.{path}", kind)


def _text(path: str, of: str | Column = "v") -> Column:
    """A string at ``path``, null where the value is of another type."""
    return F.when(is_string(_value(path, of)), _get(path, of=of))


def _is_true(value: Column) -> Column:
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def _value(path: str, of: str | Column = "v") -> Column:
    return _get(path, "variant", of)


def _relative(root: str) -> Column:
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring_index(path, plain + "/", -1)


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(project_dir, session, agent_hex, file, line, value): non-blank lines of transcripts.

    ``line`` is unique in the file and grows with the place in it, however the file was
    split: a row stands behind the first byte of its split by its number in the task that
    read it, and a split never holds more rows than bytes.  No line moves for it.
    """
    raw = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", True).load(root)
    found = raw.select("value", _relative(root).alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("line"))
    agent = r"^([^/]+)/([^/]+)/subagents/(?:.*/)?agent-([^/]+)\.jsonl$"
    main = r"^([^/]+)/([^/]+)\.jsonl$"
    is_agent, is_main = F.rlike("file", F.lit(agent)), F.rlike("file", F.lit(main))
    part = lambda i: F.when(is_agent, F.regexp_extract("file", agent, i)).otherwise(F.regexp_extract("file", main, i))
    kept = found.where((is_agent | is_main) & F.rlike("value", F.lit(r"\S")))
    return kept.select(part(1).alias("project_dir"), part(2).alias("session"), F.when(is_agent, F.regexp_extract("file", agent, 3)).alias("agent_hex"), "file", "line", "value")


def read_metas(spark: SparkSession, root: str) -> DataFrame:
    """One row per agent meta file; unreadable ones have null fields."""
    raw = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json").option("wholetext", True).load(root)
    pattern = r"^([^/]+)/([^/]+)/subagents/(?:(.*)/)?agent-([^/]+)\.meta\.json$"
    rows = raw.select(_relative(root).alias("file"), parsed(F.col("value")).alias("v")).where(F.rlike("file", F.lit(pattern)))
    folder = F.substring_index(F.regexp_extract("file", pattern, 3), "/", -1)
    return rows.select(
        F.regexp_extract("file", pattern, 1).alias("project_dir"),
        F.regexp_extract("file", pattern, 2).alias("session"),
        F.regexp_extract("file", pattern, 4).alias("agent_hex"),
        _text("agentType").alias("agent_type"),
        F.nullif(_text("toolUseId"), F.lit("")).alias("tool_use_id"),
        _get("spawnDepth", "int").alias("spawn_depth"),
        _text("model").alias("model"),
        _text("effort").alias("effort"),
        F.when(folder.startswith("wf_"), folder).alias("workflow"),
        "file",
    )


def count_journals(spark: SparkSession, root: str) -> int:
    """Workflow journals: listed, never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "journal.jsonl").load(root)
    return files.select(F.col("path")).where(F.contains("path", F.lit("/subagents/"))).count()


def list_files(spark: SparkSession, root: str) -> set[str]:
    """Paths of the transcripts below ``root`` as the store lists them now."""
    return set(spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).inputFiles())


@dataclass(frozen=True)
class Export:
    """The event log, what was odd in the transcripts, and what the manifest counts."""

    events: DataFrame
    anomalies: DataFrame
    counts: DataFrame

    @property
    def trace(self) -> Trace:
        return Trace(self.events)


def cut_lines(lines: DataFrame) -> DataFrame:
    """Each line as a narrow row: the columns of ``lines`` but ``value``, and what the export
    reads of it.  ``ok`` says whether it is a JSON object.

    Of a key that an object repeats the last value stands; a line beyond a variant's size
    isn't ``ok``.
    """
    # What several columns read is a column first, so that no branch works it out again.
    read = lines.withColumn("_plain", F.try_parse_json("value")).withColumn("v", parsed(F.col("value"), F.col("_plain"))).withColumn("_line", F.try_variant_get("v", "$", LINE))
    of, message = (lambda name: F.col("_line")[name]), (lambda name: F.col("_message")[name])
    read = read.withColumns({"type": string_of(of("type")), "_message": _get("message", MESSAGE)})
    kind = F.col("type")
    user, spoken = kind == "user", kind.isin("assistant", "user")
    read = read.withColumns(
        {
            "_blocks": _typed(F.when(spoken, _get("message.content", "array<variant>"))),
            "_usage": F.when((kind == "assistant") & F.try_variant_get(message("usage"), "$", "struct<x:variant>").isNotNull(), F.from_json(F.to_json(message("usage")), USAGE)),
        }
    )
    read = read.withColumn("_string", F.when(user & F.col("_blocks").isNull(), _text("message.content")))
    listed = F.array_join(F.filter(F.transform("_blocks", lambda p: string_of(p["b"]["text"])), lambda t: F.length(t) > 0), "\n")
    read = read.withColumn("_bodies", F.when(user, F.regexp_extract_all(F.coalesce(listed, "_string"), F.lit(r"(?s)<task-notification>(.*?)</task-notification>"), F.lit(1))))
    has_result = F.exists("_blocks", lambda p: p["kind"] == "tool_result")
    u = F.col("_usage")
    tokens = F.struct(
        u["input_tokens"].alias("in"),
        u["output_tokens"].alias("out"),
        u["cache_read_input_tokens"].alias("cache_read"),
        u["cache_creation_input_tokens"].alias("cache_create"),
        u["cache_creation"]["ephemeral_5m_input_tokens"].alias("cache_create_5m"),
        u["cache_creation"]["ephemeral_1h_input_tokens"].alias("cache_create_1h"),
        u["service_tier"].alias("service_tier"),
        u["speed"].alias("speed"),
    )
    told = lambda flag: F.coalesce(flag, F.lit(False))
    said = lambda c: F.when(kind == "assistant", c)
    return read.select(
        *[c for c in lines.columns if c != "value"],
        F.col("_line").isNotNull().alias("ok"),
        "type",
        string_of(of("uuid")).alias("uuid"),
        F.unix_millis(F.try_to_timestamp(string_of(of("timestamp")))).alias("ts"),
        string_of(of("operation")).alias("op"),
        F.try_variant_get(of("parentUuid"), "$", "string").alias("parent_uuid"),
        _is_true(of("isSidechain")).alias("sidechain"),
        *[string_of(of(field)).alias(name) for field, name in (("cwd", "cwd"), ("gitBranch", "git_branch"), ("entrypoint", "entrypoint"), ("version", "version"), ("subtype", "subtype"), ("origin", "origin"))],
        F.col("_message").isNotNull().alias("has_message"),
        said(string_of(message("id"))).alias("message_id"),
        F.when(spoken, F.try_variant_get(message("id"), "$", "string")).alias("api_message_id"),
        said(string_of(of("requestId"))).alias("request_id"),
        said(string_of(of("effort"))).alias("effort"),
        said(string_of(message("model"))).alias("model"),
        said(string_of(message("stop_reason"))).alias("stop_reason"),
        F.when(u.isNotNull(), tokens).alias("usage"),
        F.filter(F.transform("_blocks", lambda p, at: F.when(p["b"].isNotNull(), _block(p["b"], p["kind"], at))), lambda b: b.isNotNull()).alias("blocks"),
        F.transform("_bodies", _notice).alias("notes"),
        told(user & ~told(has_result) & ~told(F.size("_bodies") > 0) & ~_is_true(of("isMeta"))).alias("is_prompt"),
        F.when(user, F.coalesce(summed_chars(F.col("_blocks")), F.length("_string"), F.lit(0)).cast("long")).alias("text_chars"),
        *[F.try_variant_get(of(field), "$", "bigint").alias(name) for field, name in (("durationMs", "duration_ms"), ("messageCount", "message_count"), ("pendingBackgroundAgentCount", "pending_background_agents"))],
        _text("trigger", of("compactMetadata")).alias("trigger"),
        _get("preTokens", "bigint", of("compactMetadata")).alias("pre_tokens"),
        F.when(kind == "queue-operation", content_chars(of("content"))).alias("content_chars"),
    )


def _typed(parts: Column) -> Column:
    """Each member of a list as (x, b, kind): itself, its fields and its type where it is an object."""
    read = F.transform(parts, lambda x: F.struct(x.alias("x"), F.try_variant_get(x, "$", BLOCK).alias("b")))
    return F.transform(read, lambda p: F.struct(F.when(p["b"].isNull(), p["x"]).alias("x"), p["b"].alias("b"), string_of(p["b"]["type"]).alias("kind")))


def _block(b: Column, kind: Column, at: Column) -> Column:
    """What is kept of a content block whose fields are those of :data:`BLOCK`."""
    is_use, is_result = kind == "tool_use", kind == "tool_result"
    said = F.when(kind == "text", F.length(string_of(b["text"]))).when(kind == "thinking", F.length(string_of(b["thinking"])))
    return F.struct(
        at.alias("at"),
        kind.alias("kind"),
        F.when(is_use, string_of(b["id"])).when(is_result, string_of(b["tool_use_id"])).alias("id"),
        F.when(is_use, F.coalesce(F.nullif(F.try_variant_get(b["name"], "$", "string"), F.lit("")), F.lit("?"))).alias("name"),
        F.when(is_use, F.coalesce(args_shape(b["input"]), F.lit("n"))).alias("args_shape"),
        F.when(is_use, _is_true(_value("run_in_background", b["input"]))).otherwise(False).alias("background"),
        F.when(is_result, _is_true(b["is_error"])).otherwise(False).alias("is_error"),
        F.coalesce(F.when(is_result, content_chars(b["content"])).otherwise(said.cast("long")), F.lit(0)).alias("chars"),
    )


def _notice(body: Column, at: Column) -> Column:
    """What is kept of a notification's text."""
    tag = lambda name: F.nullif(F.trim(F.regexp_extract(body, rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    return F.struct(at.alias("at"), F.regexp_replace(tag("task-id"), "^agent-", "").alias("agent_ref"), tag("tool-use-id").alias("tool_use_id"), tag("status").alias("status"))


def mark_copies(cut: DataFrame) -> DataFrame:
    """``cut`` with ``_first`` and ``_op_first``: false for what was appended again.  Lines
    that can't be copies are partitions of their own."""
    is_op = F.coalesce(F.col("type") == "queue-operation", F.lit(False)) & F.col("ts").isNotNull()
    by_uuid = Window.partitionBy("file", "uuid", F.when(F.col("uuid").isNull(), F.col("line"))).orderBy("line")
    marked = cut.withColumn("_first", F.row_number().over(by_uuid) == 1)
    known = is_op & F.col("_first")
    by_op = Window.partitionBy("file", F.when(known, F.coalesce("op", F.lit("?"))), F.when(known, F.col("ts")), F.when(~known, F.col("line"))).orderBy("line")
    return marked.withColumn("_op_first", F.row_number().over(by_op) == 1)


def _split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.where("ok"), marked.where("not ok").select("file", "line", F.lit("parse_error").alias("kind"), F.lit("").alias("key"))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrow rows with their marks; lines that aren't JSON objects)."""
    return _split(mark_copies(cut_lines(lines)))


def merge_messages(lines: DataFrame) -> DataFrame:
    """Model calls: neighbouring assistant lines of one message id are one call.

    A user or system line ends a message; queue operations and ignored lines don't.  A line
    without a message object neither joins nor ends one.  A call is placed where the
    message ended.
    """
    flush = F.col("type").isin("user", "system")
    rows = lines.where(flush | ((F.col("type") == "assistant") & F.col("has_message")))
    order = Window.partitionBy("file").orderBy("line")
    opens = ~flush & (F.col("message_id").isNull() | ~F.lag("message_id").over(order).eqNullSafe(F.col("message_id")))
    rows = rows.withColumn("_opens", opens)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"_group": F.sum(F.col("_opens").cast("int")).over(order), "_end": F.coalesce(F.first(F.when(F.col("_opens") | flush, F.col("line")), ignorenulls=True).over(later), F.lit(END))})
    of = lambda kind: F.filter("blocks", lambda b: b["kind"] == kind)
    n = lambda blocks: F.coalesce(F.size(blocks), F.lit(0))
    chars = lambda kind: F.aggregate(of(kind), F.lit(0).cast("long"), lambda t, b: t + b["chars"])
    other = n(F.col("blocks")) - n(of("text")) - n(of("thinking")) - n(of("tool_use"))
    sizes = {"text": n(of("text")), "text_chars": chars("text"), "thinking": n(of("thinking")), "thinking_chars": chars("thinking"), "tool_use": n(of("tool_use")), "other": other}
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line")))
    merged = rows.where(~flush).groupBy(*FILE_KEY, "_group").agg(
        F.min_by(F.struct("ts", "uuid", "parent_uuid", "sidechain"), "line").alias("_f"),
        F.max_by("_end", "line").alias("line"),
        F.first("message_id").alias("message_id"),
        last("ts").alias("ts_last"),
        *[last(name).alias(name) for name in ("request_id", "effort", "model", "stop_reason", "usage")],
        F.struct(*[F.coalesce(F.sum(size), F.lit(0)).alias(name) for name, size in sizes.items()]).alias("blocks"),
    )
    return merged.select(*FILE_KEY, "line", F.lit(-1).alias("_at"), "_f.*", "message_id", "ts_last", "request_id", "effort", "model", "stop_reason", "blocks", "usage")


def tool_blocks(lines: DataFrame) -> DataFrame:
    """Tool uses and results, one row each."""
    wanted = F.filter("blocks", lambda b: b["kind"].isin("tool_use", "tool_result"))
    said = lines.where("type in ('assistant', 'user')").select(*FILE_KEY, "line", "type", "ts", "uuid", "sidechain", "api_message_id", F.explode(wanted).alias("b"))
    return said.select(*FILE_KEY, "line", "type", "ts", "uuid", "sidechain", "api_message_id", "b.*")


def match_tools(blocks: DataFrame) -> DataFrame:
    """Tool calls: uses and results of an id alternate within a file.

    A result matches if what came before it for that id is a use; else it is an orphan.  A
    use is unmatched if nothing follows it, and dropped if another use does.
    """
    is_result = F.col("kind") == "tool_result"
    use = F.struct("ts", "name", "args_shape", F.col("uuid").alias("api_uuid"), "api_message_id", "background", "sidechain")
    order = Window.partitionBy("file", "id").orderBy("line", "at")
    both = blocks.where("id is not null").withColumn("use", F.when(~is_result, use))
    both = both.withColumns({"_before": F.lag("use").over(order), "_after": F.lead("kind").over(order)})
    matched = is_result & F.col("_before").isNotNull()
    status = F.when(matched, "matched").when(is_result, "orphan_result").otherwise("unmatched")
    used = F.when(matched, F.col("_before")).when(~is_result, F.col("use"))
    rows = both.where(is_result | F.col("_after").isNull()).withColumns({"status": status, "_use": used})
    flag = lambda c: F.coalesce(F.col(f"_use.{c}"), F.lit(False)).alias(c)
    return rows.select(
        *FILE_KEY,
        F.when(is_result, F.col("line")).otherwise(F.lit(END + 1) + F.col("line")).alias("line"),
        F.col("at").alias("_at"),
        F.col("_use.ts").alias("ts"),
        F.when(is_result, F.col("ts")).alias("ts_result"),
        F.when(is_result, F.col("ts") - F.col("_use.ts")).alias("duration_ms"),
        "id",
        *[F.col(f"_use.{c}").alias(c) for c in ("name", "args_shape", "api_uuid", "api_message_id")],
        "is_error",
        F.when(is_result, F.col("chars")).otherwise(0).alias("result_chars"),
        flag("background"),
        flag("sidechain"),
        "status",
    )


def find_notifications(lines: DataFrame) -> DataFrame:
    found = lines.where("type = 'user'").select(*FILE_KEY, "line", "ts", F.explode("notes").alias("n"))
    return found.select(*FILE_KEY, "line", (F.col("n.at") + 10_000).alias("_at"), "ts", "n.agent_ref", "n.tool_use_id", "n.status")


def find_prompts(lines: DataFrame) -> DataFrame:
    """User lines that carry no result and no notification and aren't meta."""
    return lines.where("is_prompt").select(*FILE_KEY, "line", F.lit(20_000).alias("_at"), "ts", "uuid", "parent_uuid", "text_chars", "origin", "sidechain")


def find_marks(lines: DataFrame) -> dict[str, DataFrame]:
    """Turns, compactions and queue operations."""
    at = [*FILE_KEY, "line", F.lit(0).alias("_at"), "ts"]
    return {
        "turn": lines.where("type = 'system' and subtype = 'turn_duration'").select(*at, "duration_ms", "message_count", "pending_background_agents"),
        "compact": lines.where("type = 'system' and subtype = 'compact_boundary'").select(*at, "trigger", "pre_tokens"),
        "queue_op": lines.where("type = 'queue-operation' and ts is not null").select(*at, "op", "content_chars"),
    }


def session_events(marked: DataFrame, tools: DataFrame, salt: str) -> DataFrame:
    """One session event per file, lines that couldn't be read counted among its lines."""
    kept = F.col("ok") & F.col("_first") & F.col("_op_first")
    typed = kept & F.col("type").isNotNull()
    first = lambda name: F.min_by(name, F.when(typed & F.col(name).isNotNull(), F.col("line"))).alias(name)
    per_file = marked.groupBy(*FILE_KEY).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("ok") & ~(F.col("_first") & F.col("_op_first"))).alias("n_duplicate_lines"),
        F.min(F.when(typed, F.col("ts"))).alias("t_start"),
        F.max(F.when(typed, F.col("ts"))).alias("t_end"),
        first("cwd"),
        first("git_branch"),
        first("entrypoint"),
        F.array_sort(F.collect_set(F.when(typed, F.col("version")))).alias("versions"),
    )
    types = marked.where(typed).groupBy("file", "type").agg(F.count("*").alias("n")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("line_types"))
    lost = tools.where("status = 'orphan_result'").groupBy("file").agg(F.count("*").alias("n_orphan_results"))
    joined = per_file.join(types, "file", "left").join(lost, "file", "left")
    return joined.select(
        *FILE_KEY,
        F.lit(-1).cast("long").alias("line"),
        F.lit(0).alias("_at"),
        F.col("t_start").alias("ts"),
        "t_start",
        "t_end",
        token(F.col("project_dir"), salt).alias("project"),
        token(F.col("cwd"), salt).alias("cwd"),
        token(F.col("git_branch"), salt).alias("git_branch"),
        "entrypoint",
        "versions",
        "n_lines",
        "n_duplicate_lines",
        F.coalesce("n_orphan_results", F.lit(0)).alias("n_orphan_results"),
        F.coalesce("line_types", F.create_map().cast("map<string,bigint>")).alias("line_types"),
    )


def with_outcomes(sessions: DataFrame, metas: DataFrame, tools: DataFrame, uses: DataFrame, notifications: DataFrame) -> DataFrame:
    """Agents' session events with meta and end status.

    A final notification of the agent wins, then one of its spawning call; else the spawn's
    result means completed if the spawn waited; else the outcome is unknown.
    """
    unit = ["project_dir", "session"]
    order = F.struct(F.col("agent_hex").isNotNull(), "file", "line", "_at")
    final = notifications.where(F.col("status").isin(*TERMINAL))
    by_hex = final.where("agent_ref is not null").groupBy(*unit, F.col("agent_ref").alias("agent_hex")).agg(F.max_by("status", order).alias("_by_hex"))
    by_tool = final.where("tool_use_id is not null").groupBy(*unit, "tool_use_id").agg(F.max_by("status", order).alias("_by_tool"))
    returned = tools.where("status = 'matched'").select(*unit, F.col("id").alias("tool_use_id")).distinct().withColumn("_returned", F.lit(True))
    spawns = uses.groupBy(*unit, F.col("id").alias("tool_use_id")).agg(F.max_by("background", order).alias("_background"))
    agents = sessions.where("agent_hex is not null").join(metas.drop("file"), [*unit, "agent_hex"], "left")
    joined = agents.join(by_hex, [*unit, "agent_hex"], "left")
    for table in (by_tool, returned, spawns):
        joined = joined.join(table, [*unit, "tool_use_id"], "left")
    background = F.coalesce("_background", F.lit(False))
    status = F.coalesce("_by_hex", "_by_tool", F.when(~background & F.coalesce("_returned", F.lit(False)), "completed"), F.lit("unknown"))
    done = joined.withColumns({"background": background, "end_status": status, "spawned_by_tool_use": F.col("tool_use_id")}).drop("_by_hex", "_by_tool", "_returned", "_background", "tool_use_id")
    return sessions.where("agent_hex is null").unionByName(done, allowMissingColumns=True)


def export(spark: SparkSession, root: str, salt: str) -> Export:
    """The event log of the transcripts below ``root``."""
    return export_lines(read_lines(spark, root), read_metas(spark, root), salt)


def export_lines(lines: DataFrame, metas: DataFrame, salt: str) -> Export:
    """The event log of lines as :func:`read_lines` gives them, and of agents' metas.

    The lines' narrow rows, numbered within their file, and the metas are written to the
    shared folder at once; all else is a plan over them.  They hold working directories as they stand, so an
    export that is not kept belongs into a :func:`~tracewright.storage.scratch`.
    """
    number = F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("long")
    marked = materialize(mark_copies(cut_lines(lines).withColumn("line", number)), "lines", keep=True)
    metas = materialize(metas, "metas", keep=True)
    numbered, broken = _split(marked)
    kept = numbered.where("_first and _op_first")
    api_calls = merge_messages(kept)
    blocks = tool_blocks(kept)
    tools = match_tools(blocks)
    uses = blocks.where("kind = 'tool_use' and type = 'assistant'").withColumn("_at", F.col("at"))
    notifications = find_notifications(kept)
    spawned = metas.where("tool_use_id is not null").groupBy("project_dir", "session", F.col("tool_use_id")).agg(F.max_by("agent_hex", "file").alias("_hex"))
    notifications = notifications.join(spawned, ["project_dir", "session", "tool_use_id"], "left").withColumn("agent_ref", F.coalesce("agent_ref", "_hex")).drop("_hex")
    tools = tools.join(spawned.withColumnsRenamed({"tool_use_id": "id", "_hex": "spawned_agent"}), ["project_dir", "session", "id"], "left")
    sessions = with_outcomes(session_events(marked, tools, salt), metas, tools, uses, notifications)
    prompts = find_prompts(kept)
    marks = find_marks(kept)

    kinds = {"session": sessions, "api_call": api_calls.where("ts is not null"), "tool_call": tools, "notification": notifications, "prompt": prompts.where("ts is not null"), **marks}
    fields = [f for f in event_schema() if f.name not in ("ev", "session", "agent")]
    events = None
    for kind, rows in kinds.items():
        have = set(rows.columns)
        wide = rows.select(
            F.lit(kind).alias("ev"),
            *FILE_KEY,
            F.col("line").cast("long").alias("_line"),
            F.col("_at").cast("int").alias("_at"),
            *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields],
        )
        events = wide if events is None else events.unionByName(wide)
    files = marked.groupBy(*FILE_KEY).agg(F.lit(1).alias("_one"))
    files = running(files, [F.col("project_dir"), F.col("session"), F.col("agent_hex").isNotNull(), F.col("file")], {"_file_no": F.col("_one")}, keep=True)
    in_file = F.row_number().over(Window.partitionBy("file").orderBy("_line", "_at"))
    numbered_events = events.withColumn("_in_file", in_file).join(files.select("file", "_file_no"), "file")
    seq = F.shiftleft(F.col("_file_no").cast("long"), 32) + F.col("_in_file")
    out = numbered_events.withColumns({"seq": seq, "agent": F.col("agent_hex")}).select(*[f.name for f in event_schema()], "seq")
    return Export(out, anomalies(kept, broken, api_calls, prompts), counts(marked))


def anomalies(kept: DataFrame, broken: DataFrame, api_calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """(file, line, kind, key) of what the format's allow-lists don't know."""
    odd = lambda rows, kind, key: rows.select("file", "line", F.lit(kind).alias("kind"), key.alias("key"))
    known = [*HANDLED_TYPES, *IGNORED_TYPES]
    no_message = ~F.col("has_message")
    subtype = F.col("subtype")
    known_subtype = F.coalesce(subtype.isin(*HANDLED_SUBTYPES, *IGNORED_SUBTYPES), F.lit(False))
    found = broken.unionByName(odd(kept.where(F.col("type").isNull()), "unknown_line_type", F.lit("<no type>")))
    for part in (
        odd(kept.where(~F.col("type").isin(*known)), "unknown_line_type", F.col("type")),
        odd(kept.where((F.col("type") == "assistant") & no_message), "unknown_line_type", F.lit("assistant:<no message>")),
        odd(kept.where((F.col("type") == "system") & ~known_subtype), "unknown_system_subtype", F.coalesce(subtype, F.lit("<no subtype>"))),
        odd(api_calls.where("ts is null"), "missing_timestamp", F.lit("api_call")),
        odd(prompts.where("ts is null"), "missing_timestamp", F.lit("prompt")),
        odd(kept.where("type = 'queue-operation' and ts is null"), "missing_timestamp", F.lit("queue_op")),
    ):
        found = found.unionByName(part)
    return found


def counts(lines: DataFrame) -> DataFrame:
    """One row: files, sessions, agents."""
    files = lines.groupBy("file").agg(F.max(F.col("agent_hex").isNotNull().cast("int")).alias("_agent"))
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("_agent") == 0).alias("sessions"), F.count_if(F.col("_agent") == 1).alias("agents"))


def tallies(done: Export, named: int = NAMED) -> DataFrame:
    """(section, key, n): the manifest's counters in one plan.

    Of each section the ``named`` most counted keys stand, ties by key; the rest is summed
    under ``<others>``, as kinds and versions are named by the input without a bound.
    """
    sessions = done.trace.sessions
    row = lambda section, key, n: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    entries = lambda section, column, key, n: F.transform(column, lambda e: row(section, key(e), n(e)))
    of_session = F.flatten(
        F.array(
            entries("lines_by_type", F.map_entries("line_types"), lambda e: e["key"], lambda e: e["value"]),
            entries("versions_seen", F.col("versions"), lambda v: v, lambda v: F.lit(1)),
            F.array(row("totals", F.lit("duplicate_lines"), F.col("n_duplicate_lines")), row("totals", F.lit("orphan_tool_results"), F.col("n_orphan_results"))),
        )
    )
    found = sessions.select(F.inline(of_session))
    found = found.unionByName(done.events.select(F.lit("events_by_type").alias("section"), F.col("ev").alias("key"), F.lit(1).cast("long").alias("n")))
    found = found.unionByName(done.anomalies.select(F.col("kind").alias("section"), "key", F.lit(1).cast("long").alias("n")))
    files = done.counts.select(F.inline(F.array(*[row("totals", F.lit(c), F.col(c)) for c in ("files", "sessions", "agents")])))
    summed = found.unionByName(files).groupBy("section", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    return summed.withColumn("key", F.when(place <= named, F.col("key")).otherwise(OTHERS)).groupBy("section", "key").agg(F.sum("n").alias("n"))


def manifest(done: Export, root: str, salt: str, generated_at: str, journals: int = 0, samples: int = 8, vanished: int = 0, duration_s: float | None = None) -> dict:
    """The export's counters as a plain dictionary, of a bounded size: see :func:`tallies`.
    Reads the log once written and the narrow rows, never the transcripts again."""
    held: dict[str, dict[str, int]] = {}
    for r in tallies(done).orderBy("section", "key").collect():
        held.setdefault(r["section"], {})[r["key"]] = r["n"]
    totals = held.get("totals", {})
    return {
        "schema_version": SCHEMA_VERSION,
        "tool_version": VERSION,
        "corpus_id": keyed_token("corpus", salt),
        "root": keyed_token(root, salt),
        "generated_at": generated_at,
        "duration_s": duration_s,
        **{c: totals.get(c, 0) for c in ("files", "sessions", "agents")},
        "files_vanished": vanished,
        "journals_skipped": journals,
        "duplicate_lines": totals.get("duplicate_lines", 0),
        "orphan_tool_results": totals.get("orphan_tool_results", 0),
        "lines_by_type": held.get("lines_by_type", {}),
        "events_by_type": held.get("events_by_type", {}),
        "versions_seen": sorted(held.get("versions_seen", {})),
        "anomalies": {
            "unknown_line_types": held.get("unknown_line_type", {}),
            "unknown_system_subtypes": held.get("unknown_system_subtype", {}),
            "missing_timestamps": held.get("missing_timestamp", {}),
            "parse_errors": sum(held.get("parse_error", {}).values()),
            "samples": [f"{r['kind']} {r['key']}".strip() for r in done.anomalies.orderBy("file", "line").limit(samples).collect()],
        },
    }
