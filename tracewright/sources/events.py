"""Reading and writing event logs."""

from __future__ import annotations

import json
import os
import secrets

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.shapes import parsed
from tracewright.schema import Trace, event_schema

MODES = {"strict": "FAILFAST", "lenient": "DROPMALFORMED"}
#: Bits of ``seq`` for the place in a file; those above it number the files.
FILE_BITS = 41


def _store(spark: SparkSession, path: str):
    """(file system, path) of the store that a path's scheme names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    store, at = _store(spark, path)
    return store.exists(at)


def _one_slash(path: str) -> Column:
    """Local paths as one spelling: they are listed with three slashes and read with one."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_jsonl(spark: SparkSession, path: str, mode: str = "strict") -> Trace:
    """An event log of JSON lines.

    ``strict`` raises at a malformed line; ``lenient`` leaves it out.  ``seq`` is unique and
    grows with the place in the file, whatever its splits, and from file to file by path: a
    row stands behind the first byte of its split by its number in the task that read it,
    and a split never holds more rows than bytes.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no event log at {path}: export one first")
    reader = spark.read.schema(event_schema()).option("mode", MODES[mode])
    rows = reader.json(path)
    files = spark.createDataFrame(list(enumerate(sorted(rows.inputFiles()))), "_file_no long, _file string").withColumn("_file", _one_slash("_file"))
    placed = rows.select("*", _one_slash("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_at"))
    numbered = placed.join(files, "_file", "left")
    known = F.coalesce("_file_no", F.raise_error(F.lit("a row of a file that was not listed")).cast("long"))
    return Trace(numbered.select(*rows.columns, (F.shiftleft(known, FILE_BITS) + F.col("_at")).alias("seq")))


def first_malformed(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(file, line) of the first line of a log that isn't JSON; None where all are.

    Lines are counted in each split, and a split's first bad line stands behind the lines of
    the file's splits before it; no line is moved.  It is asked once a strict reader raised,
    so whole logs aren't read twice.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    bad = F.rlike("value", F.lit(r"\S")) & F.try_parse_json("value").isNull() & parsed(F.col("value")).isNull()
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min(F.when(bad, F.col("id"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = splits.withColumn("line", before + F.col("bad") - F.col("first") + 1).where("bad is not null").orderBy("file", "line").first()
    return found and (found.file, found.line)


def write_jsonl(trace: Trace, path: str) -> None:
    """JSON lines in ``seq`` order within each file, nulls left out."""
    trace.events.sortWithinPartitions("seq").drop("seq").write.mode("overwrite").json(path)


def write_table(trace: Trace, path: str) -> None:
    """The log as Parquet, a folder for each kind, so that a view reads its kind alone."""
    trace.events.write.mode("overwrite").partitionBy("ev").parquet(path)


def read_table(spark: SparkSession, path: str) -> Trace:
    """A log written by :func:`write_table`; ``seq`` is as written."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no event log at {path}: export one first")
    schema = event_schema().add("seq", "long")
    return Trace(spark.read.schema(schema).parquet(path))


def open_log(spark: SparkSession, path: str, mode: str = "strict") -> Trace:
    """A log by its name: ``.jsonl`` or ``.json`` lines, else a table; a folder that holds an
    ``events.jsonl`` or ``events`` means that."""
    for inner in ("events.jsonl", "events"):
        if exists(spark, f"{path}/{inner}"):
            path = f"{path}/{inner}"
            break
    return read_jsonl(spark, path, mode) if path.endswith((".jsonl", ".json")) else read_table(spark, path)


def write_manifest(spark: SparkSession, manifest: dict, folder: str) -> None:
    """The manifest beside a log, in the log's own store, without a checksum beside it, as
    people edit manifests."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(f"{folder}/manifest.json")
    store = fs.FileSystem.newInstance(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        store.setWriteChecksum(False)
        out = store.create(at, True)
        out.write(bytearray((json.dumps(manifest, indent=2) + "\n").encode()))
        out.close()
    finally:
        store.close()


def read_manifest(spark: SparkSession, folder: str, tolerate_corrupt: bool = False) -> dict:
    """The manifest beside a log; empty where there is none."""
    path = f"{folder}/manifest.json"
    if not exists(spark, path):
        return {}
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    try:
        return json.loads(text)
    except ValueError:
        if tolerate_corrupt:
            return {}
        raise


def load_or_create_salt(path: str, override: str | None = None) -> str:
    """The machine's secret for pseudonyms: created once, readable by its owner alone."""
    if override:
        return override
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "w") as f:
            f.write(secrets.token_hex(32))
    with open(path) as f:
        return f.read().strip()
