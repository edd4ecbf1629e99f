"""Operator 5: exact deduplication by stateful streaming.

A stream of (digest, stable identifier, content locator) runs through keyed state that
lives on disk (RocksDB) and never expires.  State holds for each digest the identifier
that stays, the locator of its content and the number of rows; texts stay where they
are, and a locator is a file and a row in it.  Every hit is then checked: the bytes at the
locator against the row's own.  Given a folder, the state outlives a call, and later
batches meet the digests of earlier ones.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import BROADCAST_ROWS, free_name, joined, materialize, new_path, scratch, settings, text_of
from tracewright.storage import exists, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files that one micro-batch takes in.
FILES_PER_TRIGGER = 1000
#: Copies checked against one replica of the text that stays, which bounds a join key's rows.
COPIES_PER_REPLICA = 500


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, id_column: str, text_column: str, in_place: bool, folder: str) -> tuple[DataFrame, str]:
    """(doc_id, text, path, row) of each row, and the name of the text's column in the files.

    With ``in_place`` rows are found in the Parquet files they were read from; where there
    are none, and without it, ids and texts are written below ``folder`` first.
    """
    path, row = F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
    if in_place:
        try:
            return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), path, row), text_column
        except AnalysisException:  # not a scan of Parquet files
            pass
    if not exists(docs.sparkSession, f"{folder}/_SUCCESS"):  # a batch that is run again keeps its locators
        docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder).select("doc_id", "text", path, row), "text"


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful operator over a stream of (digest, doc_id, file, row), in update mode.

    Rows are combined within each task before they reach the state, so a digest that a
    third of all rows share costs one row a task.  All values are numbers, so the state
    of a digest has a fixed size.
    """
    at_keep = lambda c: F.max_by(c, "doc_id")
    return stream.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.coalesce(at_keep("file"), F.max_by("file", "row")).alias("file"),
        F.coalesce(at_keep("row"), F.max("row")).alias("row"),
    )


def run_stream(spark: SparkSession, reader: DataStreamReader, source: str, into: str, checkpoint: str) -> None:
    """Feed all files below ``source`` through the state and append its updates to ``into``.

    A later call with the same folders takes in only new files.  Each batch overwrites
    its own folder, so a batch that is run again after a failure does no harm.
    """
    state = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves some MB of disk
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else an executor holds each store it has met until after the stream
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }

    def append(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{into}/batch={batch}")

    with settings(spark, state):
        stream = keyed_state(reader.parquet(source))
        stream.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def take_in(spark: SparkSession, rows: DataFrame, folder: str, batch: str) -> tuple[DataFrame, DataFrame]:
    """Run (digest, doc_id, path, row) through the state in ``folder``: the rows as they
    arrived, with ``file`` for the path, and those of their digests that two rows or more
    share, with keep_id, group_size and the locator of the row that stays.

    Arrivals are written under the batch's name, and when they stand a mark that says after
    which update.  A call that finds the mark is the retry of one that failed: it takes in
    nothing again.
    """
    arrivals, mark, updates = f"{folder}/arrivals/{batch}", f"{folder}/begun/{batch}", f"{folder}/updates"
    rows = rows.select("digest", "doc_id", F.xxhash64("path").alias("file"), "row")
    shape, none = rows.schema, keyed_state(rows.limit(0))  # no rows of the driver's: those would start Python workers
    none.write.mode("ignore").parquet(f"{updates}/batch=-1")
    history = spark.read.schema(StructType([*none.schema, StructField("batch", LongType())]))
    if not exists(spark, f"{mark}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(arrivals)
        history.parquet(updates).agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("after")).write.mode("overwrite").parquet(mark)
    after = spark.read.parquet(mark).first()["after"]
    arrived = spark.read.schema(shape).parquet(arrivals)
    reader = spark.readStream.schema(shape).option("maxFilesPerTrigger", FILES_PER_TRIGGER).option("recursiveFileLookup", "true")
    run_stream(spark, reader, f"{folder}/arrivals", updates, f"{folder}/checkpoint")
    fresh = history.parquet(updates).where(F.col("batch") > after)
    values = F.struct("keep_id", "group_size", "file", "row")
    latest = fresh.groupBy("digest").agg(F.max_by(values, "batch").alias("last")).select("digest", "last.*")
    return arrived, materialize(latest.where("group_size > 1"), "repeated", keep=True)


def content(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (written, with ``file`` and ``row``) with ``stored``, the text at each locator.

    The catalog names the files; what reaches the driver is a path for each that is read.
    """
    spark = rows.sparkSession
    paths = defaultdict(set)
    for r in joined(spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/files"), rows.select("file").distinct(), "file", "left_semi").select("path", "text_column").distinct().toLocalIterator():
        paths[r.text_column].add(unquote(r.path))
    found = [
        spark.read.schema(f"`{column}` string").parquet(*sorted(files)).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_of(f"`{column}`").alias("stored"))
        for column, files in paths.items()
    ]
    if not found:
        return rows.withColumn("stored", F.lit(None).cast("string")).limit(0)
    return joined(reduce(DataFrame.unionByName, found), rows, ["file", "row"], "inner")


def collisions(texts: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """Digests under which some row's bytes differ from those at the locator.

    Only rows of repeated digests are compared.  A group's staying text is replicated
    once per :data:`COPIES_PER_REPLICA` copies, so no join key grows with the group.
    """
    replicas = F.ceil(F.col("group_size") / COPIES_PER_REPLICA).cast("int")
    stays = content(groups, folder).select("digest", "stored", F.explode(F.sequence(F.lit(0), replicas - 1)).alias("replica"))
    hits = joined(texts, groups.select("digest", "group_size"), "digest", "inner").select("digest", "text", F.pmod(F.xxhash64("path", "row"), replicas).cast("int").alias("replica"))
    return hits.join(stays, ["digest", "replica"]).where(F.col("text") != F.col("stored")).select("digest").distinct()


def find_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256, in_place: bool = False, state: str | None = None, batch: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Of equal texts the largest id stays.  Null text counts as empty; a null id is smaller
    than all others, and stays only where all ids of the text are null.  Rows that
    repeat the staying id carry ``kept`` each; :func:`drop_duplicates` leaves one of
    them.  An empty table gives an empty one; other columns are not read.

    ``in_place`` says that ``docs`` was read from Parquet files whose texts are as they are
    there; then these are the content's place.  With ``state``, a folder that all executors
    share, the call is one batch of many: ids and sizes count the rows of earlier batches
    too, and a row of those may be the one that stays.  Files that locators name must last
    as long as the state.  ``batch`` names the call's rows there: a call that failed may be
    made again under its name, with the same rows, and counts them once.
    """
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    with scratch(spark):
        folder = state or new_path(spark, "dedup", keep=True)
        texts, stored_as = located(docs, id_column, text_column, in_place, f"{folder}/content/{batch}")
        texts = texts.withColumn("digest", digest(F.col("text")))
        files = texts.select(F.xxhash64("path").alias("file"), "path", F.lit(stored_as).alias("text_column")).distinct()
        files.write.mode("overwrite").parquet(f"{folder}/files/{batch}")
        arrived, groups = take_in(spark, texts.select("digest", "doc_id", "path", "row"), folder, batch)
        clash = materialize(collisions(texts, groups, folder), "collisions", keep=True)
        found = joined(arrived, groups, "digest", "left").select(
            "doc_id",
            "digest",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        )
        if not clash.isEmpty():  # texts that only share a digest are told apart by their bytes
            every = spark.read.schema(arrived.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/arrivals")
            several = materialize(every.join(clash, "digest", "left_semi"), "several")
            by_text = materialize(content(several, folder).groupBy("digest", F.col("stored").alias("text")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "by-text", keep=True)
            apart = texts.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
            found = found.join(clash, "digest", "left_anti").unionByName(apart)
        if not state:
            remove(spark, f"{folder}/updates")
            remove(spark, f"{folder}/checkpoint")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", in_place: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; one row for each text."""
    found = find_duplicates(docs, id_column, text_column, in_place=in_place)
    columns, key, sum_ = docs.columns, free_name("_id", docs.columns), free_name("_digest", docs.columns)
    lost = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("digest").alias(sum_)).distinct(), "lost")
    again = found.where("kept and group_size > 1").groupBy("digest", "doc_id").count().where("count > 1")
    own = docs.withColumns({sum_: sha256(text_of(text_column)), key: F.col(id_column)})
    few = lost.count() <= BROADCAST_ROWS
    lost = F.broadcast(lost) if few else lost
    left = own.alias("a").join(lost.alias("b"), (F.col(f"a.{sum_}") == F.col(f"b.{sum_}")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left_anti")
    if not again.isEmpty():  # whole rows that repeat an id with its text
        left = left.dropDuplicates([sum_, key])
    return left.select(*columns)
