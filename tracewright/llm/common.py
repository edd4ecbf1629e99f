"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.storage import materialize, new_path, scratch, shared_dir  # noqa: F401

#: Word separators of every contract here: space, tab, \n, \v, \f and \r.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
#: Rows of up to about 100 bytes that may be broadcast, after they are counted.
BROADCAST_ROWS = 50_000
#: Spark's settings under which texts go to Python in batches of some MB; a task's batch is
#: held on both sides, in the JVM with room to grow.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 21)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(text, SEPARATOR_RUN), "")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row.

    A lambda variable is bound to the value, so the optimizer can't copy a costly
    expression into each place that uses it, nor into inner lambdas.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as keep it apart from ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a written table of short rows: broadcast while its counted rows are few,
    else by shuffle, where Spark splits what is skewed."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)
