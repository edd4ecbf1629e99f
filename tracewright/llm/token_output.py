"""Operator 8: packed token-id output in binary.

Pieces are packed best-fit-decreasing; a segment tree over free capacities finds the
fullest sequence with room.  Each packed sequence becomes one row of a binary table: a
row of the id matrix, cumulative segment lengths, and positions that restart at each
segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tracewright.llm.common import new_path
from tracewright.llm.tokens import DEFAULT_TOKENIZER, encoded, pieces_of, texts_in

CAPACITY = 2048
#: Pieces of a task that are packed together; bounds a worker's memory.
WINDOW_PIECES = 8192
PAD = 0
#: Packed rows that leave a worker at once.
FRAME_ROWS = 64


class CapacityTree:
    """Counts of sequences by free capacity, as a segment tree in an array."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int = 1) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def at_least(self, needed: int) -> int | None:
        """The smallest free capacity of ``needed`` or more that some sequence has."""
        node = needed + self.leaves
        if self.count[node]:
            return needed
        while node > 1:  # up to the first right sibling that isn't empty, then down on the left
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces of each sequence, by number, in the order they are placed."""
    tree, by_free, packed = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.at_least(lengths[i])
        if free is None:
            free = capacity
            number = len(packed)
            packed.append([])
        else:
            number = by_free[free].pop()
            tree.add(free, -1)
        packed[number].append(i)
        by_free[free - lengths[i]].append(number)
        tree.add(free - lengths[i])
    return packed


def position_type(capacity: int) -> str:
    return "<u2" if capacity <= 1 << 16 else "<u4"


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW_PIECES) -> DataFrame:
    """One row per packed sequence, made without a shuffle.

    ``ids`` holds ``capacity`` little-endian 32-bit ids, padded with 0 at the end;
    ``cu_seqlens`` starts with 0 and ends with the ids used; ``positions`` holds 16-bit
    positions (32-bit beyond 65536) that restart at each segment and count on over the padding; ``doc_ids``,
    ``pieces`` and ``starts`` name each segment.  Overlong documents are cut without loss.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    long_list = ArrayType(LongType())
    out = StructType(
        [
            StructField("sequence", LongType()),
            StructField("ids", BinaryType()),
            StructField("cu_seqlens", ArrayType(IntegerType())),
            StructField("positions", BinaryType()),
            StructField("doc_ids", ArrayType(base.schema["doc_id"].dataType)),
            StructField("pieces", long_list),
            StructField("starts", long_list),
        ]
    )

    def rows_of(held: list[tuple]) -> Iterator[tuple]:
        for chosen in best_fit_decreasing([len(p[3]) // 4 for p in held], capacity):
            ids = b"".join([held[i][3] for i in chosen])
            ends = np.cumsum([len(held[i][3]) // 4 for i in chosen])
            starts = np.concatenate([[0], ends])
            positions = np.arange(capacity) - np.repeat(starts, np.diff(np.append(starts, capacity)))
            yield (
                ids.ljust(4 * capacity, PAD.to_bytes(1, "little")),
                starts.astype(np.int32).tolist(),
                positions.astype(position_type(capacity)).tobytes(),
                [held[i][0] for i in chosen],
                [held[i][1] for i in chosen],
                [held[i][2] for i in chosen],
            )

    def frames(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(held)
        while part := list(islice(rows, FRAME_ROWS)):
            columns = [pa.array(c, t.type) for c, t in zip([[0] * len(part), *zip(*part, strict=True)], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, whole in zip(batch["doc_id"], encoded(texts_in(batch), tokenizer), strict=True):
                held.extend((doc_id.as_py(), *p) for p in pieces_of(whole, capacity))
                if len(held) >= window:
                    yield from frames(held)
                    held = []
        yield from frames(held)

    arrow = to_arrow_schema(out)
    return base.mapInArrow(pack, out).withColumn("sequence", F.monotonically_increasing_id())


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, **columns: str) -> DataFrame:
    """Write :func:`packed_rows` as Parquet below ``path`` and read it back.

    A null or empty text is the end-of-document id alone; each of repeated rows is
    packed; a null id stays null; an empty table writes an empty table; other columns
    are not read.
    """
    rows = packed_rows(docs, capacity, tokenizer, **columns)
    # ids hardly repeat as whole rows, and levels above the first gain little on them
    rows.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment of a packed table: doc_id, piece, start, length, sequence_id, offset, ids_crc32."""
    each = packed.select("sequence", "ids", "cu_seqlens", "doc_ids", "pieces", "starts", F.posexplode("doc_ids").alias("_at", "doc_id"))
    first, end = F.get("cu_seqlens", F.col("_at")), F.get("cu_seqlens", F.col("_at") + 1)
    return each.select(
        "doc_id",
        F.get("pieces", F.col("_at")).alias("piece"),
        F.get("starts", F.col("_at")).alias("start"),
        (end - first).cast("long").alias("length"),
        F.col("sequence").alias("sequence_id"),
        first.cast("long").alias("offset"),
        F.crc32(F.expr("substring(ids, cu_seqlens[_at] * 4 + 1, (cu_seqlens[_at + 1] - cu_seqlens[_at]) * 4)")).alias("ids_crc32"),
    )


def write_token_ids(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Write ``docs`` packed to a new folder in the shared one and return its segments, read from it."""
    return segments(write_packed(docs, new_path(docs.sparkSession, "packed"), capacity, tokenizer))
