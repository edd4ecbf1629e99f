"""Operator 4: best-fit packing by large-item matching.

Pieces over a third of the capacity can stand at most two to a sequence, so they are
matched first, the longest with the longest partner that fits; shorter pieces then go,
longest first, into the smallest gap that holds them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import TEXT_BATCHES, materialize, settings
from tracewright.llm.tokens import DEFAULT_TOKENIZER, token_pieces

CAPACITY = 2048
#: Pieces packed together.  A shard leaves about one sequence part-filled, so this bounds
#: both a task's memory and what is lost to packing shards apart.
SHARD_PIECES = 4096


class Stacks:
    """Numbers stacked by a size up to ``most``; a bit mask of the sizes finds neighbours."""

    def __init__(self, most: int):
        self.stacks: list[list[int]] = [[] for _ in range(most + 1)]
        self.mask = 0

    def put(self, size: int, number: int) -> None:
        self.stacks[size].append(number)
        self.mask |= 1 << size

    def _pop(self, size: int) -> tuple[int, int]:
        number = self.stacks[size].pop()
        if not self.stacks[size]:
            self.mask ^= 1 << size
        return size, number

    def smallest_from(self, least: int) -> tuple[int, int] | None:
        """Takes (size, number) of the smallest size that is ``least`` or more."""
        fits = self.mask >> least
        return self._pop(least + (fits & -fits).bit_length() - 1) if fits else None

    def largest_to(self, most: int) -> tuple[int, int] | None:
        """Takes (size, number) of the largest size that is ``most`` or less."""
        fits = self.mask & ((2 << most) - 1)
        return self._pop(fits.bit_length() - 1) if fits else None


def match_and_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each length (0 < length <= capacity) its sequence and its offset there."""
    sequence, offset, count = [0] * len(lengths), [0] * len(lengths), 0
    large, gaps = Stacks(capacity), Stacks(capacity)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    small = [i for i in order if 3 * lengths[i] <= capacity]
    for i in reversed(order):
        if 3 * lengths[i] > capacity:
            large.put(lengths[i], i)
    while first := large.largest_to(capacity):
        used, sequence[first[1]] = first[0], count
        if second := large.largest_to(capacity - used):
            sequence[second[1]], offset[second[1]] = count, used
            used += second[0]
        gaps.put(capacity - used, count)
        count += 1
    for i in small:
        free, number = gaps.smallest_from(lengths[i]) or (capacity, count)
        count = max(count, number + 1)
        sequence[i], offset[i] = number, capacity - free
        gaps.put(free - lengths[i], number)
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (column ``length``; written already, as it is read twice) with
    ``sequence_id`` and ``offset``.

    Pieces that fill a sequence alone need no partner and don't move.  The others are
    dealt evenly to shards of about ``shard_pieces``, by row and not by key, so copies
    and hot keys spread; each shard is packed by itself.
    """
    whole = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    out = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        number = int(shard.pop("_shard").iloc[0])
        sequence, offset = match_and_fit(shard["length"].tolist(), capacity)
        return shard.assign(sequence_id=pd.Series(sequence, index=shard.index, dtype="int64") + (number << 32), offset=pd.Series(offset, index=shard.index, dtype="int64"))

    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return whole.unionByName(dealt.groupBy("_shard").applyInPandas(pack, out))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document over the capacity is cut into pieces of that length, the last one shorter;
    no other is cut.  A null or empty text is the end-of-document id alone.  Each of
    repeated rows is packed; a null id passes through; an empty table packs to nothing;
    other columns are not read.
    """
    with settings(docs.sparkSession, TEXT_BATCHES):
        pieces = materialize(token_pieces(docs, capacity, tokenizer, id_column, text_column), "pieces")
    return pack_pieces(pieces, capacity)
