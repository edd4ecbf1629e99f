"""Operator 12: removal of repeated passages by longest-previous-factor arrays.

A suffix array of the whole corpus would pass through one place, so suffixes are dealt
first: of each run of ``least`` bytes the gram with the smallest hash is an anchor, and
equal runs have equal anchors at equal offsets.  An anchor's context reaches as far as
such runs can; equal contexts are one entry with a count, and contexts that differ meet,
with all others of their anchor, in one suffix array.  There the previous and the next
smaller position in suffix order give each position's longest earlier match, the previous
and the next larger one its longest later match.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tracewright.llm.common import materialize, new_path, scratch
from tracewright.llm.exact_dedup import located

LEAST = 400
#: Positions of a text that are hashed at once.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2^64
#: Letters after which a suffix array is closed.
LOT = 1 << 19
#: Rows whose results are handed on together, results, and bytes after which they are.
ROWS_AT_ONCE = 1000
FOUND_AT_ONCE = 10_000
BYTES_AT_ONCE = 1 << 22
#: Contexts of an anchor that one suffix array takes; an anchor with more is parted by offset.
GROUP = 1 << 14
#: Ranges into which the offsets of runs around an anchor are cut.
PARTS = 8
#: Bits for each row that :func:`marked` looks for, and the most words of 64 bits that it broadcasts.
BITS_PER_ROW = 32
WORDS = 1 << 18


def gram_of(least: int) -> int:
    return max(1, least // 2)


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` values that follow each other, from bests of half as many."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values, reach = best(values[:-step], values[step:]), reach + step
    return values


class Anchors:
    """Anchors of texts: the places of grams whose hash is the smallest of some run of ``least`` bytes."""

    def __init__(self, least: int):
        self.least, self.gram = least, gram_of(least)
        self.power, self.inverse = powers(BASE, SLICE + least), powers(pow(BASE, -1, 1 << 64), SLICE + least)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, and their grams' hashes."""
        found = [self.of_slice(np.frombuffer(text, np.uint8, min(len(text) - at, SLICE + self.least - 1), at), at) for at in range(0, len(text) - self.least + 1, SLICE)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, first = np.unique(np.concatenate([x[0] for x in found]), return_index=True)
        return at, np.concatenate([x[1] for x in found])[first]

    def of_slice(self, text: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        n, k, width = len(text), self.gram, self.least - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self.inverse[: n - k + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        upper = (grams >> np.uint64(32)).astype(np.uint32)  # 32 bits choose: equal ones are anchors all
        least = np.zeros(n - self.least + 1 + 2 * (width - 1), np.uint32)
        least[width - 1 : len(least) - width + 1] = sliding(upper, width, np.minimum)
        at = np.flatnonzero(upper == sliding(least, width, np.maximum))
        return at + begin, grams[at].view(np.int64)


# ------------------------------------------------------------------ suffix arrays


def suffix_order(text: np.ndarray, cap: int) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Ranks of all suffixes by their first ``cap`` letters, and a function for the common prefix of pairs of them, at most ``cap``.

    Letters are numbers from 0; what would lie past the end is a letter below all.  Ranks
    double their reach until they have ``cap``.
    """
    n = len(text)

    def ranked(keys: np.ndarray) -> np.ndarray:
        by_key = np.argsort(keys)
        rank = np.empty(n, np.int64)
        rank[by_key] = np.cumsum(np.diff(keys[by_key], prepend=keys[by_key[:1]]) != 0) + 1
        return rank

    levels, reach = [(1, ranked(text))], 1
    while reach < cap:
        step = min(reach, cap - reach)
        rank = levels[-1][1]
        levels.append((reach + step, ranked(rank * np.int64(n + 1) + np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n])))
        reach += step

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.where(levels[-1][1][a] == levels[-1][1][b], cap, 0)
        open_ = np.flatnonzero(length < cap)
        a, b, found = a[open_], b[open_], length[open_]
        for size, rank in levels[-2::-1]:
            x, y = np.minimum(a + found, n - 1), np.minimum(b + found, n - 1)
            found += np.where((np.maximum(a, b) + found < n) & (found + size <= cap) & (rank[x] == rank[y]), size, 0)
        length[open_] = found
        return length

    return levels[-1][1], common


def nearest(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, in suffix order, its match with the nearest suffix before it in that order whose place is smaller.

    ``lcp`` is each suffix's match with the one before it.  A step goes from a suffix to
    the one that it points to, if that one's place isn't smaller, and on to where that one
    points; all suffixes go at once.  A match below ``least`` counts as 0.
    """
    to, match = np.arange(len(place)) - 1, lcp.copy()
    open_ = np.flatnonzero(match >= least)
    while len(open_ := open_[(match[open_] >= least) & (place[to[open_]] >= place[open_])]):
        past = to[open_]
        match[open_], to[open_] = np.minimum(match[open_], match[past]), to[past]
    return np.where(match >= least, match, 0)


def factors(text: np.ndarray, at: np.ndarray, place: np.ndarray, least: int, later: bool) -> np.ndarray:
    """Longest previous factor, up to ``least`` and 0 below it, of the suffixes at ``at``; with ``later`` the longest later one, if that is longer.

    A match is with a suffix of ``at`` whose place is smaller (larger), so two suffixes of
    one place don't match each other.
    """
    rank, common = suffix_order(text, least)
    order = np.argsort(rank[at], kind="stable")
    place = place[order]
    lcp = np.concatenate([[0], common(at[order[:-1]], at[order[1:]])])
    back = np.concatenate([[0], lcp[:0:-1]])  # the same, read from the end
    found = np.zeros(len(at), np.int64)
    for sign in (1, -1) if later else (1,):
        both = np.maximum(nearest(sign * place, lcp, least), nearest(sign * place[::-1], back, least)[::-1])
        found[order] = np.maximum(found[order], both)
    return found


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch as one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


# ------------------------------------------------------------------ jobs

ROW = ["file", "row"]
PLACE = [*ROW, "at", "begin", "end"]
#: What tells which of two occurrences is the first: by id, nulls last, then by file, row and place.
def order(*more: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW, "at", *more)


def longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


RUNS = ArrayType(StructType(longs("begin", "end")))


def contexts(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, anchor, context, file, row, at, begin, end) of each anchor: the hashes of its gram and of its context, and their place."""
    reach = least - gram_of(least)
    out = StructType([texts.schema["doc_id"], *longs("anchor", "context", *PLACE)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(least)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            held, source = [], []
            for i, (file, row, text) in enumerate(zip(batch["file"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True)):
                data = text.as_py()
                at, gram = anchors.of(data)
                if len(at):
                    begin, end = np.maximum(at - reach, 0), np.minimum(at + least, len(data))
                    context = [xxhash.xxh3_64_intdigest(data[b:e], a - b) for a, b, e in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True)]
                    held.append((gram, np.array(context, np.uint64).view(np.int64), np.full(len(at), file), np.full(len(at), row), at, begin, end))
                    source.append(np.full(len(at), i))
            if held:
                ids = batch["doc_id"].take(pa.array(np.concatenate(source)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]], names=out.names)

    return texts.select("doc_id", *ROW, "text").mapInArrow(apply, out)


def cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` contexts (anchor, context, n, file, row, at, begin, end, hot) with their bytes."""
    numbers = ["anchor", "context", "n", "at", "begin", "end"]
    lists = materialize(wanted.groupBy(*ROW).agg(F.collect_list(F.struct(*numbers, "hot")).alias("wanted")), "wanted")
    out = StructType([texts.schema["doc_id"], *longs(*ROW, *numbers), wanted.schema["hot"], StructField("bytes", BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(len(batch)):
                text, own = batch["text"][i].as_py(), batch["wanted"][i].values
                pieces = [text[b:e] for b, e in zip(own.field("begin").to_pylist(), own.field("end").to_pylist(), strict=True)]
                row = pa.array(np.zeros(len(own), np.int64))
                held.append(pa.RecordBatch.from_arrays([*[batch[c].slice(i, 1).take(row) for c in ("doc_id", *ROW)], *[own.field(c) for c in (*numbers, "hot")], pa.array(pieces, pa.binary())], names=out.names))
                size += sum(map(len, pieces))
                if size >= BYTES_AT_ONCE or i == len(batch) - 1:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0

    return marked(texts, lists).where("may").join(lists, ROW).select("doc_id", *ROW, "text", "wanted").mapInArrow(apply, out)


def in_order(rows: pa.Table) -> pa.Table:
    """The rows by :func:`order`, as an Arrow function needs it."""
    keys = [(c, "ascending") for c in ("doc_id", *ROW, "at")]
    return rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end")).combine_chunks()


def runs_batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*ROW, "begin", "end"])


def ranges_of(least: int) -> tuple[list[int], int]:
    """Where ranges of offsets begin that together hold all offsets of runs around an anchor, and how many offsets each has."""
    span = least - gram_of(least) + 1
    width = -(-span // PARTS)
    return sorted({*range(0, span - width, width), span - width}), width


#: A context as a tuple.
CONTEXT = ["doc_id", *ROW, "n", "at", "begin", "end", "bytes"]


class Lot:
    """What contexts of several anchors give: runs known to repeat, and stretches for one suffix array."""

    def __init__(self, id_type: pa.DataType):
        self.shape = pa.schema([("doc_id", id_type), *[(c, pa.int64()) for c in (*ROW, "at")], ("core", pa.uint64()), ("left", pa.binary()), ("right", pa.binary())])
        self.same: list[tuple] = []
        self.unlike: list[tuple] = []

    def take_in(self, rows: list[tuple], least: int, later: bool) -> None:
        """One anchor's contexts, in order.  Stretches that equal another's are runs; those that share their core with unequal ones are left to the suffix array.

        A stretch holds the runs of a range of offsets: what all of them share, its core, with
        fewer bytes to its left and right than the range has offsets.  Equal stretches go
        into the array once, as the first of them.
        """
        lows, width = ranges_of(least)
        for low in lows:
            cores: dict[int, dict[tuple[bytes, bytes], list[tuple]]] = defaultdict(dict)
            for row in rows:
                _, _, _, _, at, begin, end, data = row
                a, b = max(at - low - width + 1, begin), min(at - low + least, end)
                if b - a >= least:  # then some run lies in the context, and the core in that run
                    c, d = at - low, at - low - width + 1 + least
                    cores[xxhash.xxh3_64_intdigest(data[c - begin : d - begin])].setdefault((data[a - begin : c - begin], data[d - begin : b - begin]), []).append(row)
            for core, wholes in cores.items():
                for (left, right), equal in wholes.items():
                    first = equal[0]
                    if len(equal) > 1 or first[3] > 1:
                        c, d = -low - len(left), least - low - width + 1 + len(right)
                        self.same += [(r[1], r[2], r[4] + c, r[4] + d) for r in (equal if later else equal[1:])]
                    if len(wholes) > 1:
                        self.unlike.append((*first[:3], first[4] - low, core, left, right))

    def full(self, least: int) -> bool:
        return 2 * ranges_of(least)[1] * len(self.unlike) >= LOT or len(self.same) >= LOT

    def runs(self, least: int, later: bool) -> Iterator[pa.RecordBatch]:
        if self.same:
            yield runs_batch(*zip(*self.same, strict=True))
        if self.unlike:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.unlike, strict=True), self.shape.types, strict=True)]
            yield runs_of(pa.Table.from_arrays(columns, schema=self.shape), least, later)


def runs_of(held: pa.Table, least: int, later: bool) -> pa.RecordBatch:
    """(file, row, begin, end) of what repeats an earlier run (or, with ``later``, any other) of these stretches.

    In the suffix array's text a core is one letter, so a run is as many letters as its
    range has offsets.
    """
    width = ranges_of(least)[1]
    rows = in_order(held)
    file, row, core_at = (rows[c].to_numpy() for c in (*ROW, "at"))
    left, right = (np.array(pc.binary_length(rows[c]).to_numpy(), np.int64) for c in ("left", "right"))
    size = left + 1 + right
    begin = np.cumsum(size) - size
    text = np.zeros(size.sum(), np.int64)
    is_core = np.zeros(len(text), bool)
    is_core[begin + left] = True
    text[is_core] = 256 + np.unique(rows["core"].to_numpy(), return_inverse=True)[1]
    text[~is_core] = np.frombuffer(b"".join(x for both in zip(rows["left"].to_pylist(), rows["right"].to_pylist(), strict=True) for x in both), np.uint8)
    number = np.cumsum((np.diff(file, prepend=file[:1]) != 0) | (np.diff(row, prepend=row[:1]) != 0))  # of the document, in order
    starts = size - width + 1  # of runs, in each stretch
    inside = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    at = np.repeat(begin, starts) + inside
    place = np.repeat((number << 40) + core_at - left, starts) + inside
    hit = np.flatnonzero(factors(text, at, place, width, later) >= width)
    if not len(hit):
        return runs_batch([], [], [], [])
    first, past = merged(place[hit], place[hit] + least)  # places of documents lie far apart
    own, begin = np.searchsorted(number, first >> 40), first & ((1 << 40) - 1)
    return runs_batch(file[own], row[own], begin, begin + past - first)


def matched(pieces: DataFrame, least: int, later: bool) -> DataFrame:
    """(file, row, begin, end) of repeated runs: a suffix array for each lot of anchors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = None
        group: list[tuple] = []  # of one anchor, whose contexts may go on in the next batch
        last = None
        for batch in batches:
            lot = lot or Lot(batch["doc_id"].type)
            for anchor, *row in zip(*(batch[c].to_pylist() for c in ("anchor", *CONTEXT)), strict=True):
                if anchor != last:
                    lot.take_in(group, least, later)
                    group, last = [], anchor
                    if lot.full(least):
                        yield from lot.runs(least, later)
                        lot = Lot(batch["doc_id"].type)
                group.append(tuple(row))
        if lot:
            lot.take_in(group, least, later)
            yield from lot.runs(least, later)

    dealt = pieces.select("anchor", *CONTEXT).repartition("anchor").sortWithinPartitions("anchor", order())
    return dealt.mapInArrow(apply, StructType(longs(*ROW, "begin", "end")))


def parted(pieces: DataFrame, least: int, width: int) -> DataFrame:
    """A row for each context and range of ``width`` offsets: what all runs at these offsets share (``core``) and all that they cover (``whole``), as hashes.

    A run's offset is the number of its bytes before the anchor; ``lows`` lists where the
    ranges begin.
    """
    kept = ["doc_id", "anchor", "context", "n", *ROW, "at"]
    out = StructType([*[pieces.schema[c] for c in kept], *longs("low", "begin", "end", "whole"), StructField("core", BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(batch)):
                anchor, at, begin, end, data, lows = (batch[c][i].as_py() for c in ("anchor", "at", "begin", "end", "bytes", "lows"))
                for low in lows:
                    a, b = max(at - low - width + 1, begin), min(at - low + least, end)
                    if b - a >= least:
                        core = data[at - low - begin : at - low - width + 1 + least - begin]
                        found.append((i, low, a, b, xxhash.xxh3_64_intdigest(data[a - begin : b - begin]), xxhash.xxh3_128_digest(b"%d %d %s" % (anchor, low, core))))
                if len(found) >= FOUND_AT_ONCE or found and i == len(batch) - 1:
                    source, low, a, b, whole, core = zip(*found, strict=True)
                    take = pa.array(source)
                    hashes = pa.array(np.array(whole, np.uint64).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*[batch[c].take(take) for c in kept], pa.array(low), pa.array(a), pa.array(b), hashes, pa.array(core, pa.binary())], names=out.names)
                    found = []

    return pieces.mapInArrow(apply, out)


def shared(rows: DataFrame, later: bool) -> tuple[DataFrame, DataFrame]:
    """Of parted contexts: what is covered as a whole by an equal one, and what shares its core with others that differ."""
    same = rows.groupBy("core").agg(F.sum("n").alias("total"), F.min(order()).alias("first"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("total > 1")
    both = rows.join(same, "core")
    earlier = F.lit(True) if later else is_not(F.col("first"))
    return both.where((F.col("a") == F.col("b")) & earlier).select(*ROW, "begin", "end"), both.where("a != b").select("anchor", "context", "low")


def is_not(first: Column) -> Column:
    return ~((F.col("file") == first["file"]) & (F.col("row") == first["row"]) & (F.col("at") == first["at"]))


def repeated_runs(texts: DataFrame, least: int, later: bool) -> DataFrame:
    """(file, row, begin, end): runs of ``least`` bytes or more that begin at an earlier place too or, with ``later``, at any other; they overlap."""
    with scratch(texts.sparkSession):
        found = materialize(contexts(texts, least), "contexts")
        # counts are written before they are joined: else join and count share a stage, and Spark can't split a common anchor's rows
        again = materialize(found.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
        occurring = materialize(found.join(again, "anchor"), "occurring", keep=True)
    classes = materialize(occurring.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(order("begin", "end")).alias("first")), "classes")

    copied = classes.where("n > 1")  # copies of a context repeat the first one as a whole
    if later:
        whole = occurring.join(copied.select("anchor", "context"), ["anchor", "context"], "left_semi")
    else:
        whole = occurring.join(copied.select("anchor", "context", "first"), ["anchor", "context"]).where(is_not(F.col("first")))
    whole = whole.select(*ROW, "begin", "end")

    several = materialize(classes.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    wanted = classes.join(several, "anchor").select("anchor", "context", "n", *[f"first.{c}" for c in PLACE], (F.col("contexts") > GROUP).alias("hot"))
    pieces = materialize(cut(texts, wanted), "pieces")
    runs = whole.unionByName(matched(pieces.where("not hot"), least, later))
    hot = pieces.where("hot")
    if hot.isEmpty():
        return runs
    lows, width = ranges_of(least)
    rows = hot.withColumn("lows", F.array(*[F.lit(x).cast("long") for x in lows]))
    while True:  # what shares a core with unequal ones is parted more finely, until runs are told apart one by one
        equal, differ = shared(materialize(parted(rows, least, width), "ranges"), later)
        runs = runs.unionByName(equal)
        if width == 1:
            return runs
        finer = 1 if width <= 5 else math.isqrt(width)
        last = F.col("low") + width - finer
        starts = F.explode(F.array_union(F.sequence("low", last, F.lit(finer).cast("long")), F.array(last))).alias("start")
        rows = hot.join(differ.select("anchor", "context", starts).groupBy("anchor", "context").agg(F.collect_set("start").alias("lows")), ["anchor", "context"])
        width = finer


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, keep: str = "first", in_place: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (array of begin, end), kept (bytes).

    Texts are bytes of UTF-8; null counts as empty.  With ``keep="first"`` each byte goes
    that a run of ``least`` bytes covers which also begins at an earlier place: in a
    smaller id (nulls last), or before it in the same text.  With ``keep="none"`` the first
    one goes too.  Runs may overlap and never cross texts; all are judged by the texts as
    given.  ``removed`` holds the largest runs of removed bytes, so ``kept`` may begin or
    end within a character.  Rows that repeat an id are texts of their own.  A text
    shorter than ``least`` stays whole; an empty table gives an empty one; other columns are
    not read.  ``in_place`` says that ``docs`` was read from Parquet files as they are,
    else ids and texts are written once.

    Contexts are told apart by 128 bits of hash (of gram and context); suffix arrays compare
    bytes.  Anchors with over :data:`GROUP` different contexts are parted by the runs'
    offsets until the runs of a part are all equal, so no task holds such a group.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep is 'first' or 'none', not {keep!r}")
    spark = docs.sparkSession
    with scratch(spark):
        texts, _ = located(docs, id_column, text_column, in_place, new_path(spark, "texts", keep=True))
        texts = texts.select("doc_id", F.xxhash64("path").alias("file"), "row", F.col("text").cast("binary").alias("text"))
        runs = repeated_runs(texts, least, keep == "none")
        lists = runs.groupBy(*ROW).agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
        removed = materialize(lists.select(*ROW, merged_runs("runs").alias("removed")), "removed", keep=True)
    own = marked(texts, removed)
    joined = own.where("may").join(removed, ROW, "left").withColumn("removed", F.coalesce("removed", F.array().cast(RUNS)))
    found = joined.unionByName(own.where("not may").withColumn("removed", F.array().cast(RUNS)))
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "removed", without(F.col("text"), F.col("removed")).alias("kept"))


def marked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` with ``may``: false where its place is not among the written ``rows``', so that it needn't be moved to meet them.

    Places of ``rows`` set bits that their hashes choose.  A place whose bit others have set
    counts as among them too, which happens more the more rows there are for the bits.
    """
    words = max(1, min(WORDS, BITS_PER_ROW * rows.count() // 64))
    bit = F.pmod(F.xxhash64(*ROW), F.lit(64 * words))
    numbered = [bit.alias("_bit"), F.shiftright(bit, 6).alias("_word")]
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    bits = rows.select(*numbered).groupBy("_word").agg(F.bit_or(mask).alias("_bits"))
    own = texts.select("*", *numbered)
    return own.join(F.broadcast(bits), "_word", "left").withColumn("may", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def without(text: Column, removed: Column) -> Column:
    """The bytes outside the runs: slices between them, joined as Latin-1, which has a letter for each byte."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda r: r["end"]))
    ends = F.concat(F.transform(removed, lambda r: r["begin"]), F.array(F.octet_length(text).cast("long")))
    letters = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.decode(F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "ISO-8859-1"))
    return F.when(F.size(removed) == 0, text).otherwise(F.encode(F.array_join(letters, ""), "ISO-8859-1"))


@F.arrow_udf(RUNS)
def merged_runs(lists: pa.Array) -> pa.Array:
    found = [merged(*(own.values.field(c).to_numpy() for c in ("begin", "end"))) for own in lists]
    runs = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 2
    offsets = np.concatenate([[0], np.cumsum([len(a) for a, _ in found])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(runs, names=["begin", "end"]))
