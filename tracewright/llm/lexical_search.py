"""Operator 11: ranked lexical search over a bit-sliced impact index.

A block of documents holds for each of its terms the places of the documents that have it
and, slice by slice, the bits of their impacts (the term's weight times the document's
share).  A query adds its terms' slices as bitmaps, with carries, for all documents of a
block at once; its top k are found from the most significant slice down.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tracewright.llm.common import materialize, scratch, text_of

TOP = 20
#: A term's characters: ASCII letters and digits, and all that isn't ASCII; of these bytes A-Z are lower-cased.
LOWERED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Documents of a block, and postings after which it is closed early.
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 21
#: Items, terms and bytes that go to the tasks at once.
BATCH_ITEMS = 1024
BATCH_TERMS = 1 << 16
BATCH_BYTES = 1 << 22
#: Items whose sums stand in memory at once.
ITEMS_AT_ONCE = 128
#: Bytes of a vocabulary that may be broadcast, after they are counted.
BROADCAST_BYTES = 1 << 23
#: Scale of weights and shares, and the share of a document's length in its impact.
SHARE, WEIGHT, LENGTH_PERCENT, SATURATION = 1_000_000_000, 1000, 25, 12


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LOWERED).split(b" ") if text else []


def count_terms(text: bytes) -> Counter[bytes]:
    found = Counter(terms_of(text))
    del found[b""]
    return found


def weight(docs: int, having: int) -> int:
    return math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * having + 1)))


def postings(docs: DataFrame, id_column: str, text_column: str, only: Iterable[bytes] | None) -> DataFrame:
    """A row for each block and term: ``at`` (places in the block), ``tf`` and ``length`` of the documents that have it.

    A block's documents stand in the order of their ids, nulls last.  The block's own row
    has the empty term, their ids, how many have a term, and all their terms.
    """
    wanted = None if only is None else frozenset(only)
    base = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).cast("binary").alias("text"))
    id_field = StructField("ids", ArrayType(base.schema["doc_id"].dataType))
    numbers = [StructField("at", BinaryType()), StructField("tf", BinaryType()), StructField("length", BinaryType()), StructField("n", LongType()), StructField("terms", LongType())]
    out = StructType([StructField("block", LongType()), StructField("term", BinaryType()), id_field, *numbers])

    def rows(block: int, ids: list[pa.Array], lengths: list[int], number: dict[bytes, int], term: list[int], doc: list[int], tf: list[int]) -> Iterator[pa.RecordBatch]:
        every = pa.concat_arrays(ids)
        order = pc.sort_indices(every, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, at, times, length = np.array(term, np.int64), place[np.array(doc, np.int64)], np.array(tf, np.int64), np.array(lengths, np.int64)
        arrays = [pa.array([x]) for x in (block, b"")] + [pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every.take(pa.array(order)))]
        arrays += [pa.nulls(1, pa.binary())] * 3 + [pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64())]
        names = out.names
        yield pa.RecordBatch.from_arrays(arrays, names=names)
        by_term = np.lexsort((at, terms))
        terms, at, times, length = terms[by_term], at[by_term].astype(np.uint16), times[by_term], length[order][at[by_term]]
        edges = np.flatnonzero(np.diff(terms, prepend=-1))
        ends = np.append(edges[1:], len(terms))
        spelled = list(number)
        for i in range(0, len(edges), 512):
            cuts = list(zip(edges[i : i + 512].tolist(), ends[i : i + 512].tolist(), strict=True))
            blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (at, times, length)]
            n = pa.array([b - a for a, b in cuts], pa.int64())
            own = [pa.array([block] * len(cuts), pa.int64()), pa.array([spelled[terms[a]] for a, _ in cuts], pa.binary()), pa.nulls(len(cuts), pa.list_(every.type))]
            yield pa.RecordBatch.from_arrays([*own, *blobs, n, pa.nulls(len(cuts), pa.int64())], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, lengths, number, term, doc, tf = [], [], {}, [], [], []
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                counts = count_terms(text.as_py())
                ids.append(batch["doc_id"].slice(i, 1))
                lengths.append(counts.total())
                for t in counts if wanted is None else counts.keys() & wanted:
                    term.append(number.setdefault(t, len(number)))
                    doc.append(len(lengths) - 1)
                    tf.append(counts[t])
                if len(lengths) == BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield from rows(block, ids, lengths, number, term, doc, tf)
                    block, ids, lengths, number, term, doc, tf = block + 1, [], [], {}, [], [], []
        if lengths:
            yield from rows(block, ids, lengths, number, term, doc, tf)

    return base.mapInArrow(apply, out)


def slices_of(values: np.ndarray) -> tuple[int, bytes]:
    """How many bits the largest value has, and that many bitmaps over all values, the lowest bit's first."""
    width = int(values.max(initial=0)).bit_length()
    bits = (values[None, :] >> np.arange(width)[:, None]) & 1
    return width, np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", only: Iterable[bytes] | None = None) -> DataFrame:
    """The index of every row: (block, term, ids, at, n, width, slices), written to the shared folder.

    Counts of documents and terms are over all rows.  ``only``, a bounded vocabulary that
    goes to all tasks, leaves other terms' postings out.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found = materialize(postings(docs, id_column, text_column, only), "postings")
        docs_, terms_ = (x or 0 for x in found.where("term = X''").agg(F.sum("n"), F.sum("terms")).first())
        having = materialize(found.where("term != X''").groupBy("term").agg(F.sum("n").alias("having")), "having")
        few = (having.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) <= BROADCAST_BYTES
        known = found.join(F.broadcast(having) if few else having, "term", "left").select("block", "term", "ids", "at", "tf", "length", "n", "having")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths, slices = [], []
                for i in range(len(batch)):
                    if (having := batch["having"][i].as_py()) is None:  # the block's own row
                        widths.append(0)
                        slices.append(None)
                        continue
                    tf, length = (np.frombuffer(batch[c][i].as_py(), np.int64) for c in ("tf", "length"))
                    m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * length * docs_ // terms_
                    width, bits = slices_of(weight(docs_, having) * (SHARE * tf // (1000 * tf + SATURATION * m)))
                    widths.append(width)
                    slices.append(bits)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("block", "term", "ids", "at", "n")], pa.array(widths, pa.int32()), pa.array(slices, pa.binary())], names=["block", "term", "ids", "at", "n", "width", "slices"])

        shape = StructType([*[known.schema[c] for c in ("block", "term", "ids", "at", "n")], StructField("width", IntegerType()), StructField("slices", BinaryType())])
        return materialize(known.mapInArrow(apply, shape), "impact-index", keep=True)


class Words:
    """A term's slices in the words of a block's bitmaps in which it has documents."""

    def __init__(self, at: bytes, n: int, width: int, slices: bytes):
        places = np.frombuffer(at, np.uint16).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(width, -1), axis=1, count=n, bitorder="little").astype(np.uint64)
        edges = np.flatnonzero(np.diff(places >> 6, prepend=-1))
        self.word = (places >> 6)[edges]
        self.slices = np.bitwise_or.reduceat(bits << (places & 63).astype(np.uint64), edges, axis=1)


def add(total: np.ndarray, at: np.ndarray, slices: np.ndarray) -> None:
    """Add numbers, one a bit of each word of ``slices``, to those in the words ``at`` of ``total``; rows are bits, the lowest first."""
    carry = np.zeros(len(at), np.uint64)
    for b in range(len(total)):
        if b >= len(slices) and not carry.any():
            break
        old = total[b, at]
        new = slices[b] if b < len(slices) else np.zeros_like(old)
        both = old ^ new
        total[b, at] = both ^ carry
        carry = (old & new) | (both & carry)


def top(total: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps of the k largest numbers above 0 of each query, of equal ones the first; ``total`` is (bits, queries, words)."""
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    open_ = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(open_)
    for slice_ in total[::-1]:
        high = open_ & slice_
        room = k - count(sure)
        fits = count(high) <= room
        all_fit = count(open_) <= room
        sure |= np.where(all_fit[:, None], open_, np.where(fits[:, None], high, 0))
        open_ = np.where(all_fit[:, None], 0, np.where(fits[:, None], open_ & ~slice_, high))
    for q in np.flatnonzero(open_.any(axis=1)):  # equal numbers
        first = np.flatnonzero(np.unpackbits(open_[q].view(np.uint8), bitorder="little"))[: k - int(count(sure[q : q + 1])[0])]
        chosen = np.zeros(open_.shape[1] * 64, np.uint8)
        chosen[first] = 1
        sure[q] |= np.packbits(chosen, bitorder="little").view(np.uint64)
    return sure


def best_of_block(held: dict[bytes, Words], docs: int, queries: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's best ``k`` documents in a block."""
    words = -(-docs // 64)
    found = []
    for begin in range(0, len(queries), ITEMS_AT_ONCE):
        own = [[held[t] for t in q if t in held] for q in queries[begin : begin + ITEMS_AT_ONCE]]
        bits = max((sum((1 << len(t.slices)) - 1 for t in q).bit_length() for q in own), default=0)
        if not bits:
            continue
        total = np.zeros((bits, len(own) * words), np.uint64)
        for step in range(max(map(len, own))):
            now = [(i, q[step]) for i, q in enumerate(own) if step < len(q)]
            slices = np.zeros((max(len(t.slices) for _, t in now), sum(len(t.word) for _, t in now)), np.uint64)
            at, end = [], 0
            for i, t in now:
                at.append(i * words + t.word)
                slices[: len(t.slices), end : end + len(t.word)] = t.slices
                end += len(t.word)
            add(total, np.concatenate(at), slices)
        chosen = top(total.reshape(bits, len(own), words), k)
        query, place = np.nonzero(np.unpackbits(chosen.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little"))
        word, bit = query * words + (place >> 6), (place & 63).astype(np.uint64)
        score = sum(((total[b, word] >> bit) & np.uint64(1)).astype(np.int64) << b for b in range(bits))
        found.append((query + begin, place, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def batches_of(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item id, terms with repeats) of items that have any, as many at once as the bounds allow; an item beyond them comes alone."""
    held, terms, size = [], 0, 0
    for r in items.select(F.col(id_column), text_of(text_column).cast("binary")).toLocalIterator():
        own = sorted(count_terms(bytes(r[1])).elements())
        n = sum(map(len, own))
        if held and (len(held) == BATCH_ITEMS or terms + len(own) > BATCH_TERMS or size + n > BATCH_BYTES):
            yield held
            held, terms, size = [], 0, 0
        if own:
            held.append((r[0], own))
            terms, size = terms + len(own), size + n
    if held:
        yield held


def search_index(index: DataFrame, batch: list[tuple[object, list[bytes]]], item_field: StructField, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best ``k`` documents with a score above 0."""
    spark = index.sparkSession
    queries = [terms for _, terms in batch]
    asked = spark.createDataFrame([(bytearray(t),) for t in {t for q in queries for t in q} | {b""}], "term binary")
    block = index.join(F.broadcast(asked), "term", "left_semi").groupBy("block")  # of a bounded batch
    shape = StructType([StructField("query", IntegerType()), StructField("doc_id", index.schema["ids"].dataType.elementType), StructField("score", LongType())])

    def best(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()[0]
        held, ids = {}, None
        for i in range(len(rows)):
            if term := rows["term"][i].as_py():
                if rows["width"][i].as_py():
                    held[term] = Words(*(rows[c][i].as_py() for c in ("at", "n", "width", "slices")))
            else:
                ids = rows["ids"][i].values
        query, place, score = best_of_block(held, len(ids), queries, k)
        return pa.table([pa.array(query.astype(np.int32)), ids.take(pa.array(place)), pa.array(score)], names=shape.names)

    found = block.applyInArrow(best, shape)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(batch)], StructType([StructField("query", IntegerType()), StructField("item_id", item_field.dataType)]))
    return ranked.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text"
) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score.

    A term is a run of ASCII letters, digits and all characters beyond ASCII, with A-Z
    lower-cased; a term that an item repeats counts each time.  Equal scores go by doc_id,
    null ids last.  Null and empty texts have no terms: such items give no rows and such
    documents are in none, nor is one that scores 0.  Rows that repeat an id are documents
    of their own, items likewise.  Where an item list is short enough to go to all tasks, only
    its terms are indexed; else the index holds every term and is asked batch by batch.
    Empty tables give an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    item_field = StructField("item_id", items.schema[item_column].dataType)
    batches = batches_of(items, item_column, item_text_column)
    first, second = next(batches, []), next(batches, None)
    only = {t for _, q in first for t in q} if second is None else None
    index = build_index(docs, id_column, text_column, only)
    found = search_index(index, first, item_field, k)
    if second is None:
        return found
    found, into = materialize(found, "ranked", keep=True), [second]
    while into:
        found = materialize(found.unionByName(search_index(index, into.pop(), item_field, k)), "ranked", keep=True)
        into = [b for b in [next(batches, None)] if b]
    return found


PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def oracle_sql(k: int = TOP) -> str:
    """DuckDB SQL of :func:`search` of ``benchmark`` in ``documents``."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all({lowered}, '{PATTERN}') as terms from documents where text is not null),
total as (select count(*) as docs, sum(len(terms)) as terms from d where len(terms) > 0),
asked as materialized (select item_id, unnest(regexp_extract_all({lowered}, '{PATTERN}')) as term from benchmark),
p as materialized (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from d)
  where term in (select term from asked) group by r, doc_id, n, term),
w as (select term, cast(floor({WEIGHT} * ln((2 * t.docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, total t group by term, t.docs),
impact as (
  select r, doc_id, term, w * (({SHARE} * tf) // (1000 * tf + {SATURATION} * (100 - {LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * t.docs) // t.terms::bigint))) as impact
  from p join w using (term), total t),
scored as (select item_id, r, doc_id, cast(sum(impact) as bigint) as score from asked join impact using (term) group by item_id, r, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= {k}"""
