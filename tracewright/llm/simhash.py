"""Operator 6: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared tile against tile with exclusive-or and bit counts; a pair of
tiles whose population counts differ beyond the radius is skipped.  Tiles are cut within
buckets of fingerprints that agree in some fixed bit fields: of ``fields`` fields, two
fingerprints at most ``radius`` bits apart agree in ``fields - radius`` at least, so the
buckets of all such choices meet every close pair and the comparison stays exact while
far pairs never share a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import BROADCAST_ROWS, TEXT_BATCHES, free_name, joined, materialize, scratch, settings, text_of

BITS = 64
RADIUS = 4
SHINGLE_WORDS = 4
#: Fingerprints of a tile.
TILE = 1024
SLICE = 1 << 16
#: Fingerprints that one bucket holds on average at most; beyond it keys take more fields.
BUCKET = 4096


def fingerprint(text: str | bytes) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of 4-word shingles, as an unsigned number."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = data.lower().split()  # bytes: A-Z only, and the six separators only
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[SHINGLE_WORDS - 1 :] if len(words) >= SHINGLE_WORDS else ends[-1:]
    votes = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, SLICE):
        hashes = [digest(line[a:b], 42) for a, b in zip(begins[at : min(count, at + SLICE)].tolist(), ends[at : at + SLICE].tolist(), strict=True)]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long; a text without words has 0."""
    base = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).cast("binary").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return base.mapInArrow(apply, StructType([base.schema["doc_id"], StructField("fp", LongType())]))


def field_masks(fields: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``fields - radius`` out of ``fields`` runs of bits."""
    edges = [BITS * i // fields for i in range(fields + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, fields - radius)]


def fields_for(count: int, radius: int) -> int:
    """Fields so that a key's values are many enough for ``count`` evenly spread fingerprints."""
    fields = radius + 1
    while count >> (BITS * (fields - radius) // fields) > BUCKET and fields < 2 * radius + 2:
        fields += 1
    return fields


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def tile_jobs(classes: DataFrame, radius: int, count: int) -> DataFrame:
    """(job, fp, side): the fingerprints of each comparison of two tiles, or of one with itself.

    A bucket up to one tile is one job.  A larger one is cut by population count and then
    by hash; tiles whose counts differ by over ``radius`` get no job.
    """
    masks = field_masks(fields_for(count, radius), radius)
    keyed = classes.select(
        "fp",
        F.bit_count("fp").cast("int").alias("pop"),
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])).alias("bucket"),
    )
    by_pop = keyed.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    per_bucket = by_pop.groupBy("bucket").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", "n")).alias("pops"))  # 65 counts at most
    sizes = materialize(per_bucket.where("total > 1"), "buckets")
    small = keyed.join(sizes.where(F.col("total") <= TILE).select("bucket"), "bucket").select(F.xxhash64("bucket", F.lit(-1), F.lit(-1)).alias("job"), "fp", F.lit(0).alias("side"))

    large = sizes.where(F.col("total") > TILE)
    tiles = large.select("bucket", F.explode("pops").alias("t")).select("bucket", "t.pop", F.ceil(F.col("t.n") / TILE).cast("int").alias("parts"))
    cut = materialize(keyed.join(tiles, ["bucket", "pop"]).select("bucket", "fp", "pop", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")), "tiles")
    near = tiles.select("bucket", F.col("pop").alias("near"), F.col("parts").alias("near_parts"))
    pairs = tiles.join(near, "bucket").where(F.abs(F.col("pop") - F.col("near")) <= radius)
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("near_part", F.explode(F.sequence(F.lit(0), F.col("near_parts") - 1)))
    first, second = F.struct("pop", "part"), F.struct(F.col("near").alias("pop"), F.col("near_part").alias("part"))
    code = lambda a, b: F.xxhash64("bucket", F.least(a, b), F.greatest(a, b))
    each = each.select("bucket", "pop", "part", code(first, second).alias("job"), F.when(first == second, 0).when(first < second, 1).otherwise(2).alias("side"))
    return small.unionByName(cut.join(each, ["bucket", "pop", "part"]).select("job", "fp", "side"))


def spanning_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the close pairs of a tile join: within ``a``, or of ``a`` with ``b``.

    A tile's close pairs can number its square; the links returned are fewer than its
    members, each to the smallest member of its component.
    """
    other = a if b is None else b
    close = np.concatenate([np.bitwise_count(a[i : i + 128, None] ^ other[None, :]) <= radius for i in range(0, len(a), 128)])
    if b is None:
        close[np.arange(len(a)), np.arange(len(a))] = False
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return a[:0], a[:0]
    close = close[np.ix_(rows, columns)]
    left, right = a[rows].view(np.int64), other[columns].view(np.int64)
    big = np.iinfo(np.int64).max
    label, label_right = left.copy(), right.copy()
    while True:
        down = np.minimum(label_right, np.where(close, label[:, None], big).min(axis=0))
        up = np.minimum(label, np.where(close, down[None, :], big).min(axis=1))
        if (up == label).all() and (down == label_right).all():
            break
        label, label_right = up, down
    nodes, roots = np.concatenate([left, right]), np.concatenate([label, label_right])
    differ = nodes != roots
    found = np.unique(np.stack([nodes[differ], roots[differ]]), axis=1)
    return found[0], found[1]


def links(jobs: DataFrame, radius: int) -> DataFrame:
    """(u, v) links between close fingerprints, v smaller: a spanning forest of each job's."""
    out = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def compare(held: list[pd.DataFrame]) -> list[pd.DataFrame]:
        frame = pd.concat(held, ignore_index=True)
        job, fp, side = (frame[c].to_numpy() for c in ("job", "fp", "side"))
        edges = np.flatnonzero(np.diff(job)) + 1
        found = []
        for i, j in zip([0, *edges], [*edges, len(job)], strict=True):
            if j - i > 1:
                members, sides = fp[i:j].view(np.uint64), side[i:j]
                a, b = (members, None) if sides[0] == 0 else (members[sides == 1], members[sides == 2])
                if len(a) and (b is None or len(b)):
                    u, v = spanning_links(a, b, radius)
                    if len(u):
                        found.append(pd.DataFrame({"u": u, "v": v}))
        return found

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last job, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            if held and held[-1]["job"].iloc[-1] != batch["job"].iloc[0]:
                yield from compare(held)
                held = []
            last = int(np.searchsorted(batch["job"].to_numpy(), batch["job"].iloc[-1]))
            if last:
                yield from compare([*held, batch.iloc[:last]])
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield from compare(held)

    return jobs.repartition("job").sortWithinPartitions("job").mapInPandas(apply, out)


def roots(edges: DataFrame) -> DataFrame:
    """(u, v) from each linked node to the smallest node it reaches, by alternating stars.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest;
    rounds grow with the logarithm of the longest chain.  Minima are pre-aggregated, and
    each round is written, so a lost executor costs no more than one round.
    """

    def hang(pairs: DataFrame) -> DataFrame:
        least = materialize(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
        return pairs.join(least, "u")

    edges = materialize(edges.where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = materialize(hang(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large-star")
        small = hang(edges)
        edges = materialize(small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).where("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges
        state = now


def component_rows(docs: DataFrame, id_column: str, text_column: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of the fingerprints that two
    rows or more share or that link; ``root`` names a component also where no id does."""
    with scratch(docs.sparkSession):
        with settings(docs.sparkSession, TEXT_BATCHES):
            prints = materialize(fingerprints(docs, id_column, text_column), "fingerprints", keep=True)
        classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "classes")
        tree = roots(links(tile_jobs(classes, radius, classes.count()), radius))
        members = tree.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(tree.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
        members = materialize(members.join(classes, "fp"), "members")
        named = materialize(members.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
        linked = materialize(members.join(named, "root").select("fp", "root", "component_id"), "linked")
        alone = classes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
        return prints, materialize(linked.unionByName(alone), "components", keep=True)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    Documents link where their fingerprints differ in ``radius`` bits or fewer; a
    component's id is the smallest doc_id in it.  Rows with equal fingerprints are one
    node, however many; links leave a task as spanning trees, never as all pairs.  A null,
    empty or wordless text has fingerprint 0 and links like any other.  A null id doesn't
    name a component; where all ids are null, neither does anything.  Repeated rows get
    equal results; an empty table gives an empty one; other columns are not read.
    """
    prints, special = component_rows(docs, id_column, text_column, radius)
    special = special.select("fp", "component_id", F.lit(True).alias("_found"))
    return joined(prints, special, "fp", "left").select("doc_id", "fp", F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    """Signed fingerprints; null for null."""
    return pd.Series([None if t is None else signed(fingerprint(t)) for t in texts], dtype="Int64")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged.

    The row with the smallest id stays, null ids last; of rows that share it, the one
    with the smallest fingerprint, then the smallest hash of the whole row.  Rows are
    told apart by id and fingerprint, so a null or repeated id loses only those of its
    rows that are near another.
    """
    prints, special = component_rows(docs, id_column, text_column, radius)
    rows = materialize(joined(prints, special.select("fp", "root"), "fp", "inner").groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n")), "component-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    stays = materialize(rows.groupBy("root").agg(F.min(first).alias("s")).select("root", F.col("s.doc_id").alias("keep_id"), F.col("s.fp").alias("keep_fp")), "stays")
    is_stay = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    judged = materialize(joined(rows, stays, "root", "inner").where(~is_stay | (F.col("n") > 1)).select("doc_id", "fp", is_stay.alias("again")), "judged")

    columns, key, print_ = docs.columns, free_name("_id", docs.columns), free_name("_fp", docs.columns)
    gone = judged.select(F.col("doc_id").alias(key), F.col("fp").alias(print_))
    repeated = materialize(prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)), "repeated-ids")
    if repeated.isEmpty():  # each id is one row
        few = gone.count() <= BROADCAST_ROWS
        gone = gone.select(key)
        return docs.join(F.broadcast(gone) if few else gone, docs[id_column].eqNullSafe(gone[key]), "left_anti")

    def matched(left: DataFrame, right: DataFrame, how: str, *on: str) -> DataFrame:
        right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
        condition = F.lit(True)
        for name in on:
            condition = condition & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
        return left.alias("a").join(right.alias("b"), condition, how)

    # Only rows of repeated ids need their fingerprint again; others are told apart by id.
    marked = repeated.withColumn(print_, F.lit(True))
    own = matched(docs.withColumn(key, F.col(id_column)), marked, "left", key).select("a.*", F.col(f"b.{print_}").alias(print_))
    own = own.withColumn(print_, fingerprint_udf(F.when(F.col(print_), text_of(text_column))))
    gone = matched(gone, marked, "left", key).select(f"a.{key}", F.when(F.col(f"b.{print_}"), F.col(f"a.{print_}")).alias(print_))
    left = matched(own, materialize(gone, "lost"), "left_anti", key, print_).select(*columns)
    again = judged.where("again").select(F.col("doc_id").alias(key), F.col("fp").alias(print_))
    if again.isEmpty():
        return left
    whole = F.struct(*columns)
    one = matched(own, again, "left_semi", key, print_).groupBy(key, print_).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(print_ + "_row"))
    return left.unionByName(one.select(F.col(print_ + "_row.*")))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
