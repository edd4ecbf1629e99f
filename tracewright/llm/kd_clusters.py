"""Operator 13: centroid clustering by kd-tree filtering.

Each partition's vectors become kd-trees whose nodes hold a count, integer sums and a
bounding box.  In a round the centroids go down every tree: at a node, those that another
candidate beats at each point of the box are pruned; where one is left, the whole node is
its own, by the node's count and sums; what is left at a leaf is resolved vector by
vector.  All arithmetic is on integers, so neither the order of rows nor their partitions
move a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tracewright.llm.common import materialize, scratch

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Vectors of one tree, and of one leaf.
TREE = 8192
LEAF = 32
#: Scaled components are at most this, so that squared distances fit 64 bits.
LARGEST = 1 << 27


@dataclass
class Tree:
    """Nodes in the order in which they were split; a node's vectors are ``points[start:end]``."""

    points: np.ndarray  # int32, vectors in the order of leaves
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first of two children, 0 for a leaf
    low: np.ndarray  # int32, a box for each node
    high: np.ndarray
    sums: np.ndarray  # int64

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it took ``points`` in."""
        order = np.arange(len(points))
        start, end, child, boxes = [0], [len(points)], [0], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            boxes.append((low, high, own.sum(axis=0, dtype=np.int64)))
            wide = int(np.argmax(high.astype(np.int64) - low))
            if b - a > LEAF and high[wide] > low[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                child[at] = len(start)
                start += [a, a + middle]
                end += [a + middle, b]
                child += [0, 0]
            at += 1
        low, high, sums = (np.stack(x) for x in zip(*boxes, strict=True))
        return cls(points[order], np.array(start, np.int32), np.array(end, np.int32), np.array(child, np.int32), low, high, sums), order

    def to_row(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in PARTS}

    @classmethod
    def from_row(cls, row: dict[str, bytes], dimensions: int) -> Tree:
        flat = {name: np.frombuffer(row[name], np.int64 if name == "sums" else np.int32) for name in PARTS}
        return cls(**{name: v.reshape(-1, dimensions) if name in ("points", "low", "high", "sums") else v for name, v in flat.items()})

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's centroid, and each centroid's count and sums; ties go to the smaller number."""
        k = len(centroids)
        labels = np.zeros(len(self.points), np.int32)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            open_ = self.undominated(nodes, open_, centroids)
            whole, leaf = open_.sum(axis=1) == 1, self.child[nodes] == 0
            for node, own in zip(nodes[whole].tolist(), np.argmax(open_[whole], axis=1).tolist(), strict=True):
                labels[self.start[node] : self.end[node]] = own
                counts[own] += self.end[node] - self.start[node]
                sums[own] += self.sums[node]
            if (rest := leaf & ~whole).any():
                sizes = (self.end - self.start)[nodes[rest]]
                where = np.concatenate([np.arange(self.start[n], self.end[n]) for n in nodes[rest]])
                points = self.points[where].astype(np.int64)
                found = np.where(np.repeat(open_[rest], sizes, axis=0), distances(points, centroids), np.iinfo(np.int64).max).argmin(axis=1)
                labels[where] = found
                counts += np.bincount(found, minlength=k)
                for own in range(k):
                    sums[own] += points[found == own].sum(axis=0)
            down = ~whole & ~leaf
            first = self.child[nodes[down]].astype(np.int64)
            nodes, open_ = np.concatenate([first, first + 1]), np.concatenate([open_[down], open_[down]])
        return labels, counts, sums

    def undominated(self, nodes: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """``open_`` without the centroids that the one nearest the box's middle strictly beats all over the box."""
        low, high = self.low[nodes].astype(np.int64), self.high[nodes].astype(np.int64)
        middle = (low + high) / 2
        away = ((middle[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        best = np.where(open_, away, np.inf).argmin(axis=1)
        towards = centroids[None] - centroids[best][:, None, :]
        corner = np.where(towards > 0, high[:, None, :], low[:, None, :])  # of the box, where a centroid does best against that one
        behind = (towards * (centroids[None] + centroids[best][:, None, :] - 2 * corner)).sum(axis=2)
        return open_ & (behind <= 0)


PARTS = ("points", "start", "end", "child", "low", "high", "sums")


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact: in doubles where no sum can pass 2^53."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * points.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    points, centroids = points.astype(kind), centroids.astype(kind)
    return ((points**2).sum(axis=1)[:, None] - 2 * (points @ centroids.T) + (centroids**2).sum(axis=1)).astype(np.int64)


def scaled(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors with ``dimensions`` finite components, as integers."""
    v, infinite = F.col(vector_column), F.lit(float("inf"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    too_large = F.raise_error(F.concat(F.lit("a component is over the largest that squared distances allow: "), F.col(vector_column).cast("string")))

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) <= LARGEST, F.floor(y)).otherwise(too_large.cast("long")).cast("int")

    kept = vectors.where(v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, finite))
    return kept.select(F.col(id_column).alias("vec_id"), F.transform(v, whole).alias("x"))


def trees(vectors: DataFrame, dimensions: int) -> DataFrame:
    """A row for each tree: its parts, and the ids of its vectors in its order."""
    id_field = vectors.schema["vec_id"]
    out = StructType([StructField("ids", ArrayType(id_field.dataType)), *[StructField(p, BinaryType()) for p in PARTS]])

    def tree(held: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
        table = pa.Table.from_batches(held, schema).combine_chunks()
        points = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dimensions)
        built, order = Tree.build(points)
        ids = table["vec_id"].combine_chunks().take(pa.array(order))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in built.to_row().values()]]
        return pa.RecordBatch.from_arrays(columns, names=["ids", *PARTS])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, len(batch), TREE):
                piece = batch.slice(at, TREE)
                if held and sum(map(len, held)) + len(piece) > TREE:
                    yield tree(held, batch.schema)
                    held = []
                held.append(piece)
        if sum(map(len, held)):
            yield tree(held, held[0].schema)

    return vectors.mapInArrow(apply, out)


def stored(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(len(batch)):
        yield batch["ids"][i].values, Tree.from_row({p: batch[p][i].as_py() for p in PARTS}, dimensions)


def totals(forest: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Sums of the components of the vectors nearest to each centroid, and after them their count.

    A task gives one number for each centroid and component; as many reach the driver.
    """
    k, dimensions = centroids.shape
    names = ["cluster", "component", "total"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            for _, tree in stored(batch, dimensions):
                _, counts, sums = tree.assign(centroids)
                whole += np.column_stack([sums, counts])
        own, component = np.indices(whole.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(component.ravel()), pa.array(whole.ravel())], names=names)

    found = forest.mapInArrow(apply, "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    out = {own: [0] * (dimensions + 1) for own in range(k)}
    for r in found.collect():
        out[r.cluster][r.component] = int(r.total)
    return out


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in stored(batch, dimensions):
                labels, _, _ = tree.assign(centroids)
                away = ((tree.points.astype(np.int64) - centroids[labels]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(labels), pa.array(away)], names=["vec_id", "cluster", "distance"])

    id_type = forest.schema["ids"].dataType.elementType
    return forest.mapInArrow(apply, StructType([StructField("vec_id", id_type), StructField("cluster", IntegerType()), StructField("distance", LongType())]))


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable are vectors of exactly ``dimensions`` components, none null, NaN or infinite;
    others give no row.  A component x becomes floor(scale * x); one beyond
    :data:`LARGEST` then raises.  Centroids start as the vectors with the smallest SHA-256 of
    ``seed:id`` (null ids last, equal ids by vector), fewer where there are fewer vectors.
    A round gives each vector to its nearest centroid, ties to the smaller number, and moves
    each centroid that has vectors to their floored mean; a centroid without any stays.
    Repeated rows count each.  An empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors, id_column, vector_column, dimensions, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.withColumn("_drawn", drawn).orderBy(F.col("_drawn").asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dimensions)
    with scratch(spark):
        forest = materialize(trees(kept, dimensions), "trees")
        for _ in range(rounds if len(first) else 0):
            for own, (*sums, n) in totals(forest, centroids).items():
                if n:
                    centroids[own] = [s // n for s in sums]
        if not len(first):
            centroids = np.zeros((1, dimensions), np.int64)
        found = materialize(assigned(forest, centroids), "assigned", keep=True)
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid
    named = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in each), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in each]
    by_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> str:
    """DuckDB SQL of :func:`cluster` over ``embeddings``: a component is a row, a round three tables."""
    parts = [
        f"""kept as materialized (
  select vec_id, embedding from embeddings
  where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimensions}),
v as materialized (
  select vec_id, i, cast(floor({scale} * cast(embedding[i] as double)) as bigint) as x from kept, (select unnest(range(1, {dimensions + 1})) as i)),
first as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept),
c0 as materialized (select c, i, x from first join v using (vec_id) where c < {clusters})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} as materialized (
  select vec_id, min_by(c, (d, c)) as c, min(d) as d
  from (select vec_id, c, cast(sum((v.x - k.x) * (v.x - k.x)) as bigint) as d from v join c{r} k using (i) group by vec_id, c) group by vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (
  select o.c, o.i, coalesce(n.x, o.x) as x
  from c{r} o left join (
    select c, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x from v join d{r} using (vec_id) group by c, i) n using (c, i))""")
    return f"""with {", ".join(parts)}
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, h.s as centroid_sha256
from d{rounds} join (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as s from c{rounds} group by c) h using (c)"""
