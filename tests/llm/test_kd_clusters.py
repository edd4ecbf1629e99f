import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tracewright.llm import kd_clusters
from tracewright.llm.kd_clusters import Tree, cluster

SCHEMA = "vec_id long, embedding array<float>, cluster string, x long"


def slow_clusters(rows, clusters=8, rounds=10, dimensions=64):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, k in found:
        each[k] += d
    return Counter((i, k, d, each[k], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found)


def groups(seed, n, dimensions, spread):
    draw = np.random.default_rng(seed)
    middles = draw.normal(0, 0.3, (5, dimensions))
    return [(i, [float(np.float32(x)) for x in middles[draw.integers(5)] + draw.normal(0, spread, dimensions)]) for i in range(n)]


@pytest.mark.parametrize("dimensions, spread", [(64, 0.05), (2, 0.2), (3, 0.001)])
def test_clusters_match_every_vector_against_every_centroid(spark, dimensions, spread):
    rows = groups(dimensions, 300, dimensions, spread)
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (901, None), (902, [0.5]), (903, [None] * dimensions), (904, [float("nan")] * dimensions), (905, [float("-inf")] * dimensions)]
    rows += [(1000 + i, rows[2][1]) for i in range(150)]  # one vector a third of all
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA).repartition(3)
    assert Counter(map(tuple, cluster(df, dimensions=dimensions).collect())) == slow_clusters(rows, dimensions=dimensions)


def test_few_none_and_too_large_vectors(spark):
    rows = groups(1, 3, 4, 0.1)
    few = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)
    assert Counter(map(tuple, cluster(few, dimensions=4).collect())) == slow_clusters(rows, dimensions=4)
    assert cluster(few.limit(0), dimensions=4).count() == 0 == cluster(few).count()
    with pytest.raises(PySparkException, match="over the largest"):
        cluster(spark.createDataFrame([(1, [1e9] * 4, "c", 1)], SCHEMA), dimensions=4)


def test_trees_assign_whole_nodes_and_ties_like_a_scan():
    draw = np.random.default_rng(3)
    for scale, dimensions in ((3, 2), (1000, 2), (kd_clusters.LARGEST, 5)):
        points = draw.integers(-scale, scale + 1, (700, dimensions)).astype(np.int32)
        centroids = np.concatenate([points[:6], points[:2]]).astype(np.int64)  # two are the same
        tree, order = Tree.build(points)
        assert (tree.points == points[order]).all()
        tree = Tree.from_row(tree.to_row(), dimensions)
        labels, counts, sums = tree.assign(centroids)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in tree.points], dtype=object)
        want = np.array([min(range(len(centroids)), key=lambda k, row=row: (row[k], k)) for row in exact])
        assert (labels == want).all()
        assert counts.tolist() == np.bincount(want, minlength=8).tolist()
        assert all((sums[k] == tree.points[want == k].sum(axis=0, dtype=np.int64)).all() for k in range(8))


def test_far_centroids_are_pruned_and_nodes_go_whole(monkeypatch):
    points = np.concatenate([np.random.default_rng(i).integers(0, 50, (500, 3)) + 1000 * i for i in range(4)]).astype(np.int32)
    tree, _ = Tree.build(points)
    monkeypatch.setattr(kd_clusters, "distances", lambda *_: pytest.fail("a leaf was resolved"))
    assert np.bincount(tree.assign(np.array([[1000 * i + 25] * 3 for i in range(4)], np.int64))[0]).tolist() == [500] * 4
