import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.stats import dist, dist_of
from tracewright.operators.selection import half_even, nearest, select_ranks

PLACES = {"first": lambda n: F.lit(0), "p50": half_even(0.5), "p95": nearest(0.95), "last": lambda n: n - 1}


def plain(values):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    n = len(values)
    return [values[0], values[round(0.5 * (n - 1))], values[max(0, math.ceil(0.95 * n) - 1)], values[-1]]


def same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("kind", ["double", "long"])
def test_keys_match_sorting(spark, kind):
    draw = random.Random(4)
    rows = []
    for key, n in [("hot", 3000), ("b", 1), ("c", 2), (None, 57), ("ties", 400), ("null", 0)]:
        for _ in range(n):
            v = draw.choice([0.0, -0.0, 1e-310, math.inf, -math.inf, math.nan, draw.gauss(0, 1e-9), draw.gauss(0, 1e12), 0.5 + draw.random() * 2**-50])
            v = 7.0 if key == "ties" else v
            rows.append((key, v if kind == "double" else draw.choice([draw.getrandbits(63), -draw.getrandbits(63), draw.randint(-9, 9)])))
    rows += [("null", None), ("hot", None)]
    table = spark.createDataFrame(rows, f"_k0 string, v {kind}")
    found = select_ranks(table, "v", PLACES, ("_k0",)).collect()
    assert {r["_k0"] for r in found} == {"hot", "b", "c", None, "ties"}
    for r in found:
        assert same([r[p] for p in PLACES], plain([v for k, v in rows if k == r["_k0"] and v is not None]))


def test_a_million_distinct_values(spark):
    table = spark.range(1_000_000).select((F.xxhash64("id") / F.lit(3e15)).alias("v"))
    found = select_ranks(table, "v", PLACES).first()
    assert list(found) == plain([r.v for r in table.toLocalIterator()])


def test_no_values_and_other_types(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in select_ranks(none, "v", PLACES).collect()] == [(None,) * 4]
    assert dist_of(none, "v").collect() == none.agg(*dist("v")).collect()
    with pytest.raises(TypeError):
        select_ranks(none.select(F.lit("a").alias("v")), "v", PLACES)


def test_the_distribution_is_that_of_sorting(spark):
    for n in (1, 2, 3, 10, 20, 21, 100, 400):
        table = spark.range(n).select((F.xxhash64("id") % 1000 / 7).alias("v"))
        assert dist_of(table, "v", F.sum("v").alias("total")).first().asDict() == table.agg(*dist("v"), F.sum("v").alias("total")).first().asDict()


def test_values_are_counted_in_one_shuffle(spark):
    """Each histogram reads the same exchange of counted values, and no window is over values."""
    table = spark.range(5000).select((F.col("id") / 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = select_ranks(table, "v", PLACES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Range (0") == 1 and plan.count("ReusedExchange") == 2
