from pyspark.sql import functions as F

from tracewright.operators.joins import known_key, spread_key, with_context
from tracewright.operators.sequences import first_of

CALL = "seq long, id string, api_uuid string, api_message_id string"
API = "seq long, uuid string, message_id string, usage struct<cache_read: long, in: long, cache_create: long>"


def test_rows_without_a_key_are_spread_and_join_nothing(spark):
    calls = spark.createDataFrame([(i, f"c{i}", {0: "u1", 1: None, 2: "", 3: "n7", 4: "kn7"}[i % 5], None) for i in range(2000)], CALL)
    api = spark.createDataFrame([(1, "u1", "m", (1, 2, None)), (2, "u1", "m", (5, None, 1)), (3, None, "m", (9, 9, 9)), (4, "n7", "m", (7, 0, 0)), (5, "", "m", (8, 8, 8))], API)
    found = {r.seq: r.context_tokens for r in with_context(calls, api).collect()}
    assert found == {i: {0: 6, 3: 7}.get(i % 5) for i in range(2000)}
    no_key = calls.where("api_uuid is null").repartition(8, spread_key(F.col("api_uuid"), F.col("seq")))
    sizes = [r["count"] for r in no_key.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100


def test_no_key_equals_a_spread_one(spark):
    rows = spark.createDataFrame([(None, 1), ("n5", 2), ("", 3), ("k", 4)], "k string, seq long")
    pairs = rows.select(spread_key(F.col("k"), F.col("seq")).alias("a"), known_key(F.col("k")).alias("b")).collect()
    assert [r.a == r.b for r in pairs] == [False, True, True, True] and pairs[0].a.startswith("n")


def test_first_of_keeps_rows_without_a_key(spark):
    rows = [(None if i % 3 else i % 7, "x" if i % 2 else None, i) for i in range(300)]
    found = {tuple(r) for r in first_of(spark.createDataFrame(rows, "a long, b string, seq long"), ["a", "b"], ["seq"]).collect()}
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1]) if None not in r else r, r)
    assert found == set(first.values())
