import random

from pyspark.sql import functions as F

from tracewright.operators import ordering


def test_sums_by_range_are_those_of_one_window(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, draw.random()]), draw.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at double, n long").repartition(7)
    order = [F.col("at").asc_nulls_last(), F.col("id")]
    sums = {"place": F.lit(1), "upto": F.col("n")}
    whole = sorted(ordering.running(df, order, sums).collect())
    monkeypatch.setattr(ordering, "FEW", 10)
    assert sorted(ordering.running(df, order, sums).collect()) == whole
    upto = 0
    for place, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 1):
        upto += r[2]
        assert (*r, place, upto) in set(map(tuple, whole))
    assert ordering.running(df.limit(0), order, sums).count() == 0
