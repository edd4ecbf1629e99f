import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions.stats import erfc, significant, two_sided_p


def test_erfc_matches_the_library(spark):
    points = [26.2 * i / 10_000 for i in range(10_001)]
    found = spark.createDataFrame([(x,) for x in points], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for r in found:
        if r.x <= 26:
            assert r.y == pytest.approx(math.erfc(r.x), rel=1e-12)
        else:
            assert r.y == 0 or r.y == pytest.approx(math.erfc(r.x), rel=1e-9)


def test_p_of_a_two_sided_test(spark):
    points = [0.0, 1.0, -1.0, 1.959, 1.9599639845, 1.96, -1.961, 5.5, -30.0, 60.0]
    rows = spark.createDataFrame([(z,) for z in points], "z double").select("z", two_sided_p(F.col("z")).alias("p"), significant(F.col("z")).alias("s")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)
        assert r.s == (abs(r.z) > 1.95996398454)
