"""Statistics as column expressions over aggregated counts."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.selection import half_even, nearest, select_ranks

#: Fixed value: the 97.5% point of the standard normal distribution.
Z95 = 1.959963984540054

POINTS = (0.5, 0.9, 0.95, 0.99)


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, 0 where the whole is 0."""
    value = F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)
    return F.round(value, digits) if digits is not None else value


def wilson_bound(n: Column, of: Column, sign: int, z: float = Z95) -> Column:
    """A bound of the Wilson score interval, clamped to 0 and 1; 0 where ``of`` is 0."""
    n, of = n.cast("double"), of.cast("double")
    p = n / of
    centre = p + z * z / (2 * of)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * of)) / of)
    bound = (centre + sign * spread) / (1 + z * z / of)
    return F.when(of == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def rate_columns(n: str, of: str, z: float = Z95) -> list[Column]:
    """pct, lo_pct and hi_pct to three digits, for a select beside ``n`` and ``of``."""
    return [
        F.round(100 * share(F.col(n), F.col(of)), 3).alias("pct"),
        F.round(100 * wilson_bound(F.col(n), F.col(of), -1, z), 3).alias("lo_pct"),
        F.round(100 * wilson_bound(F.col(n), F.col(of), 1, z), 3).alias("hi_pct"),
    ]


def rate(n: Column, of: Column, z: float = Z95) -> Column:
    """struct<n, of, pct, ci95_pct>; raises where not 0 <= n <= of."""
    valid = (n >= 0) & (n <= of)
    checked = F.when(valid, n.cast("long")).otherwise(F.raise_error(F.lit("need 0 <= numerator <= denominator")).cast("long"))
    return F.struct(
        checked.alias("n"),
        of.cast("long").alias("of"),
        F.round(100 * share(n, of), 3).alias("pct"),
        F.array(F.round(100 * wilson_bound(n, of, -1, z), 3), F.round(100 * wilson_bound(n, of, 1, z), 3)).alias("ci95_pct"),
    )


def two_proportion_z(a_n: Column, a_of: Column, b_n: Column, b_of: Column) -> Column:
    """Pooled two-proportion z; 0 where a denominator or the standard error is 0."""
    a_n, a_of, b_n, b_of = (c.cast("double") for c in (a_n, a_of, b_n, b_of))
    pooled = (a_n + b_n) / (a_of + b_of)
    error = F.sqrt(pooled * (1 - pooled) * (1 / a_of + 1 / b_of))
    z = F.when((a_of == 0) | (b_of == 0), F.lit(0.0)).otherwise(F.when(error == 0, F.lit(0.0)).otherwise((a_n / a_of - b_n / b_of) / error))
    return F.coalesce(z, F.lit(0.0))


#: Degree of the fit of erfc, and the largest argument at which it is above 0 as a double.
ERFC_DEGREE, ERFC_END = 40, 26.0


@cache
def _erfc_fit() -> list[float]:
    """Chebyshev coefficients of ln(erfc(x) * exp(x * x) / t) in t = 2 / (2 + x), for x from 0 to :data:`ERFC_END`."""
    low = 2 / (2 + ERFC_END)
    n = ERFC_DEGREE + 1
    angles = [math.pi * (i + 0.5) / n for i in range(n)]
    values = []
    for angle in angles:
        t = low + (1 - low) * (1 + math.cos(angle)) / 2
        x = 2 / t - 2
        values.append(math.log(math.erfc(x)) + x * x - math.log(t))
    return [(1 if j == 0 else 2) / n * math.fsum(v * math.cos(j * angle) for v, angle in zip(values, angles, strict=True)) for j in range(n)]


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 1e-12 of its value; 0 beyond :data:`ERFC_END`, where doubles end."""
    low = 2 / (2 + ERFC_END)
    t = F.lit(2.0) / (F.lit(2.0) + x)
    u = (2 * t - (1 + low)) / (1 - low)
    first, *others = _erfc_fit()
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("e"))
    step = lambda s, c: F.struct((2 * u * s["d"] - s["e"] + c).alias("d"), s["d"].alias("e"))
    fitted = F.aggregate(F.array(*[F.lit(c) for c in reversed(others)]), zero, step, lambda s: u * s["d"] - s["e"] + first)
    return F.when(x > ERFC_END, F.lit(0.0)).otherwise(t * F.exp(fitted - x * x))


def two_sided_p(z: Column) -> Column:
    """p of a two-sided normal test."""
    return erfc(F.abs(z) / math.sqrt(2))


def significant(z: Column) -> Column:
    """p < 0.05."""
    return two_sided_p(z) < 0.05


def trend_test(bins: DataFrame, keys: list[str], score: str = "score", n: str = "n", of: str = "of") -> DataFrame:
    """Cochran-Armitage trend over ordered bins: keys, bins_used, z, note.

    ``note`` says "too few bins" below three, "degenerate" where nothing varies.
    """
    used = bins.where(F.col(of) > 0)
    sums = used.groupBy(*keys).agg(
        F.count("*").alias("bins_used"),
        F.sum(of).cast("double").alias("_t"),
        F.sum(n).cast("double").alias("_s"),
        F.sum(F.col(of) * F.col(score)).cast("double").alias("_tx"),
        F.sum(F.col(n) * F.col(score)).cast("double").alias("_sx"),
        F.sum(F.col(of) * F.col(score) * F.col(score)).cast("double").alias("_txx"),
    )
    p, mean = F.col("_s") / F.col("_t"), F.col("_tx") / F.col("_t")
    above = F.col("_sx") - F.col("_s") * mean
    variance = p * (1 - p) * (F.col("_txx") - F.col("_t") * mean * mean)
    note = F.when(F.col("bins_used") < 3, "too few bins").when((p == 0) | (p == 1) | (variance <= 0), "degenerate")
    return sums.select(*keys, "bins_used", F.when(note.isNull(), above / F.sqrt(variance)).otherwise(F.lit(0.0)).alias("z"), note.alias("note"))


def nearest_rank(column: str, points: tuple[float, ...] = POINTS, cast: str = "double") -> list[Column]:
    """p50, p90, ... as the value at rank ceil(q * n), for an ``agg``; null over no rows."""
    return [F.expr(f"percentile_disc({q}) within group (order by {column})").cast(cast).alias(f"p{round(100 * q)}") for q in points]


def dist(column: str) -> list[Column]:
    """n, mean (two digits), nearest-rank quantiles and max; zeros over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ranks = [F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {column})").cast("double"), F.lit(0.0)).alias(f"p{round(100 * q)}") for q in POINTS]
    return [F.count(column).alias("n"), zero(F.round(F.avg(column), 2)).alias("mean"), *ranks, zero(F.max(column).cast("double")).alias("max")]


def dist_of(values: DataFrame, column: str, *more: Column) -> DataFrame:
    """One row: :func:`dist` of a column of any size, exactly, and aggregates ``more``; no task holds its distinct values."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    names = [f"p{round(100 * q)}" for q in POINTS]
    sums = values.agg(F.count(column).alias("n"), zero(F.round(F.avg(column), 2)).alias("mean"), zero(F.max(column).cast("double")).alias("max"), *more)
    ranks = select_ranks(values, column, dict(zip(names, map(nearest, POINTS), strict=True)))
    both = sums.crossJoin(F.broadcast(ranks))  # one row each
    return both.select("n", "mean", *[zero(F.col(p).cast("double")).alias(p) for p in names], "max", *[c for c in sums.columns if c not in ("n", "mean", "max")])


def rounded_rank(values: DataFrame, column: str, points: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles at index round-half-even(q * (n - 1)) of the sorted values: keys, pNN..."""
    return select_ranks(values, column, {f"p{round(100 * q)}": half_even(q) for q in points}, keys)
