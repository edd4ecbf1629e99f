"""Operator 9: mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget ends is
found and alone refined, until its threshold is one hash.  Rows are then filtered by
comparing their own hash with their source's threshold: rows are never sorted.  Sources
stay in tables throughout, so there may be as many of them as there are rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_ROWS, materialize, scratch, text_of, words_of
from tracewright.operators.ordering import running

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(id_column: str, text_column: str) -> Column:
    """The first 60 bits of the md5 of the id as text (null: empty) and its text's md5, so
    that rows which share an id part where their texts do."""
    digest = F.md5(text_of(text_column).cast("binary"))
    whole = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), digest)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def size_of(text_column: str) -> Column:
    return F.size(words_of(text_of(text_column))).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, size, target: ``share`` of all sizes by weight, at most ``most`` times a
    source's own size, the excess shared anew until no source is above that.

    ``sums`` has source and size.  Weights repeat over the sources by code point, null
    last.  Sources whose limit is least for their weight reach it first, so running sums
    in that order tell the level at which the others share the rest.
    """
    named = running(sums, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long")
    ratio = named.withColumn("weight", weight).withColumn("ratio", most * F.col("size") / F.col("weight"))
    ordered = running(ratio, [F.col("ratio"), F.col("nth")], {"rank": F.lit(1), "limits": most * F.col("size"), "weights": F.col("weight")})
    total, whole = ordered.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return sums.select("source", "size", F.lit(0.0).alias("target"))
    level = (F.lit(float(share * total)) - (F.col("limits") - most * F.col("size"))) / (F.lit(whole) - (F.col("weights") - F.col("weight")))
    first, at = ordered.withColumn("level", level).where("level <= ratio").agg(F.min("rank"), F.min_by("level", "rank")).first()
    limit = (most * F.col("size")).cast("double")
    target = limit if first is None else F.when(F.col("rank") < first, limit).otherwise(F.lit(at) * F.col("weight"))
    return ordered.select("source", "size", target.alias("target"))


def of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (alias s) with the row of ``table`` (alias t, written) for their source."""
    table = (F.broadcast(table) if table.count() <= BROADCAST_ROWS else table).alias("t")
    return rows.alias("s").join(table, F.col("s.source").eqNullSafe(F.col("t.source")))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source, written: source, source_size, target, copies, cut, cut_in.

    A row is taken ``copies`` times, and once more if its hash is below ``cut`` (or is
    ``cut`` and ``cut_in``).  ``sized`` (written) has source, size and h.
    """
    with scratch(sized.sparkSession):
        sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("size")), "sums")
        copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(most), F.floor(F.col("target") / F.col("size")))).cast("long")
        table = materialize(targets(sums, weights, share, most).withColumn("copies", copies), "targets")
        budget = F.col("target") - F.col("copies") * F.col("size")
        opened = materialize(table.where(budget > 0).select("source", F.lit(None).cast("long").alias("prefix"), budget.alias("left")), "level")
        cuts = []
        for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
            if opened.isEmpty():
                break
            inside = F.col("t.prefix").isNull() | (F.col("t.prefix") == F.shiftright("s.h", shift + LEVEL_BITS))
            histogram = (
                of_source(sized, opened)
                .where(inside)
                .groupBy("s.source", F.shiftright("s.h", shift).alias("bucket"))
                .agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("t.left").alias("left"))
            )
            order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**LEVEL_BITS rows a source
            before = F.col("upto") - F.col("size")
            ends_here = (F.col("upto") > F.col("left")) & (before <= F.col("left"))
            found = F.max(F.when(ends_here, F.struct("bucket", (F.col("left") - before).alias("rest"), "low", "high", "size"))).alias("b")
            level = histogram.withColumn("upto", F.sum("size").over(order)).groupBy("source").agg(found)
            one = F.col("b.low") == F.col("b.high")
            level = level.select(
                "source",
                F.col("b.bucket").alias("prefix"),
                F.col("b.rest").alias("left"),
                F.when(F.col("b").isNull(), F.lit(1 << HASH_BITS)).when(one, F.col("b.low")).alias("cut"),  # without one, the budget covers every row
                F.coalesce(one & (F.col("b.size") - F.col("b.rest") < F.col("b.rest")), F.lit(False)).alias("cut_in"),
            )
            level = materialize(level, "level")
            cuts.append(level.where("cut is not null").select("source", "cut", "cut_in"))
            opened = level.where("cut is null").select("source", "prefix", "left")
        table = table.withColumnRenamed("size", "source_size")
        if not cuts:
            return materialize(table.withColumns({"cut": F.lit(0).cast("long"), "cut_in": F.lit(False)}), "thresholds", keep=True)
        found = reduce(DataFrame.unionByName, cuts).alias("c")
        joined = table.alias("t").join(found, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        return materialize(joined.select("t.*", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), F.coalesce("cut_in", F.lit(False)).alias("cut_in")), "thresholds", keep=True)


def times_taken() -> Column:
    """Over :func:`of_source` with :func:`thresholds`: how often the mix takes a row."""
    h, cut = F.col("s.h"), F.col("t.cut")
    return F.col("t.copies") + F.when((h < cut) | (F.col("t.cut_in") & (h == cut)), 1).otherwise(0)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A null text has size 0; a null source is a source of its own, the last; a null id
    hashes as empty text.  Rows with equal ids and texts hash alike and are taken alike.  A
    source of size 0 has target 0; an empty table gives an empty one.  Reruns agree, as
    hashes depend on ids and texts alone.  Other columns are not read.
    """
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size_of(text_column).alias("size"), hash_of(id_column, text_column).alias("h"))
    sized = materialize(sized, "sizes")
    return of_source(sized, thresholds(sized, weights, share, most)).select("doc_id", "size", "source_size", "target", (times_taken() * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, columns
    unchanged, whatever their names.  A row of size 0 is taken like others with its hash."""
    own = docs.select(F.col(source_column).alias("source"), hash_of(id_column, text_column).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), size_of(text_column).alias("size"))
    with scratch(docs.sparkSession):
        table = thresholds(materialize(own.select("source", "size", "h"), "sizes"), weights, share, most)
        table = materialize(table, "thresholds", keep=True)
    taken = of_source(own, table).where(times_taken() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times_taken().cast("long")))).select("row.*")


ORACLE_SQL = """
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, row_number() over (order by source nulls last) as ord from s),
o as (select *, 2 * source_size / weight as ratio, row_number() over (order by 2 * source_size / weight, ord) as j,
      coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, ord rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
      coalesce(sum(weight) over (order by 2 * source_size / weight, ord rows between unbounded preceding and 1 preceding), 0)::bigint as capped_weight from w),
l as (select *, (1.5::double * (sum(source_size) over ())::bigint - capped) / ((sum(weight) over ())::bigint - capped_weight) as level from o),
f as (select min(j) as first from l where level <= ratio),
t as (select source, source_size, case when j < f.first then (2 * source_size)::double else (select level from l as x where x.j = f.first) * weight end as target from l, f),
b as (select *, case when source_size = 0 then 0 else least(2, floor(target / source_size))::bigint end as copies from t),
c as (select d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size as budget,
      sum(size) over (partition by d.source order by h range between unbounded preceding and current row)::bigint as upto,
      sum(size) over (partition by d.source, h)::bigint as own from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (size * (copies + case when upto <= budget or (upto - own <= budget and upto - budget < budget - (upto - own)) then 1 else 0 end))::bigint as taken from c
"""
