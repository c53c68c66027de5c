"""Distributed global rank and prefix counts.

``rank() OVER (ORDER BY x)`` with no partition moves every row into one task.
These helpers compute the same numbers in parts:

1. rows are dealt into ranges of the order by Spark's range exchange, as many as the session has shuffle partitions (or
   into ranges of a fixed width where the order is dense numbers);
2. each range is summed up, and a running total over ranges gives each its offset: one row per range; where ranges
   are many, totals of totals, so no window holds more than a fixed number of them;
3. a window partitioned by the range finishes inside it (over distinct values with their counts, so heavy ties
   cost one row).

Neither the plan nor what a task holds grows with the rows: only the ranges' size does, with rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


#: Ranges whose totals one window adds up.
FANOUT = 4096


def in_ranges(df: DataFrame, col: str) -> DataFrame:
    """Rows with ``_p``, the range of ``col`` (NULLs first) they lie in; equal values share one. Written out, so that ranges stay."""
    return materialize(df.repartitionByRange(F.col(col).asc_nulls_first()).withColumn("_p", F.spark_partition_id()))


def offsets(per: DataFrame, parts: list[str], bucket: str, value: str, levels: int = 3) -> DataFrame:
    """``per`` (one row per ``parts`` and number ``bucket``) with ``_off``: the sum of ``value`` over smaller buckets.
    Buckets are added up in groups of FANOUT, groups of groups, and so on, ``levels`` times."""
    if levels == 1:
        w = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return per.withColumn("_off", F.coalesce(F.sum(value).over(w), F.lit(0)))
    up = f"{bucket}u"
    x = per.withColumn(up, F.floor(F.col(bucket) / FANOUT))
    w = Window.partitionBy(*parts, up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    groups = offsets(x.groupBy(*parts, up).agg(F.sum(value).alias(value)), parts, up, value, levels - 1)
    groups = groups.select(*[F.col(c).alias(f"_g{c}") for c in [*parts, up]], F.col("_off").alias("_above"))
    inside = x.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in [*parts, up]]
    return inside.join(groups, on).withColumn("_off", F.col("_in") + F.col("_above")).select(*per.columns, "_off")


def global_rank(df: DataFrame, col: str, out: str, buckets: int | None = None) -> DataFrame:
    """SQL ``rank() OVER (ORDER BY col ASC NULLS FIRST)`` without a single-task window.

    Ties are collapsed first (value -> count, partially aggregated), so a value
    repeated by a third of all rows is one row of the ranking; ranks are then
    joined back on the value (NULL-safe equi join). ``buckets``: number of ranges (default: shuffle partitions)."""
    vc = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if buckets:
        vc = materialize(vc.repartitionByRange(buckets, F.col("_v").asc_nulls_first()).withColumn("_p", F.spark_partition_id()))
    else:
        vc = in_ranges(vc, "_v")
    offs = offsets(vc.groupBy("_p").agg(F.sum("_c").alias("_n")), [], "_p", "_n", levels=1).select("_p", "_off")   # a row per range
    w = Window.partitionBy("_p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (vc.join(F.broadcast(offs), "_p")
             .withColumn(out, (F.coalesce(F.sum("_c").over(w), F.lit(0)) + F.col("_off") + 1).cast("int"))
             .select("_v", out))
    return df.join(ranks, F.col(col).eqNullSafe(F.col("_v"))).drop("_v")


def weighted_less(df: DataFrame, parts: list[str], order: str, points: str, queries: str,
                  rows_per_bucket: int = 4096) -> DataFrame:
    """One row, column ``n``: over all rows, ``queries`` times the sum of ``points`` of the rows
    of the same ``parts`` with a smaller ``order`` (an integer).

    Equal (parts, order) collapse first, so a frequent value is one row. Sums per range of
    ``order`` give each range's offset, a window finishes inside a range: no window holds
    more than ``rows_per_bucket`` rows, and no point meets a query."""
    d = df.groupBy(*parts, order).agg(F.sum(points).alias("_p"), F.sum(queries).alias("_q"))
    d = d.withColumn("_b", F.floor(F.col(order) / rows_per_bucket))
    per = offsets(d.groupBy(*parts, "_b").agg(F.sum("_p").alias("_s")), parts, "_b", "_s")
    before = Window.unboundedPreceding, -1
    inside = F.coalesce(F.sum("_p").over(Window.partitionBy(*parts, "_b").orderBy(order).rowsBetween(*before)), F.lit(0))
    joined = d.withColumn("_in", inside).where("_q > 0").join(per.drop("_s"), [*parts, "_b"])
    return joined.agg(F.coalesce(F.sum(F.col("_q") * (F.col("_off") + F.col("_in"))), F.lit(0)).cast("bigint").alias("n"))
