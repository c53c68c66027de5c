"""Mixing sources to target weights by Efraimidis-Spirakis keys.

Targets: a budget is shared by source weight, capped at a multiple of each
source's size, the excess reshared (closed form: one water level). A source takes
whole epochs first; the rest is filled in the order of exponential keys -ln(u) / quality,
prefix-summed to the rest. Keys are dealt to ranges; sums per (source, range) give the
prefix before each range, so only the one range in which the budget runs out is sorted,
and a hot source spreads over many ranges. u comes from md5(id), so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD

DIGITS = 13  # hexadecimal digits of the digest that make u


def unit_hash(id_col: str, seed: int, other: Column | None = None) -> Column:
    """A number in (0, 1) that depends on the id (where it is null, on ``other``) and the seed alone."""
    other = F.lit("null") if other is None else other.cast("string")
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), other), F.lit(f":{seed}"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long").cast("double")
    return (number + 0.5) / F.lit(float(16 ** DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target; a row for each source.

    Sources in code point order, null last, take ``weights`` in turn.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                (F.pmod(F.row_number().over(one) - 1, F.lit(n)) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / \
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level).withColumn("place", F.row_number().over(by))
    # the level holds from the first source, by rising ratio, that doesn't exceed it
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(every)["level"]
    return w.withColumn("target", F.least("limit", F.col("weight") * F.coalesce(final, F.lit(math.inf)))) \
        .select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 6,
        quality: DataFrame | None = None, rows_per_range: int = 10_000,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target, taken (words, repeats counted), copies.

    ``quality`` (doc_id, weight > 0) scales the keys: heavier documents come first; without an entry 0.6.
    The document in which the rest runs out is taken whole if that comes nearer to the target.
    Null text: size 0, nothing taken. Null source: a source of its own, last in order. Equal ids:
    equal keys, ordered by size and then as equal rows (the running sum counts each). Empty table: no rows.
    ``row`` (a digest of the row): rows without id get keys of their own by it, equal ids are ordered by it
    after size; the result also has source and row.
    """
    named = [] if row is None else ["source", "row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *([] if row is None else [row.alias("row")]),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id"), F.col("weight").alias("q")), "doc_id", "left")
    else:
        rows = rows.withColumn("q", F.lit(None).cast("double"))
    rows = rows.withColumn("key", -F.log(unit_hash("doc_id", seed, None if row is None else F.col("row"))) / F.coalesce("q", F.lit(0.6)))
    n = docs.count()
    ranges = max(1, math.ceil(n / rows_per_range))
    # exp(-key * 0.6) is close to uniform; any monotone rule is right, this one is even
    rows = materialize(rows.withColumn("range", F.floor((1 - F.exp(-F.col("key") * 0.6)) * ranges)))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    sizes = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, cap) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("range")))
    cut = upto.join(plan, upto["source"].eqNullSafe(plan["s"])).groupBy("s").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"),
        F.first("rest").alias("rest"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("range", (F.col("upto") - F.col("size")).alias("before")))).alias("cut"))
    cut = materialize(cut.select("s", "source_size", "target", "epochs", "rest", F.col("cut.range").alias("cut_range"), F.col("cut.before").alias("before")))
    all_rows = rows.join(cut, rows["source"].eqNullSafe(cut["s"]))
    here = F.coalesce(F.col("range") == F.col("cut_range"), F.lit(False))
    whole = all_rows.where(~here).withColumn("extra", F.coalesce(F.col("range") < F.col("cut_range"), F.lit(True)).cast("int"))
    order = Window.partitionBy("s").orderBy("key", "doc_id", "size", *named[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = all_rows.where(here).withColumn("sum", F.col("before") + F.sum("size").over(order))
    gap = F.col("sum") - F.col("rest")  # how far this document reaches over the rest
    last = last.withColumn("extra", ((gap <= 0) | ((gap < F.col("size")) & (gap < F.col("size") - gap))).cast("int")).drop("sum")
    return whole.unionByName(last.select(whole.columns)).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0).cast("long").alias("copies"), *named)


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights from labelled rows: mean label 1 -> 1.0, label 0 -> 0.2; one row per document."""
    return labels.where("doc_id is not null and quality is not null") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.lit(0.2) + 0.8 * F.avg("quality")).alias("weight"))
