"""Exact interpolated percentiles with a state and a plan of constant size.

PostgreSQL ``percentile_cont`` semantics: position (n-1)p, linear interpolation, NULLs ignored.

``percentile`` keeps a value->count map per group, which is bounded only where a group is. So a count decides per group:
up to ``small`` rows the map is used, larger groups go through radix selection:

1. per (group, measure) the row count, least and greatest value; each probability names the one or two ranks it needs;
2. while the interval of a rank holds more than ``small`` rows, it is cut into parts -- octaves where it spans several,
   else PARTS equal widths --, rows are counted per part (combined map-side), and the part that
   holds the rank becomes the interval, narrowed to its least and greatest value;
3. one pass reads the rows left in all intervals, collapsed to (value, count), and picks the ranks.

All measures of a group go through the same passes, stacked as rows. A double has about 64 bits and a
round decides ten of them, so there are at most eight rounds whatever the values, and each adds the same few
operators to a plan that starts from a checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Parts of an interval in a round.
PARTS = 1024
#: Rows of a group (or of an interval) that one task may hold as a value map.
SMALL = 200_000
#: Up to so many intervals are broadcast (a few dozen bytes each); more are joined by key.
BROADCAST_ROWS = 10_000


def grouped_percentiles(df: DataFrame, keys: list[str], measures: dict[str, tuple[str | Column, float | list[float]]],
                        aggs: list[Column] | None = None, small: int = SMALL) -> DataFrame:
    """One row per group: ``keys``, ``aggs`` and per measure ``name: (column, probability or probabilities)`` the exact
    percentile (or an array of them)."""
    aggs = list(aggs or [])
    names = list(measures)
    cols = {n: (F.col(c) if isinstance(c, str) else c).cast("double") for n, (c, _) in measures.items()}
    probs = {n: p if isinstance(p, list) else [p] for n, (_, p) in measures.items()}
    one = {n: not isinstance(p, list) for n, (_, p) in measures.items()}

    def direct(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(*aggs, *[F.percentile(cols[n], probs[n][0] if one[n] else probs[n]).alias(n) for n in names])

    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (size.agg(F.max("_n")).first()[0] or 0) <= small:
        return direct(df)
    large = materialize(size.filter(F.col("_n") > small).select(*keys))      # at most rows / small groups
    few = large.count() <= BROADCAST_ROWS
    hot = _join(df, large, keys, how="left_semi", few=few)
    st = F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), cols[n])])
    picked = _select(hot.select(*keys, st.alias("_m", "_v")), [*keys, "_m"], probs, small)
    point = lambda n, i: F.max(F.when((F.col("_m") == n) & (F.col("_i") == i), F.col("_p")))
    wide = picked.groupBy(*keys).agg(*[
        (point(n, 0) if one[n] else F.array(*[point(n, i) for i in range(len(probs[n]))])).alias(n) for n in names])
    big = _join(hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs), wide, keys, how="left").drop("_n")
    # a measure without a value: percentile gives null for the array, too
    big = big.select(*[c for c in big.columns if c not in names], *[
        F.col(n) if one[n] else F.when(F.get(n, F.lit(0)).isNotNull(), F.col(n)).alias(n) for n in names])
    return direct(_join(df, large, keys, how="left_anti", few=few)).unionByName(big)


def exact_percentiles(df: DataFrame, keys: list[str], col: str, probs: list[float], prefix: str = "p",
                      buckets: int | None = None) -> DataFrame:
    """One row per group: ``keys`` + ``{prefix}0..``, the exact percentiles of ``col``; always by radix selection.
    An interval is read once it holds SMALL rows, or with ``buckets`` that share of all rows."""
    v = df.select(*keys, F.lit("x").alias("_m"), F.col(col).cast("double").alias("_v"))
    small = SMALL if buckets is None else max(1, math.ceil(v.filter(F.col("_v").isNotNull()).count() / buckets))
    picked = _select(v, [*keys, "_m"], {"x": probs}, small)
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(f"{prefix}{i}") for i in range(len(probs))])


def part_of(v: Column, lo: Column, hi: Column) -> Column:
    """Part of [lo, hi] that ``v`` lies in, in the order of values; lo and hi never share one (lo < hi)."""
    narrow = ((lo > 0) & (hi <= 4 * lo)) | ((hi < 0) & (lo >= 4 * hi))
    power = F.floor(F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1090.0)), F.lit(1090.0)))
    octave = F.when(F.isnan(v), 9999).when(v == 0, 0).otherwise(F.signum(v) * (power + 1100)).cast("long")
    linear = F.least(F.floor((v - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1))
    return F.when(narrow, linear).otherwise(octave)


def _select(rows: DataFrame, keys: list[str], probs: dict[str, list[float]], small: int) -> DataFrame:
    """(keys, _i, _p) for rows of ``keys`` (among them ``_m``, the measure) and ``_v``: each probability's percentile."""
    v = rows.filter(F.col("_v").isNotNull())
    points = F.create_map(*[x for m, ps in probs.items() for x in (
        F.lit(m), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ps)]))])
    stats = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    slots = materialize(
        stats.withColumn("_w", F.explode(points[F.col("_m")])).withColumn("_h", (F.col("_c") - 1) * F.col("_w.p"))
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
        .select(*keys, F.col("_w.i").alias("_i"), "_h", "_r", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_c"))
    is_open = (F.col("_c") > small) & (F.col("_lo") < F.col("_hi"))
    while n := slots.filter(is_open).count():
        todo = slots.filter(is_open)
        spans = todo.select(*keys, "_lo", "_hi").distinct()
        x = _within(v, spans, keys, n).withColumn("_part", part_of(F.col("_v"), F.col("_lo"), F.col("_hi")))
        parts = x.groupBy(*keys, "_lo", "_part").agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        slots = materialize(slots.filter(~is_open).unionByName(
            _at_rank(todo, parts, keys, "_part").select(
                *keys, "_i", "_h", "_r", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"),
                (F.col("_before") + F.col("_end") - F.col("_k")).alias("_before"), F.col("_k").alias("_c"))))
    equal = F.col("_lo") == F.col("_hi")
    todo = slots.filter(~equal)
    values = _within(v, todo.select(*keys, "_lo", "_hi").distinct(), keys, todo.count()).groupBy(*keys, "_lo", "_v").agg(F.count(F.lit(1)).alias("_k"))
    found = _at_rank(todo, values, keys, "_v").select(*keys, "_i", "_h", "_r", F.col("_v").alias("_x")).unionByName(
        slots.filter(equal).select(*keys, "_i", "_h", "_r", F.col("_lo").alias("_x")))
    low = F.max(F.when(F.col("_r") == F.floor("_h"), F.col("_x")))
    high = F.max(F.when(F.col("_r") == F.ceil("_h"), F.col("_x")))
    got = found.groupBy(*keys, "_i", "_h").agg(low.alias("_l"), high.alias("_u"))
    share = F.col("_h") - F.floor("_h")
    return got.select(*keys, "_i", F.when(F.col("_l") == F.col("_u"), F.col("_l")).otherwise(
        (1 - share) * F.col("_l") + share * F.col("_u")).alias("_p"))


def _at_rank(slots: DataFrame, counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Slots with the row of ``counts`` (per keys and _lo, in ``order``) whose running count reaches their rank.
    The window runs over the parts of one interval, or over the at most ``small`` rows left in it."""
    w = Window.partitionBy(*keys, "_lo").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_end", F.sum("_k").over(w))
    rank = F.col("_r") - F.col("_before")
    return _join(slots, ends, [*keys, "_lo"]).filter((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_k")))


def _within(v: DataFrame, spans: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of ``v`` with each interval of their keys that holds them (a group has two per probability at most)."""
    return _join(v, spans, keys, few=n <= BROADCAST_ROWS).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join where a null key equals a null key; ``few``: the right side was counted and is broadcast."""
    r = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(F.broadcast(r) if few else r, on, how).drop(*[f"_r{k}" for k in keys])
