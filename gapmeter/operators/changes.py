"""Corrections: what changed between two versions of a table, and marts kept up to date by it.

Provisional years are replaced by final ones. Most rows stay as they are, so the versions are compared by a narrow
digest per key, only rows of changed keys are read in full, and a mart of sums takes the difference of
sums instead of a rebuild. Sums are exact decimals, so taking a row out leaves no trace of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ADDED, REMOVED, CHANGED = "neu", "entfallen", "geaendert"
#: Up to so many changed keys are broadcast; more are joined by key.
BROADCAST_KEYS = 500_000


def change_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, art): keys that only ``new`` has, only ``old`` has, or whose row differs in any other column.
    A key (NULL included) names one row in each version at most. Columns are compared by name."""
    cols = sorted(c for c in new.columns if c not in keys)
    if sorted(c for c in old.columns if c not in keys) != cols:
        raise ValueError("versions differ in their columns")

    def side(df: DataFrame, tag: str) -> DataFrame:
        # 128 bits of a SHA-256, not their spelling: every key of both versions is shuffled with it
        digest = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*cols)), 256)), 1, 16) if cols else F.lit(b"")
        return df.select(*[F.col(k).alias(f"_{tag}{k}") for k in keys], digest.alias(f"_{tag}d"))
    a, b = side(old, "o"), side(new, "n")
    j = a.join(b, [F.col(f"_o{k}").eqNullSafe(F.col(f"_n{k}")) for k in keys], "full")
    art = F.when(F.col("_od").isNull(), ADDED).when(F.col("_nd").isNull(), REMOVED).when(F.col("_od") != F.col("_nd"), CHANGED)
    return j.withColumn("art", art).filter(F.col("art").isNotNull()).select(
        *[F.when(F.col("_nd").isNull(), F.col(f"_o{k}")).otherwise(F.col(f"_n{k}")).alias(k) for k in keys], "art")


def rows_of(df: DataFrame, changes: DataFrame, keys: list[str], arts: list[str], few: bool) -> DataFrame:
    """Rows of ``df`` whose key is in ``changes`` with one of ``arts``."""
    c = changes.filter(F.col("art").isin(arts)).select(*[F.col(k).alias(f"_c{k}") for k in keys])
    return df.join(F.broadcast(c) if few else c, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys], "left_semi")


def partial_sums(df: DataFrame, by: list[str], measures: list[str], sign: Column | None = None) -> DataFrame:
    """Per ``by``: n, and per measure its exact sum ``s_`` and number of values ``n_``; ``sign`` +1 or -1 per row."""
    sign = F.lit(1) if sign is None else sign
    aggs = [F.sum(sign).cast("bigint").alias("n")]
    for m in measures:
        exact = F.col(m).cast("decimal(20,6)")
        aggs += [F.coalesce(F.sum(exact * sign), F.lit(0)).cast("decimal(38,6)").alias(f"s_{m}"),
                 F.sum(F.when(F.col(m).isNotNull(), sign).otherwise(0)).cast("bigint").alias(f"n_{m}")]
    return df.groupBy(*by).agg(*aggs)


def maintain(cells: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], by: list[str], measures: list[str]) -> DataFrame:
    """Cells of ``partial_sums`` over ``old``, brought to ``new``: only rows of changed keys are added up. A cell
    that has lost all its rows goes."""
    changes = materialize(change_set(old, new, keys))
    few = changes.count() <= BROADCAST_KEYS
    out = rows_of(old, changes, keys, [REMOVED, CHANGED], few).withColumn("_sign", F.lit(-1))
    into = rows_of(new, changes, keys, [ADDED, CHANGED], few).withColumn("_sign", F.lit(1))
    delta = partial_sums(out.unionByName(into), by, measures, F.col("_sign"))
    sums = [c for c in cells.columns if c not in by]
    return (cells.unionByName(delta).groupBy(*by).agg(*[F.sum(c).cast(cells.schema[c].dataType).alias(c) for c in sums])
            .filter(F.col("n") > 0))


def mean(measure: str) -> Column:
    """Mean of a measure from its sum and count."""
    return F.try_divide(F.col(f"s_{measure}").cast("double"), F.nullif(F.col(f"n_{measure}"), F.lit(0)))
