"""Dense surrogate keys that persist.

Numbers come without a global sort or a single task: rows are counted per partition, running totals give each partition
its first number, and a row's place in its partition does the rest. Members of a dimension keep their number over
reloads; only members that the stored key table lacks get the next ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def numbered(df: DataFrame, column: str, first: int = 1, stable: bool = False) -> DataFrame:
    """``df`` with consecutive numbers from ``first`` in ``column``, in no particular order.

    Counting and numbering must see the same partitions, so the rows are written out in between. ``stable`` says that they
    are a plain scan of a finished table, whose partitions are the same each time.
    """
    rows = (df if stable else materialize(df)).withColumn("_p", F.spark_partition_id())
    total, offsets = first, []
    for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():     # one row per partition
        offsets.append((r["_p"], total))
        total += r["n"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = df.sparkSession.createDataFrame(offsets, "_p int, _first long")
    return rows.withColumn("_i", place).join(F.broadcast(start), "_p").withColumn(column, F.col("_first") + F.col("_i")).drop("_p", "_i", "_first")


def extend(stored: DataFrame | None, members: DataFrame, natural: list[str], sk: str) -> DataFrame:
    """Key table (``natural``, ``sk``) of all members ever seen: stored numbers stay, new members get the next ones."""
    now = members.select(*natural).distinct()
    if stored is None:
        return numbered(now, sk)
    old = stored.select(*[F.col(c).alias(f"_s{c}") for c in natural])
    fresh = now.join(old, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in natural], "left_anti")
    last = stored.agg(F.max(sk)).first()[0] or 0
    return stored.select(*natural, sk).unionByName(numbered(fresh, sk, last + 1).select(*natural, sk))


def with_keys(dim: DataFrame, keys: DataFrame, natural: list[str], sk: str) -> DataFrame:
    """A dimension's rows with their stored key. Attributes come from ``dim``, so they may change while the key stays."""
    k = keys.select(*[F.col(c).alias(f"_k{c}") for c in natural], sk)
    on = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in natural]
    return dim.join(k, on).select(sk, *dim.columns)


def key_report(keys: DataFrame, sk: str, first: int = 1) -> DataFrame:
    """One row: rows, least and greatest key, distinct keys, and whether they are unique and without gaps."""
    one = keys.agg(F.count(F.lit(1)).alias("zeilen"), F.min(sk).alias("sk_min"), F.max(sk).alias("sk_max"), F.countDistinct(sk).alias("sk_distinct"))
    whole = (F.col("zeilen") == F.col("sk_distinct")) & (F.col("sk_min") == first) & (F.col("sk_max") == first + F.col("zeilen") - 1)
    return one.withColumn("lueckenlos", F.coalesce(whole, F.col("zeilen") == 0))
