"""Keep-one-row-per-key.

The reference keeps an arbitrary survivor per key. Here the survivor is the
row that sorts first by the given order (default: every non-key column,
ascending, NULLs first), so the result is the same on every run and in every
engine.

Copies are rare, so the rows don't move for them: a narrow count finds the keys that
occur more than once, all other rows pass where they are, and only rows of those keys
meet. They meet in an aggregate (the least row, combined before the shuffle),
so a key that holds a third of all rows is no task of its own.

Where many keys occur more than once, all rows are shuffled by key, in tasks of a bounded number of rows; only the rows of
crowded keys are combined before the shuffle, as sorting all rows for that would spill. Rows of text columns move as one text each
that sorts like them: a column of a moving row takes 8 bytes, and its text steps of 8, which no shuffle codec makes up for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..session import materialize, passing_shuffles, slices

#: Up to so many repeated keys are broadcast; beyond, copies aren't rare and all rows are shuffled by key.
BROADCAST_KEYS = 500_000


#: Rows that a task gets when all rows are shuffled by key.
ROWS_PER_TASK = 250_000
#: Rows with so many text columns, and no others, move as one text.
PACKED_COLUMNS = 8
#: What ends a column of a packed row, what stands for null, and how the least characters are written inside a column (in the
#: order of replacing): in this way packed rows sort as their columns do, nulls first.
_END, _NULL = "\u0001", "\u0000"
_INSIDE = [("\u0002", "\u0002\u0005"), ("\u0000", "\u0002\u0003"), ("\u0001", "\u0002\u0004")]
#: A key with more rows is combined before the shuffle. There are at most rows / CROWDED such keys.
CROWDED = 50_000


def keep_one(df: DataFrame, keys: list[str], order: list | None = None, broadcast_keys: int = BROADCAST_KEYS,
             derive: Callable[[DataFrame], DataFrame] | None = None, crowded: int = CROWDED) -> DataFrame:
    """``derive`` makes the rows to compare and to keep from rows of ``df``, row by row, and leaves ``keys`` as they are: rows then
    move in the form of ``df`` where all of them move."""
    return next(kept_slices(df, keys, order, broadcast_keys, derive, crowded, sliced=False))


def kept_slices(df: DataFrame, keys: list[str], order: list | None = None, broadcast_keys: int = BROADCAST_KEYS,
                derive: Callable[[DataFrame], DataFrame] | None = None, crowded: int = CROWDED, sliced: bool = True) -> Iterator[DataFrame]:
    """``keep_one`` in slices by key where all rows move: who writes them one after the other has one slice's shuffle on disk."""
    with passing_shuffles(df.sparkSession):
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        s = counts.agg(F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated"), F.max("_n").alias("most")).first()
        many = s["repeated"] > broadcast_keys
        least = crowded if many else 1
        found = materialize(counts.filter(F.col("_n") > least).select(*keys)) if (s["most"] or 0) > least else None
    if many:
        of = slices(s["rows"]) if sliced else 1
        for part in range(of):
            some = df if of == 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(of)) == part)
            yield _first_of_many(some, keys, order, derive, found, math.ceil(s["rows"] / of))
        return
    full = derive(df) if derive else df
    if found is not None:
        full = full.join(*_among(found, keys), "left_anti").unionByName(_first_row(full.join(*_among(found, keys), "left_semi"), keys, order))
    yield full


def _among(found: DataFrame, keys: list[str]) -> tuple:
    """Broadcast side and condition of a join with keys."""
    r = F.broadcast(found.select(*[F.col(k).alias(f"_r{k}") for k in keys]))
    return r, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]


def _first_of_many(df: DataFrame, keys: list[str], order: list | None, derive: Callable | None, hot: DataFrame | None, rows: int) -> DataFrame:
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))
    if hot is None:
        return _first_dealt(df, keys, order, derive, pieces)
    rest, full = df.join(*_among(hot, keys), "left_anti"), df.join(*_among(hot, keys), "left_semi")
    return _first_dealt(rest, keys, order, derive, pieces).unionByName(_first_row(derive(full) if derive else full, keys, order))


def _first_dealt(df: DataFrame, keys: list[str], order: list | None, derive: Callable | None, pieces: int) -> DataFrame:
    """The first row of each key, after a shuffle of all rows by key."""
    rest = [c for c in df.columns if c not in keys]
    if derive or order or len(rest) < PACKED_COLUMNS or any(df.schema[c].dataType != StringType() for c in rest):
        dealt = df.repartition(pieces, *keys)
        return _first_row(derive(dealt) if derive else dealt, keys, order)
    least = df.select(*keys, pack(rest).alias("_row")).repartition(pieces, *keys).groupBy(*keys).agg(F.min("_row").alias("_row"))
    parts = least.select(*keys, F.split("_row", _END, -1).alias("_parts"))
    return parts.select(*keys, *[unpack(F.col("_parts")[i]).alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def pack(columns: list[str]) -> Column:
    """The texts of a row as one, which sorts as they do. ``split`` at _END and ``unpack`` give them back as they were."""
    def packed(c):
        for plain, inside in _INSIDE:
            c = F.replace(c, F.lit(plain), F.lit(inside))
        return F.coalesce(c, F.lit(_NULL))

    return F.concat_ws(_END, *[packed(F.col(c)) for c in columns])


def unpack(part: Column) -> Column:
    text = part
    for plain, inside in reversed(_INSIDE):
        text = F.replace(text, F.lit(inside), F.lit(plain))
    return F.when(part != _NULL, text)


def _first_row(df: DataFrame, keys: list[str], order: list | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if order is None and rest and not any(isinstance(df.schema[c].dataType, MapType) for c in rest):
        least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))     # NULLs sort first in a struct
        return least.select(*keys, "_row.*").select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(k) for k in keys]))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def duplicate_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """H5: groups of identical business rows with count > 1."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, rows that a dedup removes -- one pass of
    partial aggregation per key, then a global sum of a few numbers."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").cast("bigint").alias("rows_total"),
                       F.count(F.lit(1)).alias("distinct_keys"),
                       (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("removed"),
                       F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("keys_with_dups"))
