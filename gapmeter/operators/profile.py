"""Source profiles.

Each profile is one scan of the table: columns are stacked into
(column, value) rows (or aggregated side by side and unpivoted) and grouped
once. The top-N per column uses ``row_number <= N`` on a window partitioned
by column -- Spark inserts a partial per-task group limit before that
shuffle, so a high-cardinality column never funnels all its values into one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import grouped_percentiles
from ..functions.scalars import rnd


def frequency_table(df: DataFrame, cols: list[str], top_cols: list[str] | None = None,
                    top_n: int = 300) -> DataFrame:
    """Value frequencies with share of the column total, descending.
    For ``top_cols`` only the ``top_n`` most frequent values are kept and the
    share is relative to them, as in the reference. The top-N filter stands
    alone on the rank, so Spark plans a partial per-task ``WindowGroupLimit``
    before the shuffle: a high-cardinality column never sends all its values
    to one task. The full lists are only kept for the categorical columns."""
    top_cols = top_cols or []
    allc = cols + top_cols
    st = F.stack(F.lit(len(allc)), *[x for c in allc for x in (F.lit(c), F.col(c).cast("string"))])
    g = df.select(st.alias("spalte", "wert")).groupBy("spalte", "wert").agg(F.count(F.lit(1)).alias("anzahl"))
    parts = [g.filter(F.col("spalte").isin(cols))]
    if top_cols:
        rn = F.row_number().over(Window.partitionBy("spalte").orderBy(F.col("anzahl").desc(),
                                                                        F.col("wert").asc_nulls_first()))
        parts.append(g.filter(F.col("spalte").isin(top_cols)).withColumn("_rn", rn)
                     .filter(F.col("_rn") <= top_n).drop("_rn"))
    kept = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tot = F.sum("anzahl").over(Window.partitionBy("spalte"))
    return kept.select("spalte", S.blank_label("wert").alias("wert"), "anzahl",
                       rnd(F.col("anzahl") * 100.0 / tot, 4).alias("prozent"))


def fill_rates(df: DataFrame, cols: list[str], empty_is_missing: bool = False) -> DataFrame:
    """Filled / missing / % filled per column, one aggregate + unpivot.
    The reference counts '' as filled (COUNT(col)); ``empty_is_missing`` also
    counts blank strings as missing."""
    def filled(c):
        x = F.col(c)
        return F.count(F.when(x.isNotNull() & (F.trim(x) != ""), 1)) if empty_is_missing else F.count(x)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[filled(c).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "spalte", "belegt")
    return long.select("spalte", "belegt", (F.col("_n") - F.col("belegt")).alias("fehlt"),
                       rnd(F.col("belegt") * 100.0 / F.col("_n"), 3).alias("prozent_belegt"))


def value_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min / max / mean per numeric column (text parsed), one aggregate."""
    aggs = []
    for c in cols:
        v = S.parse_number(c)
        aggs += [F.min(v).alias(f"{c}__mn"), F.max(v).alias(f"{c}__mx"), F.avg(v).alias(f"{c}__av")]
    wide = df.agg(*aggs)
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(f"{c}__mn"), F.col(f"{c}__mx"),
                                                                F.col(f"{c}__av"))])
    long = wide.select(st.alias("spalte", "minimum", "maximum", "_av"))
    return long.select("spalte", "minimum", "maximum", rnd("_av", 2).alias("mittelwert"))


def cross_table(df: DataFrame, a: str, b: str, mean1: str, mean2: str) -> DataFrame:
    """Long-form cross table of two columns with share and two means."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("anzahl"), F.avg(S.parse_number(mean1)).alias("_m1"),
                             F.avg(S.parse_number(mean2)).alias("_m2"))
    tot = F.sum("anzahl").over(Window.partitionBy())     # over the (few) cells of an aggregate
    return g.select(a, b, "anzahl", rnd(F.col("anzahl") * 100.0 / tot, 4).alias("prozent"),
                    rnd("_m1", 1).alias(f"avg_{mean1}"), rnd("_m2", 0).alias(f"avg_{mean2}"))


def quartile_class(df: DataFrame, col: str) -> DataFrame:
    """Colour class by quartiles of a mart column (<= Q1, >= Q3, else).
    The two quartiles are one aggregate row, read as two numbers."""
    row = grouped_percentiles(df.select(F.lit(1).alias("_all"), F.col(col).alias("_x")), ["_all"], {"q": ("_x", [0.25, 0.75])}).first()
    q1, q3 = row["q"] if row and row["q"] else (None, None)
    c = F.col(col)
    return df.withColumn("quartil_klasse", F.when(c <= F.lit(q1), "unteres Quartil")
                         .when(c >= F.lit(q3), "oberes Quartil").otherwise("Mitte"))
