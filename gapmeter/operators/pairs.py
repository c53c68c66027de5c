"""Theta-join answers without materialising pairs.

The reference counts (combustion, plug-in) model pairs with a cross join and
a ``>`` predicate. Here every number comes from sorted scans:

* ``dominated``   -- pairs with point.x < query.x and point.y > query.y. Ranks replace
                     values; a rank's lower ranks are a union of at most log2(N) dyadic
                     ranges, so a point stands in one range per level, a query in those
                     that make up its prefix, and within a range a weighted prefix sum
                     over the rank of y counts (``scan.weighted_less``). log2(N) rows per
                     row, no pairs, equal values collapsed to one row with a count;
* ``prefix_max``  -- best partner value per query (running max);
* the top-k list  -- exact: a pair among the first k has its combustion end among the k
                     first by best score and name; those k rows meet the plug-in models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..session import materialize
from .scan import global_rank, in_ranges, weighted_less

ICE = ["ICE_BENZIN", "ICE_DIESEL"]


def prefix_max(points: DataFrame, queries: DataFrame, x: str, y: str, key: list[str], out: str) -> DataFrame:
    """For each query: max(points.y) over points with points.x < query.x (NULL if none)."""
    q = queries.withColumn("_qid", F.to_json(F.struct(*key)))
    u = (points.select(F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"),
                       F.lit(1).alias("_isp"), F.lit(None).cast("string").alias("_qid"))
         .unionByName(q.select(F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"),
                               F.lit(0).alias("_isp"), "_qid"))
         .filter(F.col("_x").isNotNull()))
    u = in_ranges(u, "_x")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = u.groupBy("_p").agg(F.max("_y").alias("_m")).select("_p", F.max("_m").over(before).alias("_off"))    # a row per range
    w = (Window.partitionBy("_p").orderBy(F.col("_x").asc(), F.col("_isp").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    res = (u.join(F.broadcast(offs), "_p")
           .withColumn("_run", F.max("_y").over(w))
           .filter(F.col("_isp") == 0)
           .select("_qid", F.greatest("_run", "_off").alias(out)))
    return q.join(res, "_qid", "left").drop("_qid")


def _ranked(points: DataFrame, queries: DataFrame, x: str, y: str) -> DataFrame:
    """(rx, ry, points, queries): ranks of x ascending and y descending over both sides, with
    counts. Rows with a null x or y are in no pair."""
    both = (points.select(F.col(x).cast("double").alias("_x"), (-F.col(y).cast("double")).alias("_y"), F.lit(1).alias("p"), F.lit(0).alias("q"))
            .unionByName(queries.select(F.col(x).cast("double").alias("_x"), (-F.col(y).cast("double")).alias("_y"), F.lit(0).alias("p"), F.lit(1).alias("q"))))
    both = both.where("_x is not null and _y is not null").groupBy("_x", "_y").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = global_rank(global_rank(materialize(both), "_x", "rx"), "_y", "ry")
    return materialize(both.select(F.col("rx").cast("long").alias("rx"), F.col("ry").cast("long").alias("ry"), "p", "q"))


def dominated(ranked: DataFrame) -> DataFrame:
    """One row, column ``n``: pairs of a point and a query with smaller rx and smaller ry of the point."""
    top = ranked.agg(F.max("rx")).first()[0] or 0
    level = F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length()))).alias("level")
    at_points = ranked.where("p > 0").select(level, "rx", "ry", "p").select(
        "level", F.expr("shiftright(rx, level)").alias("node"), "ry", "p", F.lit(0).cast("long").alias("q"))
    at_queries = ranked.where("q > 0").select(level, "rx", "ry", "q").where("shiftright(rx, level) % 2 = 1").select(
        "level", F.expr("shiftright(rx, level) - 1").alias("node"), "ry", F.lit(0).cast("long").alias("p"), "q")
    return weighted_less(at_points.unionByName(at_queries), ["level", "node"], "ry", "p", "q")


def reversal_pair_counts(rev: DataFrame) -> DataFrame:
    """Pairs (combustion i, plug-in p) with i.wltp > p.wltp, how many
    of them have i.real < p.real, and the share -- no pair is materialised."""
    ice = rev.filter(F.col("antriebsklasse").isin(ICE)).withColumn("real_l", F.coalesce("real_l", F.lit(float("inf"))))
    phev = rev.filter(F.col("antriebsklasse") == "PHEV").withColumn("real_l", F.coalesce("real_l", F.lit(float("-inf"))))
    r = _ranked(phev, ice, "wltp_l", "real_l")   # a missing real value is in a pair, but never better
    every = weighted_less(r, [], "rx", "p", "q").withColumnRenamed("n", "modellpaare")
    better = dominated(r).withColumnRenamed("n", "verbrenner_real_besser")
    one = every.withColumn("_k", F.lit(0)).join(better.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return one.withColumn("anteil_prozent", rnd(F.try_divide(F.col("verbrenner_real_besser") * 100.0, F.nullif("modellpaare", F.lit(0))), 1))


def reversal_pair_list(rev: DataFrame, k: int = 25) -> DataFrame:
    """I12 A5d: the k pairs with the largest p.real - i.real among
    i.wltp > p.wltp and i.real < p.real, ties by both names."""
    name = F.concat(F.col("marke"), F.lit(" "), F.col("modell"))
    side = rev.select(name.alias("name"), "antriebsklasse", "wltp_l", "real_l")
    ice, phev = side.filter(F.col("antriebsklasse").isin(ICE)), side.filter(F.col("antriebsklasse") == "PHEV")
    best = prefix_max(phev, ice, "wltp_l", "real_l", ["name", "antriebsklasse", "wltp_l", "real_l"], "_best") \
        .withColumn("_s", F.col("_best") - F.col("real_l")).filter(F.col("_s") > 0)
    # whoever isn't among these k has k pairs of others before all of its own; k rows at most
    first = best.orderBy(F.col("_s").desc(), "name").limit(k).collect()
    if not first:
        return _empty_list(rev)
    i = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["antriebsklasse"]).alias("cls"), F.lit(r["wltp_l"]).cast("double").alias("wltp_l"),
                                     F.lit(r["real_l"]).cast("double").alias("real_l")) for r in first])).alias("i")
    pairs = phev.select("name", "wltp_l", "real_l", i).filter((F.col("i.wltp_l") > F.col("wltp_l")) & (F.col("i.real_l") < F.col("real_l")))
    return (pairs.select(
        F.col("i.name").alias("verbrenner"), F.col("i.cls").alias("antriebsklasse"),
        F.col("i.wltp_l").alias("v_papier"), F.col("i.real_l").alias("v_strasse"), F.col("name").alias("phev"),
        F.col("wltp_l").alias("p_papier"), F.col("real_l").alias("p_strasse"),
        rnd(F.col("i.real_l") - F.col("real_l"), 2).alias("differenz_real_l"), (F.col("real_l") - F.col("i.real_l")).alias("_d"))
        .orderBy(F.col("_d").desc(), "verbrenner", "phev").limit(k).drop("_d"))


def _empty_list(rev: DataFrame) -> DataFrame:
    return rev.limit(0).select(
        F.lit(None).cast("string").alias("verbrenner"), F.col("antriebsklasse"),
        F.lit(None).cast("double").alias("v_papier"), F.lit(None).cast("double").alias("v_strasse"),
        F.lit(None).cast("string").alias("phev"), F.lit(None).cast("double").alias("p_papier"),
        F.lit(None).cast("double").alias("p_strasse"), F.lit(None).cast("double").alias("differenz_real_l"))
