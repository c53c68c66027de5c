"""Training-set preparation and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from .core import analysable

FEATURES = ["masse_kg", "leistung_kw", "fc_wltp", "co2_wltp", "dist_total_km"]
ZERO_FILLED = ["hubraum_cm3", "e_reichweite_km"]


def _complete(cols) -> F.Column:
    c = F.lit(True)
    for x in cols:
        c = c & F.col(x).isNotNull()
    return c


def completeness_cost(rw: DataFrame, lo: float = -50, hi: float = 900) -> DataFrame:
    """Rows before, after the outlier band, after requiring all features."""
    a = analysable(rw)
    band = F.col("gap_pct").between(lo, hi)
    full = band & _complete(FEATURES)
    return a.agg(F.count(F.lit(1)).alias("grundgesamtheit"), F.count(F.when(band, 1)).alias("nach_ausreissergrenze"),
                 F.count(F.when(full, 1)).alias("trainingsbasis"),
                 rnd(F.try_divide(F.count(F.when(full, 1)) * 100.0, F.nullif(F.count(F.lit(1)), F.lit(0))), 2)
                 .alias("anteil_prozent"))


def feature_missing(rw: DataFrame) -> DataFrame:
    """Missing count per feature in ONE scan (conditional counts + unpivot)."""
    a = analysable(rw)
    names = {c: c for c in FEATURES}
    names.update({c: f"{c} (auf 0 gesetzt)" for c in ZERO_FILLED})
    wide = a.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    return (wide.unpivot([], list(names), "merkmal_spalte", "fehlend")
            .select(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
                    [F.col("merkmal_spalte")].alias("merkmal"), "fehlend"))


def filter_bias(rw: DataFrame, lo: float = -50, hi: float = 900) -> DataFrame:
    """Class shares before and after the completeness filter (F7 grand totals)."""
    a = analysable(rw).filter(F.col("gap_pct").between(lo, hi))
    j = a.groupBy("antriebsklasse").agg(F.count(F.lit(1)).alias("vorher"), F.count(F.when(_complete(FEATURES), 1)).alias("nachher"))
    allw = Window.partitionBy()        # over the few class rows of an aggregate
    return j.select("antriebsklasse", "vorher", "nachher",
                    rnd(F.col("vorher") * 100.0 / F.sum("vorher").over(allw), 2).alias("anteil_vorher_pct"),
                    rnd(F.try_divide(F.col("nachher") * 100.0, F.nullif(F.sum("nachher").over(allw), F.lit(0))), 2)
                    .alias("anteil_nachher_pct"))


def plugin_completeness(rw: DataFrame, lo: float = 0, hi: float = 2000) -> DataFrame:
    """The plug-in subset with two more required features."""
    a = analysable(rw).filter(F.col("antriebsklasse") == "PHEV")
    band = F.col("gap_pct").between(lo, hi)
    full = band & _complete(FEATURES + ["anteil_elektrisch", "grid_kwh"])
    return a.agg(F.count(F.lit(1)).alias("phev_gesamt"), F.count(F.when(band, 1)).alias("nach_ausreissergrenze"),
                 F.count(F.when(F.col("anteil_elektrisch").isNull(), 1)).alias("ohne_e_anteil"),
                 F.count(F.when(F.col("grid_kwh").isNull(), 1)).alias("ohne_netzstrom"),
                 F.count(F.when(full, 1)).alias("trainingsbasis"))
