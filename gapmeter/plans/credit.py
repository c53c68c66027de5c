"""Eco-innovation credit test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rnd
from ..operators.quantiles import grouped_percentiles

def _group() -> F.Column:
    return F.when(S.positive_flag("oeko_gutschrift"), "mit Gutschrift").otherwise("ohne Gutschrift")


def adoption(reg: DataFrame, country: str) -> DataFrame:
    """Per year: vehicles, with credit, share, mean credit where > 0, largest."""
    r = reg.filter(F.col("ms") == country)
    pos = S.positive_flag("oeko_gutschrift")
    return r.groupBy("jahr").agg(
        F.count(F.lit(1)).alias("fahrzeuge"), F.count(F.when(pos, 1)).alias("mit_gutschrift"),
        rnd(F.try_divide(F.count(F.when(pos, 1)) * 100.0, F.nullif(F.count(F.lit(1)), F.lit(0))), 1).alias("anteil_prozent"),
        rnd(F.avg(F.when(F.col("oeko_gutschrift") > 0, F.col("oeko_gutschrift"))), 2).alias("mittlere_gutschrift_g_km"),
        F.max("oeko_gutschrift").alias("groesste_gutschrift"))


def _fuel_rows(reg: DataFrame, country: str) -> DataFrame:
    return reg.filter((F.col("ms") == country) & F.col("ft").isin("petrol", "diesel")
                      & (F.col("verbrauch_l") > 0) & (F.col("co2_wltp") > 0))


def _ratio(num) -> F.Column:
    return F.try_divide(num, F.nullif(F.col("verbrauch_l"), F.lit(0.0))) * 100


def factor_mean(reg: DataFrame, country: str) -> DataFrame:
    """Mean of ratios, as reported and with the credit added back, per fuel x group."""
    cred = F.coalesce("oeko_gutschrift", F.lit(0.0))
    return _fuel_rows(reg, country).groupBy("ft", _group().alias("gruppe")).agg(
        F.count(F.lit(1)).alias("fahrzeuge"), rnd(F.avg(cred), 2).alias("gutschrift_g_km"),
        rnd(F.avg(_ratio(F.col("co2_wltp"))), 1).alias("faktor_wie_gemeldet"),
        rnd(F.avg(_ratio(F.col("co2_wltp") + cred)), 1).alias("faktor_zurueckaddiert"))


def factor_median(reg: DataFrame, country: str) -> DataFrame:
    """Median of the same ratios."""
    cred = F.coalesce("oeko_gutschrift", F.lit(0.0))
    rows = _fuel_rows(reg, country).select("ft", _group().alias("gruppe"), _ratio(F.col("co2_wltp")).alias("a"),
                                           _ratio(F.col("co2_wltp") + cred).alias("b"))
    return grouped_percentiles(rows, ["ft", "gruppe"], {"_a": ("a", 0.5), "_b": ("b", 0.5)}, [F.count(F.lit(1)).alias("fahrzeuge")]).select(
        "ft", "gruppe", "fahrzeuge", rnd("_a", 1).alias("faktor_median"), rnd("_b", 1).alias("faktor_median_zurueckaddiert"))


def credit_size(reg: DataFrame, country: str) -> DataFrame:
    """Ratio of means: mean credit relative to mean CO2 per class."""
    r = reg.filter((F.col("ms") == country) & (F.col("co2_wltp") > 0))
    cred = F.coalesce("oeko_gutschrift", F.lit(0.0))
    return r.groupBy("antriebsklasse").agg(
        F.count(F.lit(1)).alias("fahrzeuge"), rnd(F.avg("co2_wltp"), 1).alias("co2_offiziell"),
        rnd(F.avg(cred), 2).alias("mittlere_gutschrift"),
        rnd(F.try_divide(F.avg(cred) * 100.0, F.nullif(F.avg("co2_wltp"), F.lit(0.0))), 2).alias("anteil_prozent"))
