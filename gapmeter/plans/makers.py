"""Maker comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rnd
from ..operators.quantiles import grouped_percentiles
from ..operators.scan import global_rank
from .core import analysable

ICE = ["ICE_BENZIN", "ICE_DIESEL"]


def _base(rw: DataFrame, country: str | None) -> DataFrame:
    df = analysable(rw)
    return df if country is None else df.filter(F.col("land") == country)


def _by_maker(df: DataFrame) -> DataFrame:
    return df.withColumn("hersteller", F.coalesce("mh", F.lit("unbekannt")))


def maker_gap_combustion(rw: DataFrame, country: str | None, min_n: int) -> DataFrame:
    """I15 (A7a): gap per maker, pure combustion cars only, makers with >= min_n."""
    df = _base(rw, country).filter(F.col("antriebsklasse").isin(ICE))
    g = grouped_percentiles(
        _by_maker(df), ["hersteller"],
        {"_w": ("fc_wltp", 0.5), "_r": ("fc_real", 0.5), "_g": ("gap_pct", [0.1, 0.5, 0.9]), "_m": ("masse_kg", 0.5), "_kw": ("leistung_kw", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge"), F.count(F.when(F.col("antriebsklasse") == "ICE_BENZIN", 1)).alias("benziner"),
         F.count(F.when(F.col("antriebsklasse") == "ICE_DIESEL", 1)).alias("diesel")]).filter(F.col("fahrzeuge") >= min_n)          # E16 HAVING
    return g.select("hersteller", "fahrzeuge", "benziner", "diesel", rnd("_w", 2).alias("wltp_l"),
                    rnd("_r", 2).alias("real_l"), rnd(F.col("_g")[1], 1).alias("gap_median_pct"),
                    rnd(F.col("_g")[2], 1).alias("gap_p90_pct"), rnd(F.col("_g")[0], 1).alias("gap_p10_pct"),
                    rnd("_m", 0).alias("masse_kg"), rnd("_kw", 0).alias("leistung_kw"))


def maker_rank(mart: DataFrame) -> DataFrame:
    """Rank by median gap (ties share a rank), distributed global rank."""
    return global_rank(mart, "gap_median_pct", "platz").select(
        "platz", "hersteller", "fahrzeuge", "wltp_l", "real_l", "gap_median_pct", "masse_kg")


def maker_spread(mart: DataFrame) -> DataFrame:
    """Number of makers, best, worst, range, mean and population spread."""
    g = F.col("gap_median_pct")
    return mart.agg(F.count(F.lit(1)).alias("hersteller"), F.min(g).alias("beste_luecke_pct"),
                    F.max(g).alias("schlechteste_luecke_pct"),
                    rnd(F.max(g) - F.min(g), 1).alias("spannweite_pp"), rnd(F.avg(g), 1).alias("mittel_pct"),
                    rnd(F.stddev_pop(g), 1).alias("streuung_pp"))


def maker_gap_plugin(rw: DataFrame, country: str | None, min_n: int) -> DataFrame:
    """I16 (A7b): plug-in hybrids per maker."""
    df = _base(rw, country).filter(F.col("antriebsklasse") == "PHEV")
    g = grouped_percentiles(
        _by_maker(df), ["hersteller"],
        {"_w": ("fc_wltp", 0.5), "_r": ("fc_real", 0.5), "_g": ("gap_pct", 0.5), "_e": ("anteil_elektrisch", 0.5),
         "_rw": ("e_reichweite_km", 0.5), "_m": ("masse_kg", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge")]).filter(F.col("fahrzeuge") >= min_n)
    return g.select("hersteller", "fahrzeuge", rnd("_w", 2).alias("wltp_l"), rnd("_r", 2).alias("real_l"),
                    rnd("_g", 1).alias("gap_median_pct"), rnd("_e", 1).alias("e_anteil_pct"),
                    rnd("_rw", 0).alias("e_reichweite_km"), rnd("_m", 0).alias("masse_kg"))


def range_bands(plugin: DataFrame, edges=((45, "unter 45 km"), (60, "45 bis 60 km")), rest="ueber 60 km") -> DataFrame:
    """Makers grouped by electric-range band."""
    band = S.band_label("e_reichweite_km", edges, rest)
    return (plugin.filter(F.col("e_reichweite_km").isNotNull()).groupBy(band.alias("reichweitenklasse"))
            .agg(F.count(F.lit(1)).alias("hersteller"), F.sum("fahrzeuge").alias("fahrzeuge"),
                 rnd(F.avg("gap_median_pct"), 1).alias("gap_pct"), rnd(F.avg("e_anteil_pct"), 1).alias("e_anteil_pct")))


def mix_effect(rw: DataFrame, combustion: DataFrame, country: str | None, min_n: int) -> DataFrame:
    """I17 (A7c): whole-fleet gap minus combustion-only gap per maker (join USING maker)."""
    df = _base(rw, country)
    g = grouped_percentiles(
        _by_maker(df), ["hersteller"], {"_g": ("gap_pct", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge_gesamt"),
         rnd(F.count(F.when(F.col("antriebsklasse") == "PHEV", 1)) * 100.0 / F.count(F.lit(1)), 1).alias("phev_anteil_pct")])
    g = g.filter(F.col("fahrzeuge_gesamt") >= min_n).select("hersteller", "fahrzeuge_gesamt", "phev_anteil_pct", rnd("_g", 1).alias("gap_gesamt_pct"))
    v = combustion.select("hersteller", F.col("gap_median_pct").alias("gap_nur_verbrenner_pct"))
    return (g.join(v, "hersteller")                              # D12: JOIN USING
            .withColumn("mixeffekt_pp", rnd(F.col("gap_gesamt_pct") - F.col("gap_nur_verbrenner_pct"), 1)))


def mix_effect_corr(mix: DataFrame) -> DataFrame:
    """Correlation of plug-in share and mix effect, 3 digits."""
    return mix.agg(rnd(F.corr("phev_anteil_pct", "mixeffekt_pp"), 3).alias("korrelation"),
                   F.count(F.lit(1)).alias("hersteller"))
