"""Real-world gap analyses.

All percentiles are exact interpolated percentiles by ``operators.quantiles``: value->count maps for groups
of bounded size, radix selection for larger ones -- a third of all rows in one drive class --,
so no task holds the values of a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..session import materialize
from ..operators.quantiles import SMALL, grouped_percentiles
from ..operators.scan import global_rank
from .core import analysable


def gap_by_year(rw: DataFrame) -> DataFrame:
    """I8 (A4): per country x class x year, 13 measures incl. p10/p50/p90."""
    g = grouped_percentiles(
        analysable(rw), ["land", "antriebsklasse", "jahr"],
        {"_km": ("dist_total_km", 0.5), "_real": ("fc_real", 0.5), "_wltp": ("fc_wltp", 0.5), "_gapl": ("gap_abs", 0.5),
         "_gp": ("gap_pct", [0.1, 0.5, 0.9]), "_e": ("anteil_elektrisch", 0.5), "_kwh": ("grid_kwh", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge"), F.avg("gap_pct").alias("_avg")])
    return g.select(
        "land", "antriebsklasse", "jahr", "fahrzeuge",
        rnd("_km", 0).alias("median_laufleistung"),
        rnd("_real", 2).alias("median_real_l"),
        rnd("_wltp", 2).alias("median_wltp_l"),
        rnd("_gapl", 2).alias("median_gap_l"),
        rnd(F.col("_gp")[1], 1).alias("median_gap_pct"),
        rnd(F.col("_gp")[2], 1).alias("p90_gap_pct"),
        rnd(F.col("_gp")[0], 1).alias("p10_gap_pct"),
        rnd("_avg", 1).alias("mittelwert_gap_pct"),
        rnd("_e", 1).alias("median_e_anteil_pct"),
        rnd("_kwh", 0).alias("median_netzstrom_kwh"))


def gap_pooled(rw: DataFrame, small: int = SMALL) -> DataFrame:
    """I9 (A4 pooled, the authoritative one): per country x class over all years.
    ``small``: group size from which percentiles are selected in rounds."""
    g = grouped_percentiles(
        analysable(rw), ["land", "antriebsklasse"],
        {"_real": ("fc_real", 0.5), "_wltp": ("fc_wltp", 0.5), "_gapl": ("gap_abs", 0.5), "_gp": ("gap_pct", [0.1, 0.5, 0.9]),
         "_e": ("anteil_elektrisch", 0.5), "_km": ("dist_total_km", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge"), F.min("jahr").alias("jahr_von"), F.max("jahr").alias("jahr_bis")], small)
    return g.select(
        "land", "antriebsklasse", "fahrzeuge",
        rnd("_real", 2).alias("real_l"), rnd("_wltp", 2).alias("wltp_l"),
        rnd("_gapl", 2).alias("gap_l"),
        rnd(F.col("_gp")[1], 1).alias("gap_median_pct"),
        rnd(F.col("_gp")[2], 1).alias("gap_p90_pct"),
        rnd(F.col("_gp")[0], 1).alias("gap_p10_pct"),
        rnd("_e", 1).alias("e_anteil_pct"), rnd("_km", 0).alias("laufleistung_km"),
        "jahr_von", "jahr_bis")


def gap_mean_of_medians(by_year: DataFrame, country: str | None = None) -> DataFrame:
    """Per class, mean of the yearly medians (each year weighs the same).
    Published next to the pooled median, never derived from it (E19)."""
    df = by_year if country is None else by_year.filter(F.col("land") == country)
    return (df.groupBy("antriebsklasse")
            .agg(F.sum("fahrzeuge").cast("bigint").alias("fahrzeuge"),
                 rnd(F.avg("median_real_l"), 2).alias("real_l"),
                 rnd(F.avg("median_wltp_l"), 2).alias("wltp_l"),
                 rnd(F.avg("median_gap_pct"), 1).alias("gap_median_pct"),
                 rnd(F.avg("p90_gap_pct"), 1).alias("gap_p90_pct"),
                 rnd(F.avg("median_e_anteil_pct"), 1).alias("e_anteil_pct")))


def gap_pooled_country(rw: DataFrame, country: str) -> DataFrame:
    """I10 A4a2: pooled median over all years for one country, per class."""
    g = grouped_percentiles(analysable(rw).filter(F.col("land") == country), ["antriebsklasse"],
                            {"_r": ("fc_real", 0.5), "_w": ("fc_wltp", 0.5), "_g": ("gap_pct", [0.5, 0.9])}, [F.count(F.lit(1)).alias("fahrzeuge")])
    return g.select("antriebsklasse", "fahrzeuge", rnd("_r", 2).alias("real_l"),
                    rnd("_w", 2).alias("wltp_l"), rnd(F.col("_g")[0], 1).alias("gap_median_pct"),
                    rnd(F.col("_g")[1], 1).alias("gap_p90_pct"))


def gap_trend(by_year: DataFrame, country: str | None = None,
              classes=("PHEV", "ICE_BENZIN", "ICE_DIESEL", "HEV")) -> DataFrame:
    """The gap by registration year."""
    df = by_year.filter(F.col("antriebsklasse").isin(list(classes)))
    if country is not None:
        df = df.filter(F.col("land") == country)
    return (df.groupBy("jahr", "antriebsklasse")
            .agg(F.sum("fahrzeuge").cast("bigint").alias("n"),
                 rnd(F.avg("median_gap_pct"), 1).alias("gap_median_pct")))


def utility_factor(by_year: DataFrame) -> DataFrame:
    """Plug-in hybrids per country x year: electric share actually driven."""
    return (by_year.filter(F.col("antriebsklasse") == "PHEV").groupBy("land", "jahr")
            .agg(F.sum("fahrzeuge").cast("bigint").alias("phev"),
                 rnd(F.avg("median_e_anteil_pct"), 1).alias("e_anteil_gefahren_pct"),
                 rnd(F.avg("median_netzstrom_kwh"), 0).alias("netzstrom_kwh"),
                 rnd(F.avg("median_gap_pct"), 1).alias("gap_pct")))


def model_medians(rw: DataFrame, country: str | None, min_vehicles: int,
                  class_rule: str = "mode") -> DataFrame:
    """Per model (normalised brand + name): medians of lab, real, gap, mass.

    ``class_rule='mode'`` labels a model with its most frequent class (ties:
    smallest); ``'min'`` reproduces the reference's alphabetical minimum (T4).
    """
    df = analysable(rw)
    if country is not None:
        df = df.filter(F.col("land") == country)
    cls = (F.mode("antriebsklasse", deterministic=True) if class_rule == "mode"
           else F.min("antriebsklasse"))
    return grouped_percentiles(
        df, ["marke_norm", "handelsname_norm"],
        {"wltp_x": ("fc_wltp", 0.5), "real_x": ("fc_real", 0.5), "gap_x": ("gap_pct", 0.5), "masse_x": ("masse_kg", 0.5)},
        [F.min("marke").alias("marke"), F.min("handelsname").alias("modell"), cls.alias("antriebsklasse"),
         F.count(F.lit(1)).alias("fahrzeuge")]).filter(F.col("fahrzeuge") >= min_vehicles)


def rank_reversal(rw: DataFrame, country: str | None = None, min_vehicles: int = 10,
                  class_rule: str = "mode") -> DataFrame:
    """I11 (A5): paper rank vs road rank per model, ranked on unrounded medians.

    The global ranks come from a bucketed two-level scan, not a single-task
    window, so the model table may grow without funnelling into one task.
    """
    m = materialize(model_medians(rw, country, min_vehicles, class_rule))
    m = global_rank(m, "wltp_x", "rang_papier")
    m = global_rank(m, "real_x", "rang_strasse")
    return m.select("marke", "modell", "antriebsklasse", "fahrzeuge",
                    rnd("wltp_x", 2).alias("wltp_l"), rnd("real_x", 2).alias("real_l"),
                    rnd("gap_x", 1).alias("gap_pct"), rnd("masse_x", 0).alias("masse_kg"),
                    "rang_papier", "rang_strasse",
                    (F.col("rang_strasse") - F.col("rang_papier")).alias("rang_differenz"))


def top_movers(reversal: DataFrame, n: int = 25, losers: bool = True) -> DataFrame:
    """I11 top lists: biggest losers (desc) / winners (asc), unique tie-break."""
    d = F.col("rang_differenz").desc() if losers else F.col("rang_differenz").asc()
    return reversal.orderBy(d, "marke", "modell").limit(n)


def gap_pooled_scan(rw: DataFrame, small: int = 50) -> DataFrame:
    """I9 with radix selection for all but the smallest groups: the same numbers as ``gap_pooled``."""
    return gap_pooled(rw, small)
