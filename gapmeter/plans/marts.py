"""Registration marts.

Windows partition by country (and class) -- never one global window over the
fact. Parameter tables are literal DataFrames of a handful of rows and are
broadcast explicitly: their size is fixed by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rnd
from ..operators.changes import mean
from .star import UNKNOWN

# Approximate fleet-target parameters (base g/km, slope, M0 kg),
# as published by the reference for its phase-in years and its 15 % step.
TARGET_BASE = (115.00, 0.03330, 1379.88)
TARGET_STEP = (93.60, 0.03330, 1610.00)


def target_parameters(spark: SparkSession, base_years, step_years) -> DataFrame:
    """Parameter table as data (year -> base, a, m0, verified flag)."""
    rows = [(int(y), *TARGET_BASE, False) for y in base_years] + \
           [(int(y), *TARGET_STEP, False) for y in step_years]
    return spark.createDataFrame(rows, "jahr int, basis_g_km double, a_faktor double, m0_kg double, geprueft boolean")


def fleet_target(params: DataFrame, year_col: str, mass: F.Column) -> F.Column:
    """Base + a * (mass - M0), 2 digits; NULL for a year without parameters."""
    return rnd(F.col("basis_g_km") + F.col("a_faktor") * (mass - F.col("m0_kg")), 2)


MIX_CELL = ["ms_code", "land_name", "jahr", "antriebsklasse", "antrieb_label"]


def powertrain_mix(fact_cls: DataFrame) -> DataFrame:
    """I3 (A1): per country x year x class: count, share, previous existing
    year's count, change in percentage points, mean CO2 and mass, status.
    Rows have the country's code and name, or only the code as ``ms``."""
    if "ms_code" not in fact_cls.columns:
        fact_cls = fact_cls.withColumnRenamed("ms", "ms_code")
    if "land_name" not in fact_cls.columns:
        fact_cls = fact_cls.withColumn("land_name", F.lit(UNKNOWN))
    return _mix(fact_cls.groupBy(*MIX_CELL)
                .agg(F.count(F.lit(1)).alias("zulassungen"), F.avg("co2_wltp").alias("_co2"),
                     F.avg("masse_kg").alias("_m"), F.max("data_status").alias("data_status")))


def mix_cells(reg: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows as ``changes.partial_sums`` takes them for A1; the status is part of a cell, as a greatest one can't be taken back."""
    named = reg.withColumnRenamed("ms", "ms_code").join(countries.select("ms_code", "land_name"), "ms_code", "left")
    return named.select("jahr", "src_id", "ms_code", F.coalesce("land_name", F.lit(UNKNOWN)).alias("land_name"), "antriebsklasse", S.class_label("antriebsklasse").alias("antrieb_label"),
                      "data_status", "co2_wltp", "masse_kg")


def powertrain_mix_of_cells(cells: DataFrame) -> DataFrame:
    """I3 (A1) from partial sums per cell and status."""
    one = cells.groupBy(*MIX_CELL).agg(
        F.sum("n").alias("zulassungen"), F.max("data_status").alias("data_status"),
        *[F.sum(f"{k}_{m}").alias(f"{k}_{m}") for m in ("co2_wltp", "masse_kg") for k in ("s", "n")])
    return _mix(one.withColumn("_co2", mean("co2_wltp")).withColumn("_m", mean("masse_kg")))


def _mix(base: DataFrame) -> DataFrame:
    cy = Window.partitionBy("ms_code", "jahr")
    w = Window.partitionBy("ms_code", "antriebsklasse").orderBy("jahr")
    a = (base.withColumn("zulassungen_land_jahr", F.sum("zulassungen").over(cy))
         .withColumn("anteil_prozent", rnd(F.col("zulassungen") * 100.0 / F.col("zulassungen_land_jahr"), 3)))
    return a.select(
        *MIX_CELL, "zulassungen", "zulassungen_land_jahr",
        "anteil_prozent", F.lag("zulassungen").over(w).alias("zulassungen_vorjahr"),
        rnd(F.col("anteil_prozent") - F.lag("anteil_prozent").over(w), 3).alias("delta_prozentpunkte"),
        rnd("_co2", 1).alias("avg_co2_wltp"), rnd("_m", 0).alias("avg_masse_kg"), "data_status")


def country_vs_all(mix: DataFrame, country: str) -> DataFrame:
    """I4 (A2): one country against all loaded countries, built from I3's
    output (its rounded CO2 means weighted by counts, as the reference does)."""
    ref = (mix.groupBy("jahr", "antriebsklasse")
           .agg(F.sum("zulassungen").alias("zul_ref"),
                F.sum(F.col("zulassungen") * F.col("avg_co2_wltp")).alias("_w"),
                F.sum("zulassungen").alias("_n")))
    ref = (ref.withColumn("anteil_ref", rnd(F.col("zul_ref") * 100.0 /
                                            F.sum("zul_ref").over(Window.partitionBy("jahr")), 3))
           .withColumn("co2_ref", rnd(F.try_divide(F.col("_w"), F.nullif(F.col("_n"), F.lit(0))), 1)))
    one = mix.filter(F.col("ms_code") == country).select(
        "jahr", "antriebsklasse", F.col("zulassungen").alias("zul_de"),
        F.col("anteil_prozent").alias("anteil_de"), F.col("avg_co2_wltp").alias("co2_de"))
    j = ref.join(one, ["jahr", "antriebsklasse"], "left")
    return j.select("jahr", "antriebsklasse", "zul_de", "anteil_de", "zul_ref", "anteil_ref",
                    rnd(F.col("anteil_de") - F.col("anteil_ref"), 3).alias("delta_prozentpunkte"),
                    "co2_de", "co2_ref", rnd(F.col("co2_de") - F.col("co2_ref"), 1).alias("delta_co2_g_km"))


def fleet_targets(fact_mp: DataFrame, params: DataFrame, min_units: int = 1000) -> DataFrame:
    """I5 (A3): fleet mean vs approximate target per settlement unit x year."""
    f = fact_mp.filter(F.col("co2_wltp").isNotNull() & F.col("pruefmasse_kg").isNotNull())
    cred = F.coalesce(F.col("oeko_gutschrift"), F.lit(0.0))
    has = F.col("oeko_gutschrift").isNotNull()
    g = (f.groupBy("hersteller_gruppe", "ist_gepoolt", "jahr")
         .agg(F.count(F.lit(1)).alias("zulassungen"),
              F.avg("co2_wltp").alias("_vor"), F.avg(F.col("co2_wltp") - cred).alias("_nach"),
              F.avg("pruefmasse_kg").alias("_pm"), F.avg("oeko_gutschrift").alias("_oeko"),
              F.count(F.when(has, 1)).alias("mit_oeko"),
              F.count(F.when(F.col("antriebsklasse") == "BEV", 1)).alias("_bev"),
              F.count(F.when(F.col("antriebsklasse") == "PHEV", 1)).alias("_phev"))
         .filter(F.col("zulassungen") >= min_units))
    g = g.join(F.broadcast(params), "jahr", "left")       # D18: parameter lookup per group
    ziel = fleet_target(params, "jahr", F.col("_pm"))
    n = F.col("zulassungen")
    return g.select(
        "hersteller_gruppe", "ist_gepoolt", "jahr", "zulassungen",
        rnd("_vor", 2).alias("flottenmittel_vor_oeko"), rnd("_nach", 2).alias("flottenmittel_nach_oeko"),
        rnd("_pm", 1).alias("avg_pruefmasse"), ziel.alias("flottenziel_naeherung"),
        rnd(F.col("_nach") - ziel, 2).alias("abweichung_g_km"),
        rnd(F.col("_vor") - ziel, 2).alias("abweichung_ohne_oeko_g_km"),
        rnd("_oeko", 3).alias("avg_oeko_gutschrift"), "mit_oeko",
        rnd(F.col("mit_oeko") * 100.0 / n, 2).alias("anteil_oeko_prozent"),
        rnd(F.col("_bev") * 100.0 / n, 2).alias("anteil_bev_prozent"),
        rnd(F.col("_phev") * 100.0 / n, 2).alias("anteil_phev_prozent"))


def target_summary(targets: DataFrame) -> DataFrame:
    """I6 (A3b): units per year reaching / missing the target, thanks to credits, in pools."""
    a, b = F.col("abweichung_g_km"), F.col("abweichung_ohne_oeko_g_km")
    return targets.groupBy("jahr").agg(
        F.count(F.lit(1)).alias("einheiten"),
        F.count(F.when(a <= 0, 1)).alias("ziel_erreicht"),
        F.count(F.when(a > 0, 1)).alias("ziel_verfehlt"),
        F.count(F.when((a <= 0) & (b > 0), 1)).alias("nur_dank_oeko"),
        F.count(F.when((a <= 0) & F.col("ist_gepoolt"), 1)).alias("ziel_erreicht_im_pool"))


def mass_histogram(raw: DataFrame, width: int = 50) -> DataFrame:
    """Source-side pre-aggregation: bucket (int(mass) div width) * width
    per year x country x fuel with count and means (published to 4 digits)."""
    m = S.parse_number("m_kg")
    return (raw.groupBy(S.parse_number("jahr").cast("int").alias("jahr"), S.upper_code("ms").alias("ms"),
                        ((m.cast("int") / width).cast("int") * width).alias("mass_bucket"),
                        S.fold_case("ft").alias("ft"))
            .agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(m), 4).alias("avg_mass"),
                 rnd(F.avg(S.parse_number("ewltp")), 4).alias("avg_ewltp"),
                 rnd(F.avg(S.parse_number("enedc")), 4).alias("avg_enedc"),
                 rnd(F.avg(S.parse_number("ep_kw")), 4).alias("avg_kw")))


def mass_trend(hist: DataFrame, fact_c: DataFrame) -> DataFrame:
    """I7 (A6): histogram years and fact years with source marker, 3-row
    rolling means and change since the first year, per country."""
    h = (hist.groupBy("jahr", F.col("ms").alias("ms_code"))
         .agg(F.sum("n").alias("zulassungen"),
              F.try_divide(F.sum(F.col("avg_mass") * F.col("n")), F.nullif(F.sum("n"), F.lit(0))).alias("_m"),
              F.try_divide(F.sum(F.col("avg_ewltp") * F.col("n")),
                           F.nullif(F.sum(F.when(F.col("avg_ewltp").isNotNull(), F.col("n"))), F.lit(0))).alias("_c"))
         .withColumn("quelle", F.lit("histogramm")))
    a = (fact_c.groupBy("jahr", F.col("ms").alias("ms_code"))
         .agg(F.count(F.lit(1)).alias("zulassungen"), F.avg("masse_kg").alias("_m"), F.avg("co2_wltp").alias("_c"))
         .withColumn("quelle", F.lit("faktentabelle")))
    u = h.unionByName(a)
    w = Window.partitionBy("ms_code").orderBy("jahr")
    roll = w.rowsBetween(-2, 0)
    return u.select(
        "ms_code", "jahr", "quelle", F.col("zulassungen").cast("bigint").alias("zulassungen"),
        rnd("_m", 1).alias("avg_masse_kg"), rnd("_c", 1).alias("avg_co2_wltp"),
        rnd(F.avg("_m").over(roll), 1).alias("masse_gleitend_3j"),
        rnd(F.avg("_c").over(roll), 1).alias("co2_gleitend_3j"),
        rnd(F.col("_m") - F.first("_m").over(w), 1).alias("masse_delta_zum_start"),
        rnd(F.col("_c") - F.first("_c").over(w), 1).alias("co2_delta_zum_start"))
