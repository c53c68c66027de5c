"""Grid carbon intensity.

The generation series arrives wide (one column per carrier) or as long
(instant, carrier, MWh) rows. Everything below is a per-instant aggregate:
the shuffle key is the hour, so the work spreads over as many tasks as
there are hours; the factor table has one row per carrier and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rnd

# Carriers of the test series with direct emission factors (g CO2/kWh),
# their renewable flag, and the storage carrier that is excluded from both sums.
# The event types play the carriers.
FACTORS = [
    ("error", 850.0, False),
    ("purchase", 400.0, False),
    ("click", 0.0, True),
    ("view", 0.0, True),
    ("signup", 0.0, False),
]
STORAGE = "signup"


def factor_table(spark: SparkSession, factors=FACTORS) -> DataFrame:
    return spark.createDataFrame(factors, "traeger string, g_co2_je_kwh double, erneuerbar boolean")


def wide_to_long(wide: DataFrame, ts_col: str, carriers: list[str], keep_nulls: bool = False) -> DataFrame:
    """One row per instant x carrier (``unpivot``); NULL values kept or dropped."""
    long = wide.unpivot([ts_col], carriers, "traeger", "mwh")
    return long if keep_nulls else long.filter(F.col("mwh").isNotNull())


def epoch_ms_to_parts(ms_col: str) -> list:
    """Epoch ms -> timestamp and year / month / hour in the session time zone."""
    ts = F.timestamp_millis(F.col(ms_col))
    return [ts.cast("timestamp_ntz").alias("zeitpunkt"), F.year(ts).alias("jahr"), F.month(ts).alias("monat"),
            F.hour(ts).alias("stunde")]


def half_open(ts: F.Column, lo: str, hi: str) -> F.Column:
    """Lo <= ts < hi (applied to the points, not to week stamps)."""
    return (ts >= F.lit(lo).cast("timestamp")) & (ts < F.lit(hi).cast("timestamp"))


def hourly_intensity(long: DataFrame, factors: DataFrame, storage: str = STORAGE) -> DataFrame:
    """Per instant generation, weighted emission, g/kWh and renewable share."""
    j = (long.filter(F.col("traeger") != storage)
         .join(F.broadcast(factors), "traeger"))
    g = (j.groupBy("zeitpunkt")
         .agg(F.sum("mwh").alias("_e"), F.sum(F.col("mwh") * F.col("g_co2_je_kwh")).alias("_w"),
              F.sum(F.when(F.col("erneuerbar"), F.col("mwh"))).alias("_r")))
    return g.select("zeitpunkt", F.year("zeitpunkt").alias("jahr"), F.month("zeitpunkt").alias("monat"),
                    F.hour("zeitpunkt").alias("stunde"),
                    rnd("_e", 3).alias("erzeugung_mwh"), rnd("_w", 3).alias("emission_g_je_kwh_gewichtet"),
                    rnd(F.try_divide(F.col("_w"), F.nullif("_e", F.lit(0.0))), 1).alias("g_co2_je_kwh"),
                    rnd(F.try_divide(F.col("_r") * 100.0, F.nullif("_e", F.lit(0.0))), 1)
                    .alias("anteil_erneuerbar_prozent"))


def yearly_intensity(hourly: DataFrame) -> DataFrame:
    """Hours, mean/min/max intensity, renewable share, TWh per year."""
    return hourly.groupBy("jahr").agg(
        F.count(F.lit(1)).alias("stunden"), rnd(F.avg("g_co2_je_kwh"), 1).alias("mittel_g_kwh"),
        rnd(F.min("g_co2_je_kwh"), 1).alias("min_g_kwh"), rnd(F.max("g_co2_je_kwh"), 1).alias("max_g_kwh"),
        rnd(F.avg("anteil_erneuerbar_prozent"), 1).alias("erneuerbar_prozent"),
        rnd(F.sum("erzeugung_mwh") / 1e6, 4).alias("erzeugung_twh"))


def day_profile(hourly: DataFrame, year: int) -> DataFrame:
    """Mean intensity per hour of day for one year."""
    return (hourly.filter(F.col("jahr") == year).groupBy("stunde")
            .agg(rnd(F.avg("g_co2_je_kwh"), 1).alias("mittel_g_kwh"),
                 rnd(F.avg("anteil_erneuerbar_prozent"), 1).alias("erneuerbar_prozent")))


def series_completeness(long: DataFrame, min_points: int) -> DataFrame:
    """First and last instant and number of points; warn below a minimum."""
    return long.groupBy("traeger").agg(
        F.min("zeitpunkt").alias("erster"), F.max("zeitpunkt").alias("letzter"),
        F.count(F.lit(1)).alias("punkte")).withColumn(
        "bewertung", F.when(F.col("punkte") >= min_points, "ok").otherwise("unvollstaendig"))


# Per-carrier plausibility rule (kind, threshold(s)) in the spirit of
# the reference's sample-week check; kinds: spread_gt, mean_between, min_gt, min_lt, base_load.
RULES = [
    ("click", "spread_gt", 100.0, None),
    ("view", "mean_between", 20.0, 80.0),
    ("purchase", "min_gt", 0.0, None),
    ("error", "base_load", 0.05, 10.0),
    ("signup", "min_lt", 500.0, None),
]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "traeger string, regel string, a double, b double")


def series_plausibility(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Per carrier n, min, max, mean, zero share, spread max/max(1,min) and rule verdict."""
    v = long.filter(F.col("mwh").isNotNull())
    p = v.groupBy("traeger").agg(
        F.count(F.lit(1)).alias("werte"), F.min("mwh").alias("_min"), F.max("mwh").alias("_max"),
        F.avg("mwh").alias("_mit"), (F.count(F.when(F.col("mwh") == 0, 1)) / F.count(F.lit(1))).alias("_null"))
    p = p.withColumn("_sp", F.col("_max") / F.greatest(F.lit(1.0), F.col("_min")))
    j = p.join(F.broadcast(rules), "traeger", "left")
    r, a, b = F.col("regel"), F.col("a"), F.col("b")
    ok = (F.when(r == "spread_gt", F.col("_sp") > a)
          .when(r == "mean_between", (F.col("_mit") > a) & (F.col("_mit") < b))
          .when(r == "min_gt", F.col("_min") > a)
          .when(r == "min_lt", F.col("_min") < a)
          .when(r == "base_load", (F.col("_null") < a) & (F.col("_mit") > b)))
    return j.select("traeger", "werte", rnd("_min", 3).alias("min_mwh"), rnd("_max", 3).alias("max_mwh"),
                    rnd("_mit", 3).alias("mittel_mwh"), rnd("_null", 4).alias("nullanteil"),
                    rnd("_sp", 3).alias("spanne"),
                    F.when(r.isNull(), "keine Regel").when(ok, "ok").otherwise("PRUEFEN").alias("bewertung"))
