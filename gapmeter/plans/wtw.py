"""Well-to-wheel comparison.

Per drive class of one country: measured medians from the meter table, BEV
from the registration lab values, the grid's mean intensity from the hourly
mart, and three BEV mark-up scenarios. The class table has one row per
class, so expanding it by scenarios is an ``explode`` of a literal array on
each row; the grid mean is a single number read from its one-row aggregate.
No join without a key is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators.quantiles import grouped_percentiles

# Direct combustion emission per litre of fuel (g CO2/l).
FUEL_FACTORS = [
    ("petrol", 2278.0), ("diesel", 2631.0), ("petrol/electric", 2278.0),
    ("diesel/electric", 2631.0), ("e85", 1600.0), ("lpg", 1660.0), ("ng", 1620.0),
]
# BEV consumption mark-up scenarios on the lab value.
SCENARIOS = [("optimistisch", 1.00), ("mittel", 1.15), ("konservativ", 1.30)]
# Grid intensities (g/kWh) of the break-even sensitivity grid.
MIX_GRID = [0.0, 100.0, 200.0, 300.0, 350.0, 400.0, 450.0, 500.0, 600.0]


def fuel_factor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FUEL_FACTORS, "kraftstoff string, g_co2_je_l double")


def grid_mean(hourly: DataFrame) -> float | None:
    """Mean hourly intensity, 1 digit -- one number from a one-row aggregate."""
    row = hourly.agg(rnd(F.avg("g_co2_je_kwh"), 1).alias("g")).first()
    return None if row is None else row["g"]


def class_basis(rw: DataFrame, reg: DataFrame, factors: DataFrame, country: str) -> DataFrame:
    """Measured medians per class (not BEV: the meter has no BEV measurement,
    trap T15) plus the BEV row from registration lab values."""
    r = rw.filter((F.col("land") == country) & F.col("eea_verwendbar") & F.col("hat_mindestlauf")
                  & (F.col("antriebsklasse") != "BEV"))
    kwh = F.when((F.col("dist_total_km") > 0) & F.col("grid_kwh").isNotNull(),
                 F.col("grid_kwh") / F.col("dist_total_km") * 100)
    none = F.lit(None).cast("double")
    comb = grouped_percentiles(
        r.withColumn("_kwh", kwh).join(F.broadcast(factors), r.ft == factors.kraftstoff, "left"), ["antriebsklasse"],       # D7
        {"fc_real": ("fc_real", 0.5), "fc_wltp": ("fc_wltp", 0.5), "co2_wltp": ("co2_wltp", 0.5), "masse_kg": ("masse_kg", 0.5), "kwh_je_100km": ("_kwh", 0.5)},
        [F.count(F.lit(1)).alias("fahrzeuge"), F.mode("ft", deterministic=True).alias("ft_haeufigster"), rnd(F.avg("g_co2_je_l"), 1).alias("faktor_g_je_l")])
    b = reg.filter((F.col("ms") == country) & (F.col("antriebsklasse") == "BEV") & F.col("strom_wh_km").isNotNull())
    bev = grouped_percentiles(b, ["antriebsklasse"], {"co2_wltp": ("co2_wltp", 0.5), "masse_kg": ("masse_kg", 0.5), "wh_je_km_wltp": ("strom_wh_km", 0.5)},
                              [F.count(F.lit(1)).alias("fahrzeuge")])
    one = rw.sparkSession.range(1).select(F.lit("BEV").alias("antriebsklasse"))       # a row even without any BEV
    bev = one.join(bev, "antriebsklasse", "left").withColumn("fahrzeuge", F.coalesce("fahrzeuge", F.lit(0)))
    cols = ["antriebsklasse", "fahrzeuge", "fc_real", "fc_wltp", "co2_wltp", "masse_kg", "kwh_je_100km", "wh_je_km_wltp", "ft_haeufigster", "faktor_g_je_l", "quelle_real"]
    comb = comb.withColumns({"wh_je_km_wltp": none, "quelle_real": F.lit("OBFCM gemessen")}).select(cols)
    bev = bev.withColumns({"fc_real": none, "fc_wltp": none, "kwh_je_100km": none, "ft_haeufigster": F.lit("electric"), "faktor_g_je_l": none,
                           "quelle_real": F.lit("WLTP Laborwert")}).select(cols)
    return comb.unionByName(bev)


def scenarios(basis: DataFrame, g_kwh: float | None) -> DataFrame:
    """Expand each class row by the BEV scenarios and compute the terms."""
    sc = F.array(*[F.struct(F.lit(n).alias("s"), F.lit(a).alias("a")) for n, a in SCENARIOS])
    x = basis.withColumn("_sc", F.explode(sc)).withColumn("_g", F.lit(g_kwh).cast("double"))
    fc, fak = F.coalesce("fc_real", F.lit(0.0)), F.coalesce("faktor_g_je_l", F.lit(0.0))
    kwh, wh = F.coalesce("kwh_je_100km", F.lit(0.0)), F.coalesce("wh_je_km_wltp", F.lit(0.0))
    a, g = F.col("_sc.a"), F.col("_g")
    exhaust, grid_p, grid_b = fc * fak / 100, kwh * g / 100, wh * a * g / 1000
    total = exhaust + grid_p + F.when(F.col("antriebsklasse") == "BEV", grid_b).otherwise(0.0)
    return x.select(
        "antriebsklasse", "fahrzeuge", "quelle_real", "ft_haeufigster", "faktor_g_je_l",
        rnd("masse_kg", 0).alias("masse_kg"), rnd("co2_wltp", 1).alias("co2_offiziell"),
        rnd(exhaust, 1).alias("co2_auspuff_real"), rnd(grid_p, 1).alias("co2_strom_phev"),
        rnd(grid_b, 1).alias("co2_strom_bev"), rnd(total, 1).alias("co2_wtw_gesamt"),
        F.col("_sc.s").alias("bev_szenario"), a.alias("bev_aufschlag"), g.alias("strommix_g_kwh"),
        rnd("fc_real", 2).alias("fc_real"), rnd("kwh_je_100km", 1).alias("kwh_je_100km"),
        rnd("wh_je_km_wltp", 1).alias("wh_je_km_wltp"))


def fair_comparison(wtw: DataFrame, scenario: str = "mittel") -> DataFrame:
    """One scenario, grid term by class, difference to the paper value."""
    w = wtw.filter(F.col("bev_szenario") == scenario)
    return w.select(
        "antriebsklasse", "fahrzeuge", "quelle_real", "ft_haeufigster", "faktor_g_je_l", "masse_kg",
        "co2_offiziell", "co2_auspuff_real",
        F.when(F.col("antriebsklasse") == "BEV", F.col("co2_strom_bev")).otherwise(F.col("co2_strom_phev"))
        .alias("co2_strom"), "co2_wtw_gesamt",
        rnd(F.col("co2_wtw_gesamt") - F.col("co2_offiziell"), 1).alias("differenz_zum_papier"),
        rnd(F.try_divide((F.col("co2_wtw_gesamt") - F.col("co2_offiziell")) * 100.0,
                         F.nullif("co2_offiziell", F.lit(0.0))), 0).alias("abweichung_prozent"))


def scenario_pivot(wtw: DataFrame) -> DataFrame:
    """Scenario x class pivot of the total."""
    cls = [("BEV", "bev"), ("PHEV", "phev"), ("ICE_BENZIN", "benzin_rein"),
           ("ICE_DIESEL", "diesel_rein"), ("HEV", "hybrid")]
    return wtw.groupBy("bev_szenario").agg(
        *[F.max(F.when(F.col("antriebsklasse") == c, F.col("co2_wtw_gesamt"))).alias(n) for c, n in cls])


def break_even(wtw: DataFrame, scenario: str = "mittel") -> DataFrame:
    """PHEV total against pure petrol over a grid of mix values."""
    w = wtw.filter(F.col("bev_szenario") == scenario)
    one = w.agg(F.max(F.when(F.col("antriebsklasse") == "PHEV", F.col("co2_auspuff_real"))).alias("pa"),
                F.max(F.when(F.col("antriebsklasse") == "PHEV", F.col("kwh_je_100km"))).alias("pk"),
                F.max(F.when(F.col("antriebsklasse") == "ICE_BENZIN", F.col("co2_auspuff_real"))).alias("b"))
    x = one.withColumn("g", F.explode(F.array(*[F.lit(v) for v in MIX_GRID])))
    tot = F.col("pa") + F.col("pk") * F.col("g") / 100
    return x.select(F.col("g").alias("strommix_g_kwh"), F.col("pa").alias("phev_auspuff"),
                    rnd(F.col("pk") * F.col("g") / 100, 1).alias("phev_strom"), rnd(tot, 1).alias("phev_gesamt"),
                    F.col("b").alias("benzin_rein"),
                    F.when(tot > F.col("b"), "PHEV schlechter").otherwise("PHEV besser").alias("ergebnis"))


def consistency(wtw: DataFrame, lo: float = 300, hi: float = 450) -> DataFrame:
    """The grid value used and the PHEV exhaust of the main table, mix plausibility."""
    one = wtw.agg(F.max("strommix_g_kwh").alias("m"),
                  F.max(F.when((F.col("antriebsklasse") == "PHEV") & (F.col("bev_szenario") == "mittel"),
                               F.col("co2_auspuff_real"))).alias("phev_auspuff_haupttabelle"))
    return one.select(rnd("m", 1).alias("verwendeter_mix_g_kwh"), "phev_auspuff_haupttabelle",
                      F.when(F.col("m").between(lo, hi), "plausibel").otherwise("PRUEFEN").alias("bewertung_mix"))


def official_aggregate(rw: DataFrame) -> DataFrame:
    """A3 stand-in: the official per year x maker x fuel aggregate, derived from
    the meter table (counts and means, as published by the source)."""
    return (rw.filter(F.col("ft").isNotNull()).groupBy("jahr", F.col("mh").alias("hersteller"),
                                                       F.col("ft").alias("kraftstoff"))
            .agg(F.count(F.lit(1)).alias("n_fahrzeuge"), F.avg("fc_real").alias("obfcm_fc"),
                 F.avg("fc_wltp").alias("wltp_fc"), F.avg("gap_pct").alias("gap_fc_pct"),
                 F.avg(F.col("fc_real") * F.col("co2_wltp") / F.col("fc_wltp")).alias("obfcm_co2"),
                 F.avg("co2_wltp").alias("wltp_co2")))


def factor_backcheck(agg: DataFrame, min_n: int) -> DataFrame:
    """Fuel factor back-computed from the aggregate (g/l)."""
    a = agg.filter(F.col("n_fahrzeuge") >= min_n)
    return a.groupBy("kraftstoff").agg(
        F.count(F.lit(1)).alias("gruppen"),
        rnd(F.avg(F.try_divide(F.col("obfcm_co2"), F.nullif("obfcm_fc", F.lit(0.0))) * 100), 0).alias("faktor_aus_obfcm"),
        rnd(F.avg(F.try_divide(F.col("wltp_co2"), F.nullif("wltp_fc", F.lit(0.0))) * 100), 0).alias("faktor_aus_wltp"))


def official_crosscheck(agg: DataFrame, min_n: int) -> DataFrame:
    """Own gap against the official aggregate per year x fuel, groups >= min_n."""
    a = agg.filter(F.col("n_fahrzeuge") >= min_n)
    return a.groupBy("jahr", "kraftstoff").agg(
        F.sum("n_fahrzeuge").alias("eea_fahrzeuge"), rnd(F.avg("gap_fc_pct"), 1).alias("eea_gap_pct"),
        rnd(F.avg("obfcm_fc"), 2).alias("eea_real_l"), rnd(F.avg("wltp_fc"), 2).alias("eea_wltp_l"))
