"""Official aggregate against own measurements.

The official side is a file of its own: one row per year, maker and fuel, 20 text columns, means already computed.
The own side is finer, so it is added up to the official cells from sums and counts; then both
are joined in full, each cell gets a verdict, and a share of the whole difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rnd

CELL = ["jahr", "hersteller", "kraftstoff"]
_MEANS = ["obfcm_fc", "wltp_fc", "gap_fc_abs", "gap_fc_pct", "obfcm_co2", "wltp_co2", "gap_co2_abs", "gap_co2_pct"]
#: Columns of the official file, in its order.
OFFICIAL_COLUMNS = [*CELL, "n_fahrzeuge", *_MEANS, *[f"{m}_w" for m in _MEANS]]
#: Verdicts on a cell.
SAME, NEAR, FAR, OWN_ONLY, OFFICIAL_ONLY = "gleich", "klein", "gross", "nur eigen", "nur amtlich"


def official_rows(rw: DataFrame) -> DataFrame:
    """What the authority would publish of these vehicles: plain means, and means weighted by distance (``_w``)."""
    co2 = F.col("fc_real") * F.col("co2_wltp") / F.col("fc_wltp")
    per_car = {"obfcm_fc": F.col("fc_real"), "wltp_fc": F.col("fc_wltp"), "gap_fc_abs": F.col("fc_real") - F.col("fc_wltp"), "gap_fc_pct": F.col("gap_pct"),
               "obfcm_co2": co2, "wltp_co2": F.col("co2_wltp"), "gap_co2_abs": co2 - F.col("co2_wltp"), "gap_co2_pct": F.try_divide((co2 - F.col("co2_wltp")) * 100, F.col("co2_wltp"))}
    km = F.col("dist_total_km")
    mean_w = lambda x: F.try_divide(F.sum(x * km), F.sum(F.when(x.isNotNull(), km)))
    return rw.filter(F.col("ft").isNotNull()).groupBy("jahr", F.col("mh").alias("hersteller"), F.col("ft").alias("kraftstoff")).agg(
        F.count(F.lit(1)).alias("n_fahrzeuge"), *[F.avg(x).alias(m) for m, x in per_car.items()], *[mean_w(x).alias(f"{m}_w") for m, x in per_car.items()])


def as_text(rows: DataFrame) -> DataFrame:
    """The file's form: six digits, decimal comma."""
    number = lambda c: F.regexp_replace(F.round(c, 6).cast("decimal(24,6)").cast("string"), r"\.", ",")
    return rows.select(*[(F.col(c).cast("string") if c in (*CELL, "n_fahrzeuge") else number(c)).alias(c) for c in OFFICIAL_COLUMNS])


def official_from_text(text: DataFrame) -> DataFrame:
    """Typed aggregate of a file with all 20 columns; nothing raises on a bad field. Missing columns are an error."""
    if missing := [c for c in OFFICIAL_COLUMNS if c not in text.columns]:
        raise ValueError(f"official aggregate lacks {', '.join(missing)}")
    typed = {"jahr": S.parse_number("jahr").cast("int"), "hersteller": S.blank_to_null("hersteller"), "kraftstoff": S.fold_case("kraftstoff"),
             "n_fahrzeuge": S.parse_number("n_fahrzeuge").cast("bigint")}
    return text.select(*[typed.get(c, S.parse_number(c)).alias(c) for c in OFFICIAL_COLUMNS])


def own_cells(rw: DataFrame) -> DataFrame:
    """Own measurements, one step finer than the official ones (by country, too): counts and sums."""
    return rw.filter(F.col("ft").isNotNull()).groupBy("land", "jahr", F.col("mh").alias("hersteller"), F.col("ft").alias("kraftstoff")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fc_real").alias("s_fc"), F.count("fc_real").alias("n_fc"))


def reconcile(own: DataFrame, official: DataFrame, small_percent: float = 0.1, large_percent: float = 5.0) -> DataFrame:
    """One row per cell of either side: both counts and means, deviation in percent, verdict, and the share of the
    whole vehicle-weighted difference that the cell explains (one-sided cells count with their whole mean)."""
    rolled = own.groupBy(*CELL).agg(F.sum("n").alias("eigen_n"), F.try_divide(F.sum("s_fc"), F.sum("n_fc")).alias("eigen_fc"), F.lit(True).alias("_own"))
    off = official.select(*[F.col(c).alias(f"_o{c}") for c in CELL], F.col("n_fahrzeuge").alias("amtlich_n"), F.col("obfcm_fc").alias("amtlich_fc"), F.lit(True).alias("_off"))
    j = rolled.join(off, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in CELL], "full")
    dev = F.try_divide((F.col("amtlich_fc") - F.col("eigen_fc")) * 100, F.col("eigen_fc"))
    size = F.abs(F.round(dev, 6))
    verdict = (F.when(F.col("_off").isNull(), OWN_ONLY).when(F.col("_own").isNull(), OFFICIAL_ONLY)
               .when(size.isNull(), F.when(F.col("eigen_fc").eqNullSafe(F.col("amtlich_fc")), SAME).otherwise(FAR))
               .when(size <= small_percent, SAME).when(size <= large_percent, NEAR).otherwise(FAR))
    weight = F.greatest(F.coalesce("eigen_n", F.lit(0)), F.coalesce("amtlich_n", F.lit(0)))
    amount = weight * F.abs(F.coalesce("amtlich_fc", F.lit(0.0)) - F.coalesce("eigen_fc", F.lit(0.0)))
    cells = j.select(*[F.when(F.col("_own").isNull(), F.col(f"_o{c}")).otherwise(F.col(c)).alias(c) for c in CELL], "eigen_n", "amtlich_n",
                     rnd("eigen_fc", 3).alias("eigen_fc"), rnd("amtlich_fc", 3).alias("amtlich_fc"), rnd(dev, 2).alias("abweichung_prozent"),
                     verdict.alias("urteil"), F.round(amount, 4).cast("decimal(28,4)").alias("_amount"))
    total = cells.agg(F.sum("_amount")).first()[0]      # one number
    share: Column = F.lit(None).cast("double") if not total else rnd(F.col("_amount").cast("double") * 100 / float(total), 4)
    return cells.withColumn("anteil_prozent", share).drop("_amount")


def verdicts(cells: DataFrame) -> DataFrame:
    """Cells, vehicles and share of the difference per verdict."""
    return cells.groupBy("urteil").agg(F.count(F.lit(1)).alias("zellen"), F.coalesce(F.sum("eigen_n"), F.lit(0)).cast("bigint").alias("eigen_n"),
                                       F.coalesce(F.sum("amtlich_n"), F.lit(0)).cast("bigint").alias("amtlich_n"), rnd(F.sum("anteil_prozent"), 2).alias("anteil_prozent"))
