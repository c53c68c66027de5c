"""Cleaning-function and array queries (B1-B16, C1-C4, H26) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, raw, reg, rw
from ..functions import arrays as A
from ..functions import scalars as S
from ..oracle import adapter as O


@query("parse_number", O.with_raw(f"""
SELECT id, m_kg, {O.num('m_kg')} AS masse_kg, ewltp, {O.num('ewltp')} AS co2_wltp,
       erwltp, {O.num('erwltp')} AS oeko_gutschrift FROM raw"""))
def parse_number(spark, d):
    return raw(spark, d).select(
        "id", "m_kg", S.parse_number("m_kg").alias("masse_kg"),
        "ewltp", S.parse_number("ewltp").alias("co2_wltp"),
        "erwltp", S.parse_number("erwltp").alias("oeko_gutschrift"))


@query("parse_date", O.with_raw(f"SELECT id, dr, {O.date('dr')} AS zulassung_datum FROM raw"))
def parse_date(spark, d):
    return raw(spark, d).select("id", "dr", S.parse_date("dr").alias("zulassung_datum"))


@query("blank_to_null", O.with_raw(f"""
SELECT mp, {O.blank('mp')} AS mp_pool, count(*) AS n FROM raw GROUP BY ALL"""))
def blank_to_null(spark, d):
    return (raw(spark, d).groupBy("mp").agg(F.count(F.lit(1)).alias("n"))
            .select("mp", S.blank_to_null("mp").alias("mp_pool"), "n"))


@query("normalize_name", O.with_raw(f"""
SELECT mk, cn, {O.norm('mk')} AS marke_norm, {O.norm('cn')} AS handelsname_norm, count(*) AS n
FROM raw GROUP BY ALL"""))
def normalize_name(spark, d):
    return (raw(spark, d).groupBy("mk", "cn").agg(F.count(F.lit(1)).alias("n"))
            .select("mk", "cn", S.normalize_name("mk").alias("marke_norm"),
                    S.normalize_name("cn").alias("handelsname_norm"), "n"))


@query("fold_case", O.with_raw(f"""
SELECT ft, lower({O.blank('ft')}) AS ft_folded, fm, {O.letter('fm')} AS fm_letter, count(*) AS n
FROM raw GROUP BY ALL"""))
def fold_case(spark, d):
    return (raw(spark, d).groupBy("ft", "fm").agg(F.count(F.lit(1)).alias("n"))
            .select("ft", S.fold_case("ft").alias("ft_folded"), "fm",
                    S.fuel_mode_letter("fm").alias("fm_letter"), "n"))


@query("drive_class_counts", O.with_reg("""
SELECT jahr, antriebsklasse, count(*) AS n FROM reg GROUP BY ALL"""))
def drive_class_counts(spark, d):
    return reg(spark, d).groupBy("jahr", "antriebsklasse").agg(F.count(F.lit(1)).alias("n"))


@query("class_flags", O.with_reg("""
SELECT antriebsklasse, ist_elektrifiziert, ist_extern_ladbar, count(*) AS n FROM reg GROUP BY ALL"""))
def class_flags(spark, d):
    return (reg(spark, d).groupBy("antriebsklasse", "ist_elektrifiziert", "ist_extern_ladbar")
            .agg(F.count(F.lit(1)).alias("n")))


_LABEL_SQL = "CASE antriebsklasse " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.CLASS_LABELS.items()) + f" ELSE '{S.UNKNOWN_LABEL}' END"


@query("class_labels", O.with_reg(f"""
SELECT DISTINCT antriebsklasse, {_LABEL_SQL} AS antrieb_label FROM reg"""))
def class_labels(spark, d):
    return (reg(spark, d).select("antriebsklasse").distinct()
            .select("antriebsklasse", S.class_label("antriebsklasse").alias("antrieb_label")))


@query("gap_columns", O.with_rw("""
SELECT vehicle_id, fc_real, gap_abs, gap_pct, anteil_elektrisch, eea_verwendbar, hat_mindestlauf FROM rw"""))
def gap_columns(spark, d):
    return rw(spark, d).select("vehicle_id", "fc_real", "gap_abs", "gap_pct", "anteil_elektrisch",
                               "eea_verwendbar", "hat_mindestlauf")


@query("year_guard", O.with_raw(f"""
SELECT mt, CAST(CASE WHEN {O.num('mt')} BETWEEN 1900 AND 2100 THEN CAST({O.num('mt')} AS SMALLINT) END AS INTEGER) AS guarded,
       count(*) AS n FROM raw GROUP BY ALL"""))
def year_guard(spark, d):
    return (raw(spark, d).groupBy("mt").agg(F.count(F.lit(1)).alias("n"))
            .select("mt", S.year_guard("mt").cast("int").alias("guarded"), "n"))


@query("filter_flags", O.with_rw("""
SELECT eea_verwendbar, hat_mindestlauf, gap_pct IS NOT NULL AS hat_luecke, count(*) AS n FROM rw GROUP BY ALL"""))
def filter_flags(spark, d):
    return (rw(spark, d).groupBy("eea_verwendbar", "hat_mindestlauf",
                                 F.col("gap_pct").isNotNull().alias("hat_luecke"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("filter_funnel", O.with_rw("""
SELECT count(*) AS zeilen_gesamt,
  count(*) FILTER (WHERE eea_verwendbar) AS eea_verwendbar,
  count(*) FILTER (WHERE eea_verwendbar AND hat_mindestlauf) AS plus_mindestlauf,
  count(*) FILTER (WHERE eea_verwendbar AND hat_mindestlauf AND gap_pct IS NOT NULL) AS auswertbar
FROM rw"""))
def filter_funnel(spark, d):
    r = rw(spark, d)
    u, m = F.col("eea_verwendbar"), F.col("hat_mindestlauf")
    return r.agg(F.count(F.lit(1)).alias("zeilen_gesamt"),
                 F.count(F.when(u, 1)).alias("eea_verwendbar"),
                 F.count(F.when(u & m, 1)).alias("plus_mindestlauf"),
                 F.count(F.when(u & m & F.col("gap_pct").isNotNull(), 1)).alias("auswertbar"))


@query("eco_codes", O.with_raw(f"""
SELECT it_code, array_to_string({O.eco('it_code')}, ' ') AS oeko_codes, count(*) AS n FROM raw GROUP BY ALL"""))
def eco_codes(spark, d):
    return (raw(spark, d).groupBy("it_code").agg(F.count(F.lit(1)).alias("n"))
            .select("it_code", F.array_join(A.eco_codes("it_code"), " ").alias("oeko_codes"), "n"))


@query("eco_code_counts", O.with_reg("""
SELECT code, count(*) AS n FROM (SELECT unnest(oeko_codes) AS code FROM reg) GROUP BY code"""))
def eco_code_counts(spark, d):
    return A.code_counts(reg(spark, d))


@query("eco_contains", O.with_reg("""
SELECT jahr, count(*) AS n FROM reg WHERE list_contains(oeko_codes, '29') GROUP BY jahr"""))
def eco_contains(spark, d):
    return (reg(spark, d).filter(A.has_code("oeko_codes", "29"))
            .groupBy("jahr").agg(F.count(F.lit(1)).alias("n")))


@query("eco_unresolved", O.with_reg("""
SELECT jahr, count(*) AS n FROM reg WHERE oeko_code_roh IS NOT NULL AND oeko_codes IS NULL GROUP BY jahr"""))
def eco_unresolved(spark, d):
    return (reg(spark, d).filter(A.code_text_unresolved("oeko_code_roh", "oeko_codes"))
            .groupBy("jahr").agg(F.count(F.lit(1)).alias("n")))


@query("sql_functions", O.with_raw(f"""
SELECT id, {O.num('m_kg')} AS masse_kg, {O.date('dr')} AS datum, {O.norm('cn')} AS modell_norm,
  {O.drive_class('ft', 'fm')} AS klasse, array_to_string({O.eco('it_code')}, ' ') AS codes
FROM raw WHERE {O.num('m_kg')} >= 900"""))
def sql_functions(spark, d):
    """K1-K6 as SQL functions, K8 as a named parameter of ``spark.sql``."""
    from ..functions.sqlfuncs import register_sql_functions
    register_sql_functions(spark)
    raw(spark, d).createOrReplaceTempView("gm_raw_registration")
    return spark.sql(
        "SELECT id, zu_zahl(m_kg) AS masse_kg, zu_datum(dr) AS datum, norm_name(cn) AS modell_norm, "
        "antriebsklasse(ft, fm) AS klasse, array_join(oeko_codes(it_code), ' ') AS codes "
        "FROM gm_raw_registration WHERE zu_zahl(m_kg) >= :mindest", args={"mindest": 900})
