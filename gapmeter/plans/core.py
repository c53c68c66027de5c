"""Typing steps raw -> core.

``type_registration`` filters passenger-car classes, keeps one row per
(year, id) and converts every text field with the tolerant parsers; nothing
raises on bad input. ``type_realworld`` derives the meter measures.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..operators.dedup import keep_one, kept_slices


def car_rows(raw: DataFrame) -> DataFrame:
    """Keep M1/M1G, NULL-safe."""
    return raw.filter(S.is_car_class("ct"))


def dedup_cars(raw: DataFrame, derive=None) -> DataFrame:
    """F8 after B10: one row per (jahr, id) among passenger-car rows. With ``derive``, which makes raw rows of narrower ones,
    ``raw`` are those."""
    return keep_one(car_rows(raw), ["jahr", "id"], derive=derive)


def dedup_slices(raw: DataFrame, derive=None) -> Iterator[DataFrame]:
    """``dedup_cars`` in slices by key, to be written one after the other."""
    return kept_slices(car_rows(raw), ["jahr", "id"], derive=derive)


def type_registration(raw: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """core.registration: class filter, dedup on (jahr, id), typed columns."""
    return type_cars(dedup_cars(raw), whitelist)


def type_cars(r: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """Typed core columns of de-duplicated car rows (all conversions NULL-tolerant)."""
    cls = S.drive_class("ft", "fm")
    return r.select(
        S.parse_number("id").cast("bigint").alias("src_id"),
        S.parse_number("jahr").cast("int").alias("jahr"),
        S.upper_code("ms").alias("ms"),
        S.blank_to_null("mp").alias("mp_pool"),
        S.blank_to_null("mh").alias("mh_name"),
        S.blank_to_null("man").alias("man_name"),
        S.blank_to_null("mk").alias("marke"),
        S.blank_to_null("cn").alias("handelsname"),
        S.normalize_name("mk").alias("marke_norm"),
        S.normalize_name("cn").alias("handelsname_norm"),
        S.upper_code("ct").alias("fahrzeugklasse"),
        S.fold_case("ft").alias("ft"),
        S.fuel_mode_letter("fm").alias("fm"),
        cls.alias("antriebsklasse"),
        S.is_electrified(cls).alias("ist_elektrifiziert"),
        S.is_chargeable(cls).alias("ist_extern_ladbar"),
        S.parse_number("m_kg").alias("masse_kg"),
        S.parse_number("mt").alias("pruefmasse_kg"),
        S.parse_number("ewltp").alias("co2_wltp"),
        S.parse_number("ep_kw").alias("leistung_kw"),
        S.parse_number("z_whkm").alias("strom_wh_km"),
        S.parse_number("fc").alias("verbrauch_l"),
        S.blank_to_null("it_code").alias("oeko_code_roh"),
        A.eco_codes("it_code", whitelist).alias("oeko_codes"),
        S.parse_number("erwltp").alias("oeko_gutschrift"),
        S.parse_date("dr").alias("zulassung_datum"),
        S.fuel_mode_letter("status").alias("data_status"),
        S.blank_to_null("version_file").alias("source_version"),
        S.blank_to_null("tan").alias("genehmigung"),
        S.blank_to_null("typ").alias("typ"),
        S.blank_to_null("va").alias("variante"),
        S.blank_to_null("ve").alias("version"),
        S.parse_number("enedc").alias("co2_nefz"),
        S.rnd(S.parse_number("w_mm"), 0).cast("int").alias("radstand_mm"),      # whole numbers: rounded, not cut
        S.rnd(S.parse_number("ec_cm3"), 0).cast("int").alias("hubraum_cm3"),
    )


def type_realworld(src: DataFrame) -> DataFrame:
    """core.realworld from meter fields (numbers already typed by the source)."""
    cls = S.drive_class(F.lower("ft"), "fm")
    g = S.gap_columns("fuel_total_l", "dist_total_km", "wltp_fc")
    return src.select(
        "vehicle_id",
        S.upper_code("country").alias("land"),
        "region",
        S.year_guard("jahr_txt").cast("int").alias("jahr"),
        "data_source",
        S.blank_to_null("mh").alias("mh"),
        S.blank_to_null("mk").alias("marke"),
        S.blank_to_null("cn").alias("handelsname"),
        S.normalize_name("mk").alias("marke_norm"),
        S.normalize_name("cn").alias("handelsname_norm"),
        F.col("m_kg").alias("masse_kg"),
        F.col("mt").alias("pruefmasse_kg"),
        F.col("ec_cm3").alias("hubraum_cm3"),
        F.col("ep_kw").alias("leistung_kw"),
        S.fold_case("ft").alias("ft"),
        S.fuel_mode_letter("fm").alias("fm"),
        cls.alias("antriebsklasse"),
        S.is_chargeable(cls).alias("ist_extern_ladbar"),
        F.col("ewltp").alias("co2_wltp"),
        F.col("wltp_fc").alias("fc_wltp"),
        F.col("z_whkm").alias("strom_wh_km"),
        F.col("e_range_km").alias("e_reichweite_km"),
        "fuel_total_l", "dist_total_km", "dist_cd_off_km",
        F.col("grid_energy_kwh").alias("grid_kwh"),
        g["fc_real"].alias("fc_real"),
        g["gap_abs"].alias("gap_abs"),
        g["gap_pct"].alias("gap_pct"),
        S.electric_share("dist_cd_off_km", "dist_total_km").alias("anteil_elektrisch"),
        S.usable_flag("used_in_calc").alias("eea_verwendbar"),
        S.min_mileage_flag("dist_total_km").alias("hat_mindestlauf"),
    )


def analysable(rw: DataFrame) -> DataFrame:
    """The standard gap filter: usable, min mileage, gap computable."""
    return rw.filter(F.col("eea_verwendbar") & F.col("hat_mindestlauf") & F.col("gap_pct").isNotNull())
