"""Regression tests for the reference's traps."""

from pyspark.sql import functions as F

from gapmeter.catalog import QUERIES
from gapmeter.operators import quality as Q

SF = "/root/testdata/sf0.001"


def test_t1_all_four_filter_findings_written(spark):
    assert QUERIES["filter_effects"](spark, SF).count() == 4


def test_t5_powertrain_key_is_unique(spark):
    rows = {r.dimension: r for r in QUERIES["key_unique_check"](spark, SF).collect()}
    for r in rows.values():
        assert r.zeilen == r.schluessel_distinct == r.sk_distinct, r


def test_t13_dotted_junk_is_no_value(spark):
    raw = spark.createDataFrame([("1.2.3", "5", "petrol", "2025-01-01", "2025"),
                                 ("4000", "600", "petrol", "2024-01-01", "2025")],
                                "m_kg string, ewltp string, ft string, dr string, jahr string") \
        .withColumn("ep_kw", F.lit("100")).withColumn("r_count", F.lit("2"))
    got = {r.pruefung: r.ergebnis for r in Q.range_rules(raw).collect()}
    assert got["Masse ausserhalb 500 bis 3500 kg"] == 1.0          # only 4000, not '1.2.3'
    assert got["Zulassung nicht im Berichtsjahr"] == 1.0
    assert got["Satz zaehlt nicht als ein Fahrzeug"] == 2.0


def test_t15_single_bev_row_in_wtw(spark):
    w = QUERIES["wtw_scenarios"](spark, SF)
    per = {r.bev_szenario: r.n for r in w.filter(F.col("antriebsklasse") == "BEV")
           .groupBy("bev_szenario").agg(F.count("*").alias("n")).collect()}
    assert per and all(n == 1 for n in per.values())


def test_t12_excluded_classes_always_reported(spark):
    f = QUERIES["excluded_classes"](spark, SF).collect()
    assert f and all(r.bewertung == "auffaellig" for r in f)
