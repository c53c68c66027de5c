"""Dense keys that persist, and a country dimension that loses no fact row."""

import pytest
from pyspark.sql import functions as F

from gapmeter.plans import keys as K
from gapmeter.plans import star as ST

REG = ("src_id long, jahr int, zulassung_datum date, ms string, mp_pool string, mh_name string, man_name string, marke string, handelsname string, marke_norm string, "
       "handelsname_norm string, ft string, fm string, antriebsklasse string, ist_elektrifiziert boolean, ist_extern_ladbar boolean, masse_kg double, pruefmasse_kg double, "
       "co2_wltp double, leistung_kw double, strom_wh_km double, oeko_gutschrift double, oeko_codes array<string>, data_status string, source_version string")


def _reg(spark, rows):
    """(src_id, country, maker) with the other columns filled in."""
    return spark.createDataFrame([(i, 2020, None, ms, None, mh, None, "m", "n", "M", "N", "petrol", "m", "ICE_BENZIN", False, False,
                                   1000.0, 1100.0, 120.0, 80.0, None, None, None, "F", "1") for i, ms, mh in rows], REG)


PARAMS = [("DE", "Deutschland", "West", True), ("NO", "Norwegen", "Nord", False)]
P_SCHEMA = "ms_code string, land_name string, region string, ist_fokusland boolean"


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_dense_whatever_the_partitions(spark, parts):
    df = spark.range(1000).repartition(parts).where("id % 3 <> 1")
    got = sorted(r.sk for r in K.numbered(df, "sk", 5).collect())
    assert got == list(range(5, 5 + 667)) and K.numbered(df.limit(0), "sk").collect() == []
    plan = K.numbered(df, "sk")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_numbers_of_a_stored_table_need_no_second_copy(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5000).repartition(9).write.parquet(path)
    out = K.numbered(spark.read.parquet(path), "sk", stable=True)
    assert sorted(r.sk for r in out.collect()) == list(range(1, 5001))
    assert out.where("id < 50").select("id", "sk").collect() == out.where("id < 50").select("id", "sk").collect()


def test_members_keep_their_keys_over_loads(spark):
    load = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    one = K.extend(None, load(["a", "b", None, "b"]), ["k"], "sk")
    one = spark.createDataFrame(one.collect(), one.schema)
    two = K.extend(one, load(["c", "b", "d", None, "c"]), ["k"], "sk")
    two = spark.createDataFrame(two.collect(), two.schema)
    first, second = ({r.k: r.sk for r in t.collect()} for t in (one, two))
    assert sorted(first.values()) == [1, 2, 3] and {k: second[k] for k in first} == first
    assert sorted(second.values()) == [1, 2, 3, 4, 5] and set(second) == {"a", "b", "c", "d", None}
    three = K.extend(two, load([]), ["k"], "sk")  # nothing new
    assert {r.k: r.sk for r in three.collect()} == second
    r = K.key_report(two, "sk").first()
    assert (r.zeilen, r.sk_min, r.sk_max, r.sk_distinct, r.lueckenlos) == (5, 1, 5, 5, True)
    assert not K.key_report(two.where("sk <> 2"), "sk").first().lueckenlos


def test_fact_keeps_rows_without_country_and_with_unlisted_codes(spark):
    reg = _reg(spark, [(1, "DE", "x"), (2, None, "x"), (3, "ZZ", None), (4, "DE", "y"), (5, None, None)])
    dims = {"country": ST.keyed("country", ST.dim_country(reg, spark.createDataFrame(PARAMS, P_SCHEMA))), "manufacturer": ST.keyed("manufacturer", ST.dim_manufacturer(reg)),
            "model": ST.keyed("model", ST.dim_model(reg)), "powertrain": ST.keyed("powertrain", ST.dim_powertrain(reg))}
    f = ST.fact(reg, dims)
    named = {r.src_id: (r.land_name, r.region, r.ist_gelistet) for r in f.join(dims["country"], "country_sk").collect()}
    assert named == {1: ("Deutschland", "West", True), 4: ("Deutschland", "West", True), 3: ("unbekannt", "unbekannt", False), 2: ("unbekannt", "unbekannt", False), 5: ("unbekannt", "unbekannt", False)}
    assert sorted(r.fact_sk for r in f.collect()) == [1, 2, 3, 4, 5]
    assert {r.src_id for r in f.where(F.col("country_sk") == ST.UNKNOWN_SK).collect()} == {2, 5}
    country = {r.ms_code: r.country_sk for r in dims["country"].collect()}
    assert country[None] == 0 and sorted(country.values()) == [0, 1, 2, 3]
    assert {r.fk: r.verwaist for r in ST.orphans(f, {"country": dims["country"]}).collect()} == {"country": 0}
    assert ST.fact(reg).count() == 5  # dimensions made on the way


def test_a_country_listed_later_keeps_its_key(spark):
    reg = _reg(spark, [(1, "DE", "x"), (2, "ZZ", "x")])
    one = ST.keyed("country", ST.dim_country(reg, spark.createDataFrame(PARAMS, P_SCHEMA)))
    one = spark.createDataFrame(one.collect(), one.schema)
    later = spark.createDataFrame([*PARAMS, ("ZZ", "Zedland", "Ost", False), ("AA", "Aland", "Nord", False)], P_SCHEMA)
    two = {r.ms_code: r for r in ST.keyed("country", ST.dim_country(reg, later), one).collect()}
    was = {r.ms_code: r.country_sk for r in one.collect()}
    assert {k: two[k].country_sk for k in was} == was and two["AA"].country_sk == 4
    assert two["ZZ"].land_name == "Zedland" and two["ZZ"].ist_gelistet and two[None].land_name == "unbekannt"
