"""Case tables of FIXTURES.md section 3 for the cleaning functions."""

import math

import pytest
from pyspark.sql import functions as F

from gapmeter.functions import arrays as A
from gapmeter.functions import scalars as S


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_parse_number(spark):
    cases = {"1,5": 1.5, " 7.0 ": 7.0, "-3": -3.0, "1e3": 1000.0, "1,5E-2": 0.015,
             "1.234,5": None, ".5": None, "5.": None, "+5": None, "abc": None, "1 000": None,
             "": None, "  ": None, None: None, "5\n": None, "\t5": None}
    got = one_col(spark, list(cases), S.parse_number)
    for (k, want), g in zip(cases.items(), got):
        assert (g is None and want is None) or math.isclose(g, want), (k, g, want)


def test_parse_date(spark):
    import datetime as dt
    cases = {"2025-08-13": dt.date(2025, 8, 13), "2025-08-13T10:00": dt.date(2025, 8, 13),
             " 2025-08-13 ": dt.date(2025, 8, 13), "13.08.2025": None, "2025-02-30": None, "": None}
    assert one_col(spark, list(cases), S.parse_date) == list(cases.values())


def test_normalize_name(spark):
    cases = {"I20": "I20", "i 20": "I20", " I-20 ": "I20", "Citroën C3": "CITRONC3", "--": None, "": None,
             None: None}
    assert one_col(spark, list(cases), S.normalize_name) == list(cases.values())


def test_drive_class_and_letter(spark):
    cases = [("hydrogen", "M", "FCEV"), ("electric", "E", "BEV"), ("petrol/electric", "P", "PHEV"),
             ("petrol", "H", "HEV"), ("lpg", "B", "BIFUEL"), ("e85", "F", "FLEX"), ("e85", "H", "HEV"),
             ("DIESEL", "m", "ICE_DIESEL"), (" petrol ", " M ", "ICE_BENZIN"), ("ng", "M", "ICE_SONSTIGE"),
             ("unknown", "UNKNOWN", "UNBEKANNT"), (None, None, "UNBEKANNT"), ("petrol", "PX", "UNBEKANNT")]
    df = spark.createDataFrame(cases, "ft string, fm string, want string")
    rows = df.select(S.drive_class("ft", "fm").alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows), rows
    letters = one_col(spark, ["UNKNOWN", None, "PX"], S.fuel_mode_letter)
    assert letters == ["U", "", "P"]


def test_eco_codes(spark):
    cases = {"e1 29 37": ["29", "37"], "e5 2937": ["29", "37"], "e529  37": ["37"], "e5  e5 29": ["29"],
             "e24 2e24 29": ["29"], "29 29": ["29"], "e1 3729": ["29", "37"], "e529": None, "293": None,
             "e1 99": None, "": None, None: None}
    assert one_col(spark, list(cases), A.eco_codes) == list(cases.values())


def test_gap_columns(spark):
    rows = [(744.0, 10000.0, 6.40), (5.0, 0.0, 6.0), (5.0, 100.0, 0.0), (5.0, 100.0, None), (None, 100.0, 5.0)]
    df = spark.createDataFrame(rows, "f double, d double, lab double")
    g = S.gap_columns("f", "d", "lab")
    out = df.select(g["fc_real"], g["gap_abs"], g["gap_pct"]).collect()
    assert tuple(out[0]) == (7.44, 1.04, 16.25)
    assert tuple(out[1]) == (None, None, None)
    assert tuple(out[2]) == (5.0, None, None)
    assert tuple(out[3]) == (5.0, None, None)
    assert tuple(out[4]) == (None, None, None)


def test_flags(spark):
    assert one_col(spark, [999.9, 1000.0, None], S.min_mileage_flag, "double") == [False, True, False]
    assert one_col(spark, ["1", "0", None], S.usable_flag) == [True, False, None]


def test_rounding_is_half_away_from_zero(spark):
    assert one_col(spark, [1.005, 2.5, -2.5], lambda c: S.rnd(c, 2), "double") == [1.01, 2.5, -2.5]
    assert one_col(spark, [2.5, -2.5], lambda c: S.rnd(c, 0), "double") == [3.0, -3.0]


def test_sql_functions_match_columns(spark):
    from gapmeter.functions.sqlfuncs import register_sql_functions
    register_sql_functions(spark)
    vals = ["1,5", "abc", " 7.0 ", "e5 2937", "2025-08-13T10:00", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    df.createOrReplaceTempView("t_sqlf")
    a = spark.sql("SELECT zu_zahl(x) a, oeko_codes(x) b, zu_datum(x) c, norm_name(x) d FROM t_sqlf").collect()
    b = df.select(S.parse_number("x"), A.eco_codes("x"), S.parse_date("x"), S.normalize_name("x")).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    k = spark.sql("SELECT antriebsklasse('DIESEL', ' m ') AS k").first().k
    assert k == "ICE_DIESEL"


def test_sql_functions_equal_column_rules(spark):
    from gapmeter.functions.sqlfuncs import register_sql_functions
    register_sql_functions(spark)
    texts = [None, "", "  ", " a ", "a\nb", "1,5", "1.5e3", "-2", "1.2.3", "08", "0829", "082", "e5 2937", "3308 x 08", "Ä-b 1", "2025-02-30", " 2025-02-28T1", "0829\n37"]
    t = spark.createDataFrame([(x,) for x in texts], "x string")
    t.createOrReplaceTempView("t_all")
    a = spark.sql("SELECT zu_zahl(x), oeko_codes(x), zu_datum(x), norm_name(x), leer_zu_null(x) FROM t_all").collect()
    b = t.select(S.parse_number("x"), A.eco_codes("x"), S.parse_date("x"), S.normalize_name("x"), S.blank_to_null("x")).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    fuels = [None, "", " Hydrogen", "diesel", "PETROL ", "lpg"]
    modes = [None, "", "e", "P", " h", "B", "F", "M", "x"]
    c = spark.createDataFrame([(x, y) for x in fuels for y in modes], "ft string, fm string")
    c.createOrReplaceTempView("t_cls")
    a = spark.sql("SELECT antriebsklasse(ft, fm) FROM t_cls").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in c.select(S.drive_class("ft", "fm")).collect()]


@pytest.mark.parametrize("text,n", [("a  b\t\nc", 70)])
def test_squeeze(spark, text, n):
    assert one_col(spark, [text], lambda c: S.squeeze_text(c, n)) == ["a b c"]


def test_name_key_keeps_runs_of_letters_and_digits(spark):
    """B4 joins the kept runs; no negated class is run over the text."""
    names = [" Škoda  Octavia-RS 4x4 ", "ß", "", None, "  ", "aıb", "BMW\tX1\n(2020)", "日本 7", "ÄÖÜ"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.normalize_name("n").alias("k"))
    assert {r.n: r.k for r in df.collect()} == {names[0]: "KODAOCTAVIARS4X4", "ß": None, "": None, None: None, "  ": None, "aıb": "AB",
                                                names[6]: "BMWX12020", "日本 7": "7", "ÄÖÜ": None}
    assert "[^A-Za-z0-9]" not in df._jdf.queryExecution().optimizedPlan().toString()
