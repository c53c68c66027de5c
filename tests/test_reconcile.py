"""Two sources of different grain: every cell gets the right verdict and its share of the difference."""

import pytest
from pyspark.sql import functions as F

from gapmeter.plans import reconcile as R

OWN = "land string, jahr int, hersteller string, kraftstoff string, n long, s_fc double, n_fc long"
OFF = "jahr int, hersteller string, kraftstoff string, n_fahrzeuge long, obfcm_fc double"


def _cells(spark, own, off, **kw):
    return {(r.jahr, r.hersteller, r.kraftstoff): r for r in R.reconcile(spark.createDataFrame(own, OWN), spark.createDataFrame(off, OFF), **kw).collect()}


def test_verdicts_bands_and_shares(spark):
    own = [("DE", 2021, "A", "petrol", 2, 12.0, 2), ("NO", 2021, "A", "petrol", 2, 12.0, 2),  # mean 6 of two countries
           ("DE", 2021, "B", "petrol", 10, 50.0, 10), ("DE", 2021, "C", "diesel", 4, 16.0, 4), ("DE", 2022, None, "petrol", 1, 8.0, 1),
           ("DE", 2022, "D", "electric", 3, None, 0), ("DE", 2022, "E", "electric", 3, 0.0, 3), ("DE", 2022, "F", "petrol", 5, 10.0, 5)]
    off = [(2021, "A", "petrol", 4, 6.0), (2021, "B", "petrol", 10, 5.1), (2021, "C", "diesel", 4, 5.0), (2022, None, "petrol", 1, 8.0),
           (2022, "D", "electric", 3, None), (2022, "E", "electric", 3, 0.0), (2022, "G", "petrol", 2, 7.0)]
    got = _cells(spark, own, off)
    assert {k: r.urteil for k, r in got.items()} == {
        (2021, "A", "petrol"): R.SAME, (2021, "B", "petrol"): R.NEAR, (2021, "C", "diesel"): R.FAR, (2022, None, "petrol"): R.SAME,
        (2022, "D", "electric"): R.SAME, (2022, "E", "electric"): R.SAME, (2022, "F", "petrol"): R.OWN_ONLY, (2022, "G", "petrol"): R.OFFICIAL_ONLY}
    whole = 10 * 0.1 + 4 * 1 + 5 * 2 + 2 * 7
    want = {"B": 1.0, "C": 4.0, "F": 10.0, "G": 14.0}
    assert all(abs(r.anteil_prozent - want.get(k[1], 0) * 100 / whole) < 1e-4 for k, r in got.items())
    assert got[2021, "C", "diesel"].abweichung_prozent == 25.0 and got[2021, "A", "petrol"].eigen_n == 4
    tight = _cells(spark, own, off, small_percent=0.0, large_percent=1.0)
    assert tight[2021, "B", "petrol"].urteil == R.FAR


def test_sides_that_are_empty_or_agree(spark):
    one = [("DE", 2021, "A", "petrol", 2, 12.0, 2)]
    assert [r.urteil for r in _cells(spark, one, []).values()] == [R.OWN_ONLY]
    assert [r.urteil for r in _cells(spark, [], [(2021, "A", "petrol", 4, 6.0)]).values()] == [R.OFFICIAL_ONLY]
    assert _cells(spark, [], []) == {}
    same = _cells(spark, one, [(2021, "A", "petrol", 2, 6.0)])
    assert [(r.urteil, r.anteil_prozent) for r in same.values()] == [(R.SAME, None)]  # no difference to explain


def test_the_file_goes_round_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(2021, "A, B", "petrol", 3, *[float(k) + 0.1234567 for k in range(16)]), (2022, None, "diesel", 1, *[None] * 15, -1.5)],
                                 ", ".join(["jahr int", "hersteller string", "kraftstoff string", "n_fahrzeuge long", *[f"{c} double" for c in R.OFFICIAL_COLUMNS[4:]]]))
    path = f"file://{tmp_path}/f"
    R.as_text(rows).write.option("header", True).option("escape", '"').option("nullValue", "NULL").csv(path)
    from gapmeter.sources.load import read_null_word_csv
    text = read_null_word_csv(spark, path)
    assert text.columns == R.OFFICIAL_COLUMNS and len(text.columns) == 20 and {t for _, t in text.dtypes} == {"string"}
    assert text.where("obfcm_fc = '0,123457'").count() == 1
    back = {r.jahr: r for r in R.official_from_text(text).collect()}
    assert back[2021].hersteller == "A, B" and back[2021].gap_co2_pct_w == 15.123457 and back[2022].hersteller is None and back[2022].gap_co2_pct_w == -1.5
    junk = text.withColumn("wltp_fc", F.lit("n/a"))
    assert R.official_from_text(junk).where("wltp_fc is not null").count() == 0
    with pytest.raises(ValueError):
        R.official_from_text(text.drop("gap_fc_abs_w"))
