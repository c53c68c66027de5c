"""Operators against brute force on small fixtures, and the FIXTURES.md property cases."""

import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from gapmeter.operators import dedup as DD
from gapmeter.operators import pairs as PR
from gapmeter.operators import scan as SC
from gapmeter.plans import ml as ML


def test_keep_one_deterministic_and_idempotent(spark):
    rows = [(1, "a", "x"), (1, "a", "b"), (2, "b", None), (2, "b", "a"), (3, "c", "z")]
    df = spark.createDataFrame(rows, "k int, g string, v string")
    once = DD.keep_one(df, ["k", "g"])
    twice = DD.keep_one(once, ["k", "g"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    got = {(r.k, r.v) for r in once.collect()}
    assert got == {(1, "b"), (2, None), (3, "z")}


def test_global_rank_equals_sql_rank(spark):
    random.seed(3)
    vals = [(i, float(random.randint(0, 40))) for i in range(500)]
    df = spark.createDataFrame(vals, "id int, v double")
    ours = {r.id: r.rk for r in SC.global_rank(df, "v", "rk", buckets=8).collect()}
    ref = {r.id: r.rk for r in df.withColumn("rk", F.rank().over(Window.orderBy("v"))).collect()}
    assert ours == ref


def test_rank_ties(spark):
    df = spark.createDataFrame([(x,) for x in [16.8, 16.9, 16.9, 17.4]], "v double")
    assert sorted(r.rk for r in SC.global_rank(df, "v", "rk", buckets=2).collect()) == [1, 2, 2, 4]


def test_weighted_less_and_dominated_vs_brute_force(spark):
    random.seed(7)
    pts = [(round(random.uniform(0, 10), 1), round(random.uniform(0, 10), 1)) for _ in range(300)] + [(5.0, 5.0)] * 400
    qs = [(round(random.uniform(0, 10), 1), round(random.uniform(0, 10), 1)) for _ in range(200)] + [(5.0, 5.0), (5.1, 4.9)] * 50
    p = spark.createDataFrame(pts + [(None, 1.0)], "x double, y double")
    q = spark.createDataFrame(qs + [(1.0, None)], "x double, y double")
    r = PR._ranked(p, q, "x", "y")
    assert SC.weighted_less(r, [], "rx", "p", "q", rows_per_bucket=5).first().n == sum(px < qx for px, _ in pts for qx, _ in qs)
    assert PR.dominated(r).first().n == sum(px < qx and py > qy for px, py in pts for qx, qy in qs)


def test_reversal_pairs_vs_brute_force(spark):
    random.seed(11)
    rows = []
    for i in range(60):
        cls = random.choice(["PHEV", "ICE_BENZIN", "ICE_DIESEL", "HEV"])
        rows.append((f"M{i % 7}", f"model{i}", cls, round(random.uniform(1, 9), 2), round(random.uniform(3, 12), 2)))
    rev = spark.createDataFrame(rows, "marke string, modell string, antriebsklasse string, wltp_l double, real_l double")
    ice = [r for r in rows if r[2] in ("ICE_BENZIN", "ICE_DIESEL")]
    ph = [r for r in rows if r[2] == "PHEV"]
    pairs = [(i, p) for i, p in itertools.product(ice, ph) if i[3] > p[3]]
    better = [(i, p) for i, p in pairs if i[4] < p[4]]
    got = PR.reversal_pair_counts(rev).first()
    assert got.modellpaare == len(pairs) and got.verbrenner_real_besser == len(better)
    top = sorted(better, key=lambda t: (-(t[1][4] - t[0][4]), t[0][0] + " " + t[0][1], t[1][0] + " " + t[1][1]))[:5]
    lst = PR.reversal_pair_list(rev, k=5).collect()
    assert [(r.verbrenner, r.phev) for r in lst] == [(i[0] + " " + i[1], p[0] + " " + p[1]) for i, p in top]
    plan = PR.reversal_pair_list(rev, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_exact_split_sizes(spark):
    rows = [(f"v{i}", "A" if i % 3 else "B") for i in range(1000)]
    df = spark.createDataFrame(rows, "vehicle_id string, antriebsklasse string")
    s = ML.exact_split(df, "vehicle_id", "antriebsklasse", 0.7, 1234)
    got = {(r.antriebsklasse, r.split): r.n for r in s.groupBy("antriebsklasse", "split").agg(F.count("*").alias("n")).collect()}
    for k, n in (("A", 666), ("B", 334)):
        assert got[(k, "train")] == round(0.7 * n) and got[(k, "test")] == n - round(0.7 * n)
    again = ML.exact_split(df, "vehicle_id", "antriebsklasse", 0.7, 1234)
    a = {r.vehicle_id for r in s.filter("split = 'train'").collect()}
    b = {r.vehicle_id for r in again.filter("split = 'train'").collect()}
    assert a == b


def test_pooled_median_vs_mean_of_medians(spark):
    rows = [("A", 10.0), ("A", 20.0), ("A", 30.0), ("B", 100.0)]
    df = spark.createDataFrame(rows, "jahr string, gap double")
    med = df.groupBy("jahr").agg(F.percentile("gap", 0.5).alias("m"))
    assert med.agg(F.avg("m")).first()[0] == 60.0
    assert df.agg(F.percentile("gap", 0.5)).first()[0] == 25.0


def test_mode_vs_min(spark):
    df = spark.createDataFrame([("HEV",), ("PHEV",), ("PHEV",)], "k string")
    r = df.agg(F.mode("k", deterministic=True).alias("m"), F.min("k").alias("n")).first()
    assert (r.m, r.n) == ("PHEV", "HEV")


def test_weighted_mean_nulls(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, None)], "w double, x double")
    r = df.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("all_w"),
               (F.sum(F.col("w") * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), F.col("w")))).alias("nn")).first()
    assert (r.all_w, r.nn) == (2.5, 10.0)


def test_lag_uses_previous_existing_row(spark):
    from gapmeter.plans.marts import powertrain_mix
    rows = [("DE", 2021, "BEV", "Batterieelektrisch", 100.0, 1500.0, "F"),
            ("DE", 2023, "BEV", "Batterieelektrisch", 100.0, 1500.0, "F")]
    df = spark.createDataFrame(rows, "ms string, jahr int, antriebsklasse string, antrieb_label string, "
                                     "co2_wltp double, masse_kg double, data_status string")
    out = {r.jahr: r.zulassungen_vorjahr for r in powertrain_mix(df).collect()}
    assert out == {2021: None, 2023: 1}


def test_exact_percentiles_scan_equals_percentile(spark):
    from gapmeter.operators.quantiles import exact_percentiles
    random.seed(5)
    rows = [("A" if i % 3 else "B", float(random.choice([0, 0, 0, random.randint(0, 50)])) +
             random.random() * (i % 2)) for i in range(3000)]
    rows += [("C", 7.0)] + [("D", float(x)) for x in (1, 2)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.1, 0.5, 0.9]
    a = {r.g: (r.p0, r.p1, r.p2) for r in exact_percentiles(df, ["g"], "x", probs, buckets=8).collect()}
    b = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert all(abs(u - w) < 1e-9 for u, w in zip(a[k], b[k])), (k, a[k], b[k])


def test_deterministic_sample_equals_topk(spark):
    rows = [(f"v{i}", i) for i in range(5000)] + [("v1", 7), ("v1", 8), (None, 1)]
    df = spark.createDataFrame(rows, "vehicle_id string, x int")
    a = sorted(map(tuple, ML.deterministic_sample(df, "vehicle_id", 777, 1234).collect()), key=repr)
    b = sorted(map(tuple, df.orderBy(ML.draw("vehicle_id", 1234), "vehicle_id", "x").limit(777).collect()), key=repr)
    assert a == b and len(a) == 777
    assert ML.deterministic_sample(df, "vehicle_id", 10_000, 1234).count() == 5003


def test_null_keys_stay_in_pairs_and_percentiles(spark):
    from gapmeter.operators.quantiles import exact_percentiles
    rev = spark.createDataFrame([("A", "a", "ICE_BENZIN", 6.0, 5.0), (None, "b", "ICE_DIESEL", 6.0, 5.0), ("P", "p", "PHEV", 2.0, 7.0)],
                                "marke string, modell string, antriebsklasse string, wltp_l double, real_l double")
    assert tuple(PR.reversal_pair_counts(rev).first())[:2] == (2, 2)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, x double")
    assert {r.g: r.p0 for r in exact_percentiles(df, ["g"], "x", [0.5]).collect()} == {"a": 2.0, None: 6.0}


def test_pair_counts_need_no_python_worker(spark):
    rev = spark.createDataFrame([("A", "a", "ICE_BENZIN", 6.0, 5.0), ("P", "p", "PHEV", 2.0, 7.0)],
                                "marke string, modell string, antriebsklasse string, wltp_l double, real_l double")
    for df in (PR.reversal_pair_counts(rev), PR.reversal_pair_list(rev, 5)):
        assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_fit_limit_bounds_the_fit_alone(spark):
    random.seed(2)
    rows = [(f"v{i}", random.choice("AB"), float(random.randint(0, 99)), 0.0) for i in range(600)]
    rows = [(a, b, x, 3 * x + (7 if b == "B" else 1)) for a, b, x, _ in rows]
    df = ML.exact_split(spark.createDataFrame(rows, "vehicle_id string, land string, x double, gap_pct double"), "vehicle_id", None)
    predict = ML.fit_linear(df.filter("split = 'train'"), ["land", "x"], fit_rows=40)
    out = predict(df).collect()
    assert len(out) == 600 and all(abs(r.prediction - r.gap_pct) < 1e-6 for r in out)
    s = ML.score(predict(df)).first()
    assert s.n == 600 and s.r2 > 0.999999 and s.r2 == s.r2_adj


def test_linear_models_are_fitted_on_all_training_rows(spark, monkeypatch):
    """No row limit of the registry cuts the fit, so residuals are zero in the mean over every training row."""
    from conftest import SF001
    from gapmeter.registry import q_training
    monkeypatch.setattr(q_training, "FIT_ROWS", 100, raising=False)
    rows = q_training.linreg_identities(spark, SF001).collect()
    flags = [[v for k, v in r.asDict().items() if k.startswith("rest_")] for r in rows if r.split == "train"]
    assert flags and all(all(f) for f in flags)
