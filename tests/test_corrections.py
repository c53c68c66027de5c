"""Change sets between versions, marts kept up to date, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from gapmeter.operators import changes as CH
from gapmeter.streaming import incremental as INC

SCHEMA = "jahr int, id long, klasse string, x double, y double"


def _versions(rng, n=400):
    old = {(2020 + i % 3, i): (rng.choice("abc"), rng.choice([None, round(rng.uniform(0, 9), 3)]), float(i % 7)) for i in range(n)}
    old[(None, 5)] = ("a", 1.0, None)
    old[(2020, None)] = ("b", None, 2.0)
    new = dict(old)
    for k in rng.sample(sorted(old, key=str), 30):
        del new[k]
    for k in rng.sample(sorted(new, key=str), 40):
        c, x, y = new[k]
        new[k] = rng.choice([("z", x, y), (c, None if x is not None else 0.0, y), (c, x, (y or 0.0) + 1.0)])
    for i in range(n, n + 25):
        new[(2021, i)] = (rng.choice("abcd"), 0.125, None)
    return old, new


def _df(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA).repartition(3)


def test_change_set(spark):
    old, new = _versions(random.Random(1))
    got = {(r.jahr, r.id): r.art for r in CH.change_set(_df(spark, old), _df(spark, new), ["jahr", "id"]).collect()}
    want = {k: CH.ADDED for k in new if k not in old} | {k: CH.REMOVED for k in old if k not in new}
    want |= {k: CH.CHANGED for k in old if k in new and old[k] != new[k]}
    assert got == want and len(set(want.values())) == 3
    assert CH.change_set(_df(spark, old), _df(spark, old).select("y", "x", "klasse", "id", "jahr"), ["jahr", "id"]).collect() == []
    with pytest.raises(ValueError):
        CH.change_set(_df(spark, old), _df(spark, old).drop("x"), ["jahr", "id"])


def test_null_and_empty_are_different_values(spark):
    a = spark.createDataFrame([(1, None), (2, "")], "id int, s string")
    b = spark.createDataFrame([(1, ""), (2, "")], "id int, s string")
    assert [tuple(r) for r in CH.change_set(a, b, ["id"]).collect()] == [(1, CH.CHANGED)]


@pytest.mark.parametrize("most", [10**6, 2])
def test_maintained_sums_equal_a_rebuild(spark, monkeypatch, most):
    monkeypatch.setattr(CH, "BROADCAST_KEYS", most)
    rng, by, measures = random.Random(2), ["jahr", "klasse"], ["x", "y"]
    old, new = _versions(rng)
    cells = CH.partial_sums(_df(spark, old), by, measures)
    for nxt in (new, {}, _versions(rng)[1]):  # on to a next version, to nothing, and back
        cells = CH.maintain(cells, _df(spark, old), _df(spark, nxt), ["jahr", "id"], by, measures)
        assert sorted(map(tuple, cells.collect()), key=str) == sorted(map(tuple, CH.partial_sums(_df(spark, nxt), by, measures).collect()), key=str)
        old = nxt


def test_only_changed_rows_are_added_up(spark):
    old, new = _versions(random.Random(3), 3000)
    changes = CH.change_set(_df(spark, old), _df(spark, new), ["jahr", "id"])
    n = changes.count()
    assert CH.rows_of(_df(spark, new), changes, ["jahr", "id"], [CH.ADDED, CH.CHANGED], True).count() <= n < 120


def test_late_rows_correct_their_hour_and_are_counted(spark, tmp_path):
    src, sink, ck = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "ck"))
    parts = [[("2020-01-01 10:05:00", "a", 1.0), ("2020-01-01 14:00:00", "a", 2.0)],
             [("2020-01-01 10:30:00", "a", 4.0), ("2020-01-01 12:30:00", "a", 8.0), ("2020-01-01 11:59:59", "b", 16.0)],
             [("2020-01-01 10:59:00", "b", 32.0), ("2020-01-02 00:00:00", "a", 64.0)]]
    for p in parts:
        df = spark.createDataFrame(p, "t string, k string, v double").select(F.col("t").cast("timestamp").alias("ts"), "k", "v")
        df.coalesce(1).write.mode("append").parquet(src)
        INC.run_batches(INC.file_stream(spark, src, df.schema), sink, ck, INC.hourly_with_late("ts", "k", "v", 2))
    got = {(str(r.fenster_start)[11:13], r.k): (r.summe, r.n, r.n_spaet) for r in INC.hourly_totals(spark.read.parquet(sink), "k").collect()}
    assert got == {("10", "a"): (5.0, 2, 1), ("14", "a"): (2.0, 1, 0), ("12", "a"): (8.0, 1, 0), ("11", "b"): (16.0, 1, 1), ("10", "b"): (32.0, 1, 1), ("00", "a"): (64.0, 1, 0)}


def test_versions_are_compared_by_sixteen_bytes(spark):
    """The digest that every key is shuffled with is 16 bytes, not 64 characters."""
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, None), (3, "")], "k int, v string")
    c = CH.change_set(old, new, ["k"])
    assert {tuple(r) for r in c.collect()} == {(2, CH.CHANGED), (3, CH.CHANGED), (4, CH.ADDED)}
    assert c._jdf.queryExecution().optimizedPlan().toString().count("unhex(sha2") == 2
