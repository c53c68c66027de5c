"""Ranks and running totals: no cut points in the plan, no window over more than a fixed number of ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gapmeter.operators import pairs as PR
from gapmeter.operators import scan as SC


def test_offsets_in_groups_of_groups(spark, monkeypatch):
    monkeypatch.setattr(SC, "FANOUT", 4)
    rng = random.Random(1)
    rows = [(p, b, rng.randrange(9)) for p in ("a", None) for b in sorted(rng.sample(range(300), 120))]
    got = {(r.p, r.b): r._off for r in SC.offsets(spark.createDataFrame(rows, "p string, b long, v long"), ["p"], "b", "v").collect()}
    assert got == {(p, b): sum(v for q, c, v in rows if q == p and c < b) for p, b, _ in rows}


def test_rank_with_nulls_ties_and_one_hot_value(spark):
    rng = random.Random(2)
    vals = [(i, rng.choice([None, 1.0, 2.0, 7.5, rng.uniform(-5, 5)])) for i in range(400)] + [(i, 3.0) for i in range(400, 700)]
    df = spark.createDataFrame(vals, "id int, v double")
    want = {r.id: r.rk for r in df.withColumn("rk", F.rank().over(Window.orderBy(F.col("v").asc_nulls_first()))).collect()}
    assert {r.id: r.rk for r in SC.global_rank(df, "v", "rk").collect()} == want


@pytest.mark.parametrize("what", ["rank", "less", "max"])
def test_plans_do_not_grow_with_the_rows(spark, what):
    sizes = []
    for n in (1_000, 200_000):
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.lit(1).alias("p"), F.lit(1).alias("q"), F.rand(1).alias("y"))
        out = {"rank": lambda: SC.global_rank(df, "x", "r"), "less": lambda: SC.weighted_less(df, [], "x", "p", "q"),
               "max": lambda: PR.prefix_max(df, df.withColumnRenamed("y", "z"), "x", "y", ["x"], "m")}[what]()
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        if what == "less":
            assert out.first().n == n * (n - 1) // 2
    assert sizes[0] == sizes[1]


def test_prefix_max_against_brute_force(spark):
    rng = random.Random(4)
    pts = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, rng.uniform(0, 9)])) for _ in range(150)]
    qs = [(rng.choice([None, *range(0, 9)]), i) for i in range(60)]
    p, q = spark.createDataFrame(pts, "x int, y double"), spark.createDataFrame(qs, "x int, k int")
    got = {r.k: r.m for r in PR.prefix_max(p, q, "x", "y", ["x", "k"], "m").collect()}
    assert got == {k: max((y for px, y in pts if px is not None and y is not None and x is not None and px < x), default=None) for x, k in qs}
