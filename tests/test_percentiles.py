"""Exact percentiles by radix selection against sorted lists; state and plan don't grow with the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapmeter.operators import quantiles as Q


def _at(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    a, b = v[math.floor(h)], v[math.ceil(h)]
    return a if a == b else (1 - (h - math.floor(h))) * a + (h - math.floor(h)) * b


def _same(got, want):
    return (got is None and want is None) or got == want or math.isclose(got, want, rel_tol=1e-12)


def _rows(rng):
    spread = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)]
    return {"hot": [rng.uniform(0, 1e6) for _ in range(3000)], "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(1500)],
            "spread": [*spread, 0.0, 0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324], "near": [1 + k * 2.0 ** -52 for k in range(900)],
            "powers": [2.0 ** k for k in range(-1000, 1000)], "few": [3.0, 1.0], "one": [7.0], None: [float(k) for k in range(700)], "none": []}


@pytest.mark.parametrize("small", [1, 10, 200, 10**6])
def test_grouped_percentiles(spark, small):
    data = _rows(random.Random(2))
    rows = [(g, x, -x if i % 2 else None) for g, xs in data.items() for i, x in enumerate(xs)] + [("none", None, 1.0)] * 300
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = Q.grouped_percentiles(df, ["g"], {"a": ("x", [0.1, 0.5, 0.9, 1.0]), "b": (F.col("y"), 0.25)}, [F.count(F.lit(1)).alias("n")], small=small).collect()
    assert {r.g: r.n for r in got} == {g: len(xs) or 300 for g, xs in data.items()}
    for r in got:
        x, y = data[r.g], [-v for i, v in enumerate(data[r.g]) if i % 2] or ([1.0] if r.g == "none" else [])
        assert (r.a is None) == (not x) and all(_same(u, _at(x, p)) for u, p in zip(r.a or [], [0.1, 0.5, 0.9, 1.0])), r.g
        assert _same(r.b, _at(y, 0.25) if y else None), r.g


def test_no_groups(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert Q.grouped_percentiles(df, ["g"], {"a": ("x", 0.5)}, small=1).collect() == []
    assert Q.exact_percentiles(df, ["g"], "x", [0.5]).collect() == []


def _size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_plan_does_not_grow_with_the_rows(spark):
    """A group of a third of all rows, all values distinct: the same plan at 3,000 and 300,000 rows."""
    sizes = []
    for n in (3_000, 300_000):
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % n + F.rand(1)).alias("x"))
        out = Q.grouped_percentiles(df, ["g"], {"a": ("x", [0.1, 0.5]), "b": (F.col("x") * 2, 0.5)}, small=500)
        sizes.append(_size(out))
        hot = next(r for r in out.collect() if r.g == "hot")
        want = df.where("g = 'hot'").agg(F.percentile("x", [0.1, 0.5]).alias("q")).first().q
        assert all(_same(u, w) for u, w in zip(hot.a, want)) and math.isclose(hot.b, 2 * want[1])
    assert abs(sizes[1] - sizes[0]) <= 2


def test_rounds_hold_few_rows(spark, monkeypatch):
    """What is read in the last pass is bounded by ``small`` per interval."""
    seen = []
    real = Q._within

    def spy(v, spans, keys, n):
        out = real(v, spans, keys, n)
        seen.append(out.groupBy(*keys, "_lo").agg(F.countDistinct("_v").alias("n")).agg(F.max("n")).first()[0])
        return out
    monkeypatch.setattr(Q, "_within", spy)
    df = spark.range(40_000).select(F.lit("hot").alias("g"), (F.col("id") * 1.5).alias("x"))
    assert Q.grouped_percentiles(df, ["g"], {"a": ("x", 0.5)}, small=100).first().a == 29999.25
    assert seen[-1] <= 100 and len(seen) <= 4


def test_parts_follow_the_order_of_values(spark):
    rng = random.Random(5)
    for lo, hi in ((-math.inf, math.inf), (-3.0, 1e9), (1.0, 4.0), (-8.0, -2.0), (0.0, 5e-324), (2.0 ** 52, 2.0 ** 52 + 1)):
        vs = sorted({lo, hi, *(min(max(rng.uniform(-1, 1) * 10 ** rng.uniform(-20, 20), lo), hi) for _ in range(300))})
        got = spark.createDataFrame([(v,) for v in vs], "v double").select("v", Q.part_of(F.col("v"), F.lit(lo), F.lit(hi)).alias("p")).collect()
        parts = [r.p for r in sorted(got, key=lambda r: r.v)]
        assert parts == sorted(parts) and parts[0] < parts[-1]
