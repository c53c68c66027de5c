"""Windows over a key range: bounded in rows, gaps skipped, only a repeated key may fill one."""

import random

import pytest
from pyspark.sql import functions as F

from gapmeter.sources import load as L


def _halved(keys, most):
    lo = min(keys)
    depth = max(1, (max(keys) - lo).bit_length())
    out, todo = set(), [(0, 0, list(keys))]
    while todo:
        level, i, ks = todo.pop()
        if len(ks) <= most or level == depth:
            out.add((lo + (i << depth - level), lo + (i + 1 << depth - level), len(ks), len(ks) > most))
            continue
        for side in (0, 1):
            half = [k for k in ks if (k - lo >> depth - level - 1) & 1 == side]
            if half:
                todo.append((level + 1, 2 * i + side, half))
    return out


@pytest.mark.parametrize("most", [1, 7, 100, 10**6])
def test_windows_equal_halving(spark, most):
    rng = random.Random(most)
    keys = [*range(500), *[rng.randrange(10**12) for _ in range(300)], *[-5] * 40, 10**15, *[rng.randrange(-2**40, -2**40 + 90) for _ in range(200)]]
    df = spark.createDataFrame([(k,) for k in [*keys, None, None]], "k long").repartition(3)
    got = L.key_windows(df, "k", rows_per_window=most).collect()
    assert {tuple(r) for r in got} == _halved(keys, most) and len(got) == len({r.von for r in got})


@pytest.mark.parametrize("most", [10_000, 0])
def test_a_dense_tenth_of_the_range(spark, monkeypatch, most):
    """Nine tenths of all keys in one tenth of the range: every window keeps its bound, whichever way windows are joined."""
    monkeypatch.setattr(L, "BROADCAST_WINDOWS", most)
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 5000).otherwise(F.lit(40_000_000) + F.col("id") * 100).alias("k"))
    w = L.key_windows(df, "k", rows_per_window=200).collect()
    assert max(r.zeilen for r in w) <= 200 and sum(r.zeilen for r in w) == 20_000 and not any(r.wiederholt for r in w)
    ends = sorted((r.von, r.bis) for r in w)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_a_repeated_key_is_reported(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).cast("long").alias("k"))
    w = {(r.von, r.bis): r for r in L.key_windows(df, "k", rows_per_window=50).collect()}
    assert [(k, r.zeilen) for k, r in w.items() if r.wiederholt] == [((77, 78), 300 + 1)] and all(r.zeilen <= 50 for k, r in w.items() if k != (77, 78))


def test_one_key_no_key(spark):
    assert [tuple(r) for r in L.key_windows(spark.createDataFrame([(9,), (9,)], "k long"), "k", 1).collect()] == [(9, 10, 2, True)]
    assert [tuple(r) for r in L.key_windows(spark.createDataFrame([(9,)], "k long"), "k", 1).collect()] == [(9, 11, 1, False)]
    assert L.key_windows(spark.createDataFrame([(None,)], "k long"), "k", 1).collect() == []
