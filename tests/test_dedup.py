"""Two-phase dedup: rows without copies don't move, hot keys are combined before the shuffle."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gapmeter.operators import dedup as DD


def _want(rows):
    best = defaultdict(list)
    for r in rows:
        best[r[:2]].append(r[2:])
    least = lambda r: tuple((x is not None, x) for x in r)
    return sorted((k + min(v, key=lambda r: [(x is not None, x or 0) for x in r]) for k, v in best.items()), key=least)


@pytest.mark.parametrize("most", [10**6, 3])
def test_keep_one_with_hot_null_and_repeated_keys(spark, most):
    """Whichever way: few repeated keys (broadcast) or more than may be broadcast."""
    rng = random.Random(1)
    rows = [(2000 + i % 3, i, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in range(400)]
    rows += [(2001, 77, rng.choice([None, *range(9)]), str(rng.randrange(99))) for _ in range(300)]
    rows += [(None, 5, 1, "b"), (None, 5, 1, "a"), (None, None, None, None), (None, None, 2, "q")] + [rows[k] for k in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "jahr int, id int, a int, b string").repartition(5)
    got = sorted((tuple(r) for r in DD.keep_one(df, ["jahr", "id"], broadcast_keys=most).collect()), key=lambda r: tuple((x is not None, x) for x in r))
    assert got == _want(rows)


def test_no_copies_no_shuffle(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert "Exchange" not in DD.keep_one(df, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_wide_exchange_sits_behind_the_semi_join(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1000).select((F.col("id") % 990).alias("id"), F.lit(1).alias("jahr"), *[F.concat(F.lit(f"v{c}"), F.col("id")).alias(f"c{c}") for c in range(5)]).write.parquet(path)
    out = DD.keep_one(spark.read.parquet(path), ["jahr", "id"])
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    wide = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    anti = next(i for i, x in enumerate(lines) if "LeftAnti" in x)
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    assert wide and all(anti < i < semi for i in wide)  # the anti branch has none, the semi join lies below each
    assert out.count() == 990


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A key with a third of all rows: the task that gets it reads one row per task before it, not all copies."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), (F.col("id") * 7 % 1001).alias("v")).repartition(6)
    out = DD.keep_one(df, ["id"])
    assert out.count() == 20_001 and out.where("id = -1").first().v == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 1 and "Window" not in plan


@pytest.mark.parametrize("crowded", [10**6, 50])
def test_many_copies_move_in_narrow_form_and_bounded_tasks(spark, crowded, monkeypatch):
    """With many repeated keys rows are dealt out before ``derive`` widens them, over as many tasks as they ask for, and only
    crowded keys are combined before the shuffle."""
    monkeypatch.setattr(DD, "ROWS_PER_TASK", 100)
    rng = random.Random(2)
    rows = [(i % 3, i % 600, rng.choice([None, 1, 2, 3])) for i in range(2400)] + [(1, None, v) for v in range(300)] + [(None, None, 5)] * 70
    df = spark.createDataFrame(rows, "jahr int, id int, a int").repartition(4)
    derive = lambda x: x.select("jahr", "id", F.concat(F.lit("wide "), F.col("a").cast("string")).alias("b"), (F.col("a") * 2).alias("c"))
    out = DD.keep_one(df, ["jahr", "id"], broadcast_keys=3, derive=derive, crowded=crowded)
    wide = [(y, i, None if a is None else f"wide {a}", None if a is None else a * 2) for y, i, a in rows]
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    assert got == _want(wide)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
    assert f", {-(-(len(rows) if crowded > 50 else len(rows)) // 100)}" in lines[dealt]
    assert any("wide " in x for x in lines[:dealt]) and not any("wide " in x for x in lines[dealt:dealt + 2])
