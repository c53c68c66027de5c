"""What a step leaves on disk: shuffles end with the step, layers come in slices, rows and text files are small."""

import random
import time

import pytest
from pyspark.sql import functions as F

import gapmeter.session as SS
from gapmeter.catalog import QUERIES
from gapmeter.operators import dedup as DD
from gapmeter.plans import layers as L
from gapmeter.sources import adapter as AD
from gapmeter.streaming import incremental as INC

SF = "/root/testdata/sf0.001"
COLUMNS = [f"c{i}" for i in range(DD.PACKED_COLUMNS)]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files that are there since; they are deleted in the background."""
    until = time.time() + 10
    while (new := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return new


def _counted(spark):
    return spark.range(2000).withColumn("g", F.col("id") % 77).repartition(3, "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def test_a_layer_leaves_no_shuffle_files(spark, tmp_path):
    """Neither its own nor those of what is materialized for it."""
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    before = _shuffle_files(spark)
    out = L.layer(spark, f"file://{tmp_path}", "counted", lambda: SS.materialize(_counted(spark)).repartition(2))
    assert not _left(spark, before)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in _counted(spark).collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_a_layer_in_slices_is_the_whole_layer(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    made = []

    def build():
        for k in range(3):
            made.append(k)
            yield spark.range(k * 10, k * 10 + 10).withColumn("jahr", F.col("id") % 2)

    out = L.layer(spark, f"file://{tmp_path}", "sliced", build, partition_by=["jahr"])
    assert sorted(r.id for r in out.collect()) == list(range(30)) and made == [0, 1, 2]


def _key(r):
    return tuple((x is not None, x) for x in r)


def _texts(spark):
    """Rows of text with nulls, empty texts and the characters that a packed row uses itself."""
    rng, some = random.Random(3), ["\x00", "\x01", "\x02", "\x03", "\x04", "\x05", "a", "ä", "\U0001f600", '"', "\n", " "]
    text = lambda: None if rng.random() < 0.3 else "".join(rng.choice(some) for _ in range(rng.randrange(3)))
    rows = [(rng.choice([None, "1", "2"]), rng.choice([None, *"abcdefghij"]), *[text() for _ in COLUMNS]) for _ in range(1500)]
    least = {}
    for r in rows:
        least[r[:2]] = min(least.get(r[:2], r), r, key=_key)
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["jahr", "id", *COLUMNS])).repartition(3), sorted(least.values(), key=_key)


def test_text_rows_move_as_one_text_and_keep_their_order(spark):
    df, want = _texts(spark)
    out = DD.keep_one(df, ["jahr", "id"], broadcast_keys=3)
    assert sorted((tuple(r) for r in out.collect()), key=_key) == want and out.columns == df.columns
    moved = out._jdf.queryExecution().optimizedPlan()
    while "RepartitionByExpression" not in moved.nodeName():
        moved = moved.children().apply(0)
    assert moved.output().size() == 3       # two keys and the row


@pytest.mark.parametrize("crowded", [10**6, 40])
def test_slices_by_key_together_are_the_kept_rows(spark, monkeypatch, crowded):
    monkeypatch.setattr(SS, "SLICE_ROWS", 400)
    df, want = _texts(spark)
    got = [[tuple(r) for r in x.collect()] for x in DD.kept_slices(df, ["jahr", "id"], broadcast_keys=3, crowded=crowded)]
    assert len(got) == 4 and all(got) and sorted(sum(got, []), key=_key) == want
    assert len(list(DD.kept_slices(df, ["jahr", "id"]))) == 1     # few repeated keys: rows stay where they are


def test_slices_are_bounded():
    assert [SS.slices(n) for n in (0, 1, SS.SLICE_ROWS, SS.SLICE_ROWS + 1, 10**12)] == [1, 1, 1, 2, SS.MAX_SLICES]


def test_joined_rows_in_slices_are_the_joined_rows(spark, monkeypatch):
    rows = lambda df: sorted(map(repr, df.collect()))
    monkeypatch.setattr(SS, "SLICE_ROWS", 2000)
    parts = [rows(x) for x in AD.base_slices(spark, SF)]
    assert len(parts) == 3 and all(parts) and sorted(sum(parts, [])) == rows(AD.base_rows(spark, SF))


def test_dedup_moves_no_column_that_follows_from_others(spark):
    moved = set(AD.registration_keys(AD.base_rows(spark, SF)).columns)
    assert not moved & {"mass", "yr", "p_partkey", "l_tax", "l_extendedprice", "p_retailprice", "r_name"}
    kinds = dict(AD.registration_keys(AD.base_rows(spark, SF)).dtypes)
    assert kinds["id"] == "bigint" and kinds["jahr"] == "int"
    assert {t for _, t in AD.registration_raw(spark, SF).dtypes} == {"string"}


def test_text_files_are_compressed(spark):
    assert QUERIES["core_from_text"](spark, SF).count()
    path = next(p for _, p in reversed(INC._SCRATCH) if "/text-registration-" in p)
    sc = spark.sparkContext
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    assert [n for n in names if n.startswith("part-")] and all(n.endswith(".csv.gz") for n in names if n.startswith("part-"))
