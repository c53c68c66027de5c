"""The keyed sink: every key once, batches that read only what they touch, merges and reruns that change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from gapmeter.streaming import incremental as INC
from gapmeter.streaming.keyed import KeyedSink, run_keyed

SCHEMA = "jahr int, id long, v string"


@pytest.fixture
def sink(spark, tmp_path):
    return KeyedSink(spark, f"file://{tmp_path}/sink", ["jahr", "id"], buckets=8, merge=3)


def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _keys(sink):
    return sorted(((r.jahr, r.id) for r in sink.read(SCHEMA).collect()), key=str)


def test_each_key_once_over_many_batches(spark, sink):
    rng, seen = random.Random(3), set()
    for n in range(10):
        rows = [(rng.choice([None, 2020, 2021]), rng.choice([None, *range(40)]), f"{n}") for _ in range(30)]
        rows += [(2022, 5, f"{n} {i}") for i in range(40)]  # a key with over half of all rows
        sink.add(_batch(spark, rows), n)
        seen |= {r[:2] for r in rows}
        assert _keys(sink) == sorted(seen, key=str)
    assert sink.spans() == [(0, 8), (9, 9)]  # merged by threes, twice


def test_a_batch_reads_only_the_buckets_it_touches(spark, sink):
    for n in range(2):
        sink.add(_batch(spark, [(2020, i, "a") for i in range(n * 200, n * 200 + 200)]), n)
    sink.add(_batch(spark, [(2020, 7, "b"), (2020, 7, "c")]), 2)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(2020), F.lit(7).cast("long")), F.lit(8))).first()[0]
    assert sorted(x.rsplit("/", 2)[1:] for x in sink.last_read) == [[f"span={k}_{k}", f"bucket={bucket}"] for k in range(2)]
    assert len(_keys(sink)) == 400


def test_files_of_a_bucket_stay_few(spark, sink):
    for n in range(18):
        sink.add(_batch(spark, [(2020, n, "a"), (2020, n - 1, "b")]), n)
    assert sink.spans() == [(0, 8), (9, 17)]
    sink.add(_batch(spark, [(2020, i, "z") for i in range(-1, 18)]), 18)
    assert len(sink.last_read) <= 8 * 2 and len(_keys(sink)) == 19


def test_a_batch_run_twice_counts_once(spark, sink):
    rows = [(2020, i, "a") for i in range(20)]
    sink.add(_batch(spark, rows), 0)
    sink.add(_batch(spark, rows[:3] + [(2021, 1, "b")]), 1)
    once = _keys(sink)
    sink.add(_batch(spark, rows[:3] + [(2021, 1, "b")]), 1)  # its own span again
    assert _keys(sink) == once and len(once) == 21
    sink.add(_batch(spark, [(2022, 1, "c")]), 2)  # completes a merge
    assert sink.spans() == [(0, 2)]
    sink.add(_batch(spark, [(2022, 1, "c")]), 2)  # merged already
    assert sink.spans() == [(0, 2)] and len(_keys(sink)) == 22


def test_a_merge_that_died_changes_nothing(spark, sink, tmp_path):
    for n in range(2):
        sink.add(_batch(spark, [(2020, n, "a")]), n)
    half = tmp_path / "sink" / "span=0_1" / "bucket=0"  # no success mark
    half.mkdir(parents=True)
    assert sink.spans() == [(0, 0), (1, 1)] and len(_keys(sink)) == 2
    (tmp_path / "sink" / "span=0_0" / "keep").mkdir()  # old spans that were not deleted don't count beside the merged one
    sink.add(_batch(spark, [(2020, 2, "a")]), 2)
    sink._bucketed(_batch(spark, [(2020, 0, "a")])).write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("bucket").parquet(sink._folder((0, 0)))
    assert sink.spans() == [(0, 2)] and len(_keys(sink)) == 3


def test_stream_into_the_sink_resumes(spark, tmp_path):
    src, ck = f"file://{tmp_path}/src", f"file://{tmp_path}/ck"
    sink = KeyedSink(spark, f"file://{tmp_path}/out", ["jahr", "id"], buckets=4, merge=2)
    total = set()
    for part in range(3):
        rows = [(2020, i, f"{part}") for i in range(part * 5, part * 5 + 8)]
        total |= {r[:2] for r in rows}
        _batch(spark, rows).repartition(2).write.mode("append").parquet(src)
        run_keyed(INC.file_stream(spark, src, _batch(spark, rows).schema, max_files=1), sink, ck)
        assert _keys(sink) == sorted(total, key=str)
