"""Exact line numbers in files that are read in splits."""

import random

import pytest

from gapmeter.sources import load as L


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _files(tmp_path, rng):
    out = {}
    for name, n in (("b.csv", 300), ("a.csv", 90), ("one.csv", 1)):
        lines = ["x,y,z"] + [rng.choice(["1,2,3", "1,2", "1,2,3,4", '"a,b",2,3', '"a ""q"", b",2', "", "é" * 200 + ",2"]) for _ in range(n - 1)]
        out[name] = lines
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "a.csv" else ""), encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    return out


def _fields(line):
    if not line:
        return 0
    n, inside = 1, False
    for c in line:
        inside ^= c == '"'
        n += c == "," and not inside
    return n


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    files = _files(tmp_path, random.Random(4))
    lines = L.numbered_lines(spark, f"file://{tmp_path}")
    assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 5
    got = {(r.datei.rsplit("/", 1)[1], r.zeilennummer): r.zeile for r in lines.collect()}
    assert got == {(f, i): x for f, ls in files.items() for i, x in enumerate(ls, 1)}


def test_bad_lines_and_the_first_of_them(spark, tmp_path, small_splits):
    files = _files(tmp_path, random.Random(5))
    bad = L.bad_lines(spark, f"file://{tmp_path}", 3)
    want = sorted((f, i, _fields(x), x[:150]) for f, ls in files.items() for i, x in enumerate(ls, 1) if _fields(x) != 3)
    got = [(r.datei.rsplit("/", 1)[1], r.zeilennummer, r.felder, r.anfang) for r in bad.collect()]
    assert sorted(got) == want and len(want) > 50
    assert [(r.datei.rsplit("/", 1)[1], r.zeilennummer) for r in L.first_bad_lines(bad, 25).collect()] == [w[:2] for w in want[:25]]


def test_no_line_moves(spark, tmp_path):
    _files(tmp_path, random.Random(6))
    plan = L.numbered_lines(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SinglePartition" not in plan
