"""Stages and the whole pipeline."""

import os
import subprocess
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def pipeline(monkeypatch):
    monkeypatch.syspath_prepend(ROOT)
    import corpus_pipeline
    return corpus_pipeline


def _documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as long) as n_chars")


def test_stages_keep_columns_and_take_effect(spark, edge_rows, sf, pipeline):
    docs = _documents(spark, edge_rows)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "bpe"]
    f = dict(pipeline.STAGES)
    kept = f["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in edge_rows if any(c.isalpha() for c in r[1] or ""))
    unique = f["simhash_near_dedup"](spark, docs, sf).collect()
    ids = [r.doc_id for r in unique if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 70 not in ids and sum(r.doc_id is None for r in unique) == 2
    dedup = f["substring_dedup"](spark, docs, sf)
    assert dedup.columns == docs.columns
    for r in dedup.collect():
        assert r.text is None or r.n_chars == len(r.text)
    mixed = f["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and all((r.text or "").split() for r in mixed.collect())
    tokens = f["bpe"](spark, docs, sf).collect()
    assert len(tokens) == len(edge_rows) and all(len(r.ids) == r.n_tokens for r in tokens)


def test_stages_on_no_rows(spark, sf, pipeline):
    docs = _documents(spark, [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_run_equals_stages_by_hand(spark, sf, pipeline, tmp_path):
    got = pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == Counter((r.doc_id, r.ids_sha256) for r in docs.collect())


def test_language_rejects_unlearned_scripts_of_any_length(spark, sf, pipeline):
    """Words in a script that no training row has don't vote; such a text goes, however long, and the learned ones stay."""
    import random
    from gapmeter.llm import langid
    rng = random.Random(2)
    there = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    cyrillic = {10**9 + 5 * n: " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randrange(3, 9))) for _ in range(n)) for n in (1, 10, 50, 100, 1000)}
    docs = there.unionByName(spark.createDataFrame([(i, t) for i, t in cyrillic.items()], "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in dict(pipeline.STAGES)["language_id"](spark, docs, sf).select("doc_id").collect()}
    assert not kept & set(cyrillic) and len(kept) > 0.97 * there.where("text rlike '[a-z]'").count()
    model = {"langs": ["a", "b"], "words": {}, "grams": {1: {"_": [-1.0, -2.0], "z": [-7.0, 0.0]}}}
    assert langid.Scorer(model).predict("ж " * 500) == ("a", 0.5)


def test_rows_without_id_are_deduplicated(spark, sf, pipeline):
    """Copies without an id go like others: one row of a group stays, none where a row with an id has the text."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en", "s"), (None, a, "en", "s"), (None, a, "en", "t")] + [(None, b, "en", "s")] * 5 + [(None, b, "en", "t"), (None, c, None, None)]
    got = dict(pipeline.STAGES)["simhash_near_dedup"](spark, _documents(spark, rows), sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (None, b), (None, c)])


def test_rows_without_id_are_mixed_like_others(spark, sf, pipeline):
    """Sources of rows without id reach the targets of the mix, and no row more copies than its cap."""
    rows = [(None, " ".join(f"{s}{i}x{k}" for k in range(20)), "en", s) for s in "uvwxyz" for i in range(40)] + [(None, "one row again", "en", "u")] * 3
    docs = _documents(spark, rows)
    got = dict(pipeline.STAGES)["mixing"](spark, docs, sf).collect()
    from gapmeter.llm import mixing
    want = {r.source: r.target for r in mixing.targets(spark.createDataFrame(
        [(s, sum(len(t.split()) for _, t, _, x in rows if x == s)) for s in "uvwxyz"], "source string, source_size long")).collect()}
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - want[s]) <= 20 for s in want)
    times, there = Counter(r.text for r in got), Counter(r[1] for r in rows)
    assert all(n <= 2 * there[t] for t, n in times.items()) and len(times) > 150


def test_entry_lives_without_the_subpackage(tmp_path):
    """A copy of the library without the llm folders and the pipeline still answers."""
    import shutil
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/gapmeter", tmp_path / "gapmeter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
