import os
import random

import pytest

# the same names as in the conftest above: run together, either of the two may be the one that is imported
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "eins", "zwei", "été", "日本", "x1", "don't", "###"]


def some_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls in any column, empty and long texts, ties, repeated rows, copies, shared passages."""
    rng = random.Random(3)
    shared = " ".join(some_text(rng, 60).split())
    rows = [(None, "alpha beta gamma", "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "de", None), (3, " \n\t ", None, "b"),
            (4, "one", "en", "b"), (5, "one two", "en", "b"), (-7, shared, "en", "c")]
    for i in range(10, 60):
        body = some_text(rng, rng.choice([1, 12, 13, 14, 40, 200]))
        rows.append((i, body + shared[:rng.randrange(len(shared))] + " " + some_text(rng, 5), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    rows += [rows[12], rows[12], (70, rows[12][1], "en", "a"), (12, "another text under an id used before " * 9, "en", "z")]
    rows.append((80, some_text(rng, 60_000), "en", "a"))
    rows.append((81, "y" * 300_000, "en", "a"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows, SCHEMA)
    for name in ("score", "n_words", "chunk", "fp", "range", "key", "size", "lang_pred", "held_out", "component_id", "target", "__text", "guest"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")
