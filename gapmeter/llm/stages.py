"""Stages of the corpus pipeline; each applies one operator's decisions to ``docs``.

All but the last keep the columns of documents. A stage's result depends on ``docs``
alone (the language model learns from it, quality weights come from labels).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, bpe, langid, mixing, simhash
from ..session import apply_session_defaults, materialize
from .common import WORD, held_out_column, table

#: A prediction below this probability counts as rejected, like ``und``.
LEAST_SCORE = 0.5
#: So is a text of several words if less than this share of its letters belongs to the predicted language.
LEAST_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letters or null text (``und``), no language reaches LEAST_SCORE, or
    the letters of a text of several words are to less than LEAST_KNOWN those of the language."""
    apply_session_defaults(spark)
    model = langid.learn(docs, ~held_out_column())
    single = ~F.col("text").rlike(r"\p{L}\P{L}+\p{L}")
    found = langid.identify(docs, model, keep=docs.columns, pred_col="__lang", score_col="__score", known_col="__known")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE) & ((F.col("__known") >= LEAST_KNOWN) | single)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest doc_id, of its rows the first by content.

    A group without any id keeps the row whose digest is the smallest. Rows with neither
    id nor words have nothing to be told by and stay.
    """
    apply_session_defaults(spark)
    digest = F.when(F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False)),
                    F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    found = materialize(simhash.near_duplicates(docs, shingle=3, max_bits=2, row=digest))
    keep = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")))
    joined = docs.join(keep, F.col("doc_id") == F.col("__id"))
    out = joined.where("__n = 1").select(*docs.columns)
    if keep.where("__n > 1").limit(1).count():
        first = joined.where("__n > 1").select("__id", F.struct(*docs.columns).alias("__row")).groupBy("__id").agg(F.min("__row").alias("r"))
        out = out.union(first.select("r.*"))
    nameless = docs.where("doc_id is null").withColumn("__row", digest)
    out = out.union(nameless.where("__row is null").select(*docs.columns))
    only = materialize(found.where("component_id is null and row is not null").groupBy("component").agg(F.min("row").alias("__row")).select("__row"))
    # equal rows share a digest: one of them stays
    return out.union(nameless.join(only, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the text (n_chars follows); a document that is nothing else goes."""
    apply_session_defaults(spark)
    found = anchors.substring_dedup(docs, window=13, with_text=True, keep=docs.columns).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("keep_n_chars"))}
    return found.select(*[new.get(c, F.col(f"keep_{c}")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; what it doesn't take goes.

    Rows are told apart by id, source and a digest of all columns; equal rows share their copies.
    """
    apply_session_defaults(spark)
    keyed = docs.withColumn("__d", F.xxhash64(*docs.columns))
    found = mixing.mix(docs, quality=mixing.label_quality(table(spark, sf_dir, "labels")), row=F.xxhash64(*docs.columns))
    copies = materialize(found.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("row").alias("__r"))
                         .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")).where("__copies > 0"))
    taken = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__d") == F.col("__r")))
    once = taken.where("__n = 1")
    if copies.where("__n > 1").limit(1).count():
        once = once.union(taken.where("__n > 1").dropDuplicates(["__id", "__s", "__r"]))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__k")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each document left."""
    apply_session_defaults(spark)
    # workers that earlier stages have used keep some of their memory: less for this one
    return bpe.encode_documents(docs, read_vocabulary(), public_tokenizers.PATTERN, with_ids=True, cache_pieces=60_000, max_states=60_000)


def read_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()
