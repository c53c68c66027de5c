"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the histograms
of reference languages by Jensen-Shannon distance. Everything is taken from the documents: a language with enough documents
is a reference, its common words are those in most of its documents, its histograms are sums over its documents
that pass the base rules, and how far a document may be off is a multiple of the median distance of
those documents from their own reference. A document is kept if it passes the base rules and some language is near enough in
both histograms. Histograms of short documents say little: below a minimum length a distance isn't judged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Java character classes, none of which overlap, frequent ones first; what none matches is the last class.
CLASSES = {"lower": "a-z", "space": r"\x20\x09-\x0D", "upper": "A-Z", "digit": "0-9", "point": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>", "wide": r"\x{80}-\x{10FFFF}"}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def common_words(docs: DataFrame, per_language: int, least_docs: int, least_words: int, text_col: str, lang_col: str) -> list[str]:
    """The ``per_language`` words in most documents (ties: by word) of each language with ``least_docs`` documents
    of ``least_words`` words; all languages together, in order."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("ref"), _words(F.col(text_col).cast("string")).alias("w"))
    # the empty word stands for the document itself
    own = F.array_append(F.array_distinct("w"), F.lit(""))
    counts = rows.where(F.size("w") >= least_words).select("ref", F.explode(own).alias("word")).groupBy("ref", "word").agg(F.count("*").alias("n"))
    first = Window.partitionBy("ref").orderBy((F.col("word") == "").desc(), F.col("n").desc(), "word")
    top = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language + 1).collect()  # as many rows per language
    enough = {r.ref for r in top if r.word == "" and r.n >= least_docs}
    return sorted({r.word for r in top if r.word and r.ref in enough})


def base_counts(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, ``more``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes, common: counts of one pass. A histogram is an array of
    (bin, count); bins that are not in it have no count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", _words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    # the last two have no whole window
    triples = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("h", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(triples, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))))
    several = F.size(F.array_distinct("h")) < F.size("h")
    # windows with an equal one, by a sort of (hash, place); most texts have none and skip it
    placed = F.when(several, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.withColumn("s", placed)
    near = lambda x, i, to: F.coalesce(F.get("s", i + to)["x"] == x["x"], F.lit(False))
    same = F.filter("s", lambda x, i: F.coalesce((i > 0) & near(x, F.greatest(i, F.lit(1)), -1), F.lit(False)) | near(x, i, 1))
    rows = rows.withColumn("at", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    # what a class removes is counted, and only the rest is looked at again, the most frequent classes first
    left, counted = F.col("text"), []
    for name, chars in CLASSES.items():
        rows = rows.withColumn(f"t_{name}", F.regexp_replace(left, f"[{chars}]+", ""))
        counted.append((F.length(left) - F.length(f"t_{name}")).cast("long").alias(name))
        left = F.col(f"t_{name}")
    rows = rows.withColumn("c", F.struct(*counted, F.length("text").cast("long").alias("all")))
    rows = rows.withColumn("known", F.filter("w", lambda x: x.isin(vocabulary)) if vocabulary else F.array().cast("array<string>"))
    listed = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    seen = F.transform(F.array_distinct("known"), lambda w: F.struct((F.array_position(listed, w) - 1).cast("int").alias("i"),
                                                                     (F.size("known") - F.size(F.array_remove("known", w))).cast("long").alias("n")))
    rest = F.array(F.struct(F.lit(len(vocabulary)).alias("i"), (F.col("n_words") - F.size("known")).alias("n")))
    named = [F.col(f"c.{n}") for n in CLASSES]
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "w", "lines", "h", "s", "at", "c", "known", "n_words", *(f"t_{n}" for n in CLASSES))], "n_words",
        F.col("c.all").alias("n_chars"), (F.col("c.all") - F.col("c.space")).alias("word_chars"), F.col("c.symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(F.array(*named, F.col("c.all") - reduce(lambda a, b: a + b, named)), lambda n, i: F.struct(i.alias("i"), n.alias("n"))).alias("classes"),
        F.concat(seen, rest).alias("common"))


def _bits(x: Column) -> Column:
    """x log2 x, 0 at 0."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _shares(histogram: Column, total: Column) -> Column:
    """The bins that have a count, as (bin, share of ``total``)."""
    return F.transform(F.filter(histogram, lambda x: x["n"] > 0), lambda x: F.struct(x["i"].alias("i"), (x["n"] / total).alias("p")))


def _distances(shares: Column, references: list[list[int]]) -> Column:
    """Jensen-Shannon distances (base 2, 0 to 1) of one histogram from each of some fixed ones, rounded to six digits.

    With b(x) = x log2 x the squared distance is 1 + (sum b(p) + sum b(q) - sum b(p + q)) / 2. Bins without a
    count add b(q) - b(q) = 0, so only the document's own bins are gone through."""
    def one(counts: list[int]) -> Column:
        total = float(sum(counts))
        q = F.array(*[F.lit(x / total) for x in counts])
        own = F.array(*[F.lit(x / total * math.log2(x / total) if x else 0.0) for x in counts])  # b(q)
        sums = F.aggregate(shares, F.lit(0.0), lambda a, x: a + (_bits(x["p"]) + F.get(own, x["i"]) - _bits(x["p"] + F.get(q, x["i"]))))
        # an empty histogram shares nothing with the reference, but counts as all in no bin: half of its mass
        return F.round(F.sqrt(F.greatest(F.when(F.size(shares) > 0, 1 + sums / 2).otherwise(F.lit(0.5)), F.lit(0.0))), 6)
    return F.array(*[one(c) for c in references])


def judge(docs: DataFrame, class_factor: float = 2.0, word_factor: float = 2.0, least_chars: int = 200, least_words: int = 80, words_per_language: int = 20,
          least_docs: int = 20, least_limit: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance (to the nearest language), kept.

    A language with ``least_docs`` documents that pass the base rules is a reference. Its limits are ``class_factor`` and
    ``word_factor`` times the median distance (rounded to four digits) of those documents from it, of the ones long enough to be judged:
    ``least_chars`` characters in words for classes, ``least_words`` words for common words; no limit is below
    ``least_limit``, however alike they are. Common words are the
    ``words_per_language`` ones in most documents of 50 words or more, of each language with ``least_docs`` of them.

    Null text: no words, so base_failed. Null or rare lang: judged, but part of no reference. Without any reference nothing is
    judged and distances are null. Repeated rows stay and count twice in references. Empty table: no rows. Other columns are ignored.
    """
    vocabulary = common_words(docs, words_per_language, least_docs, 50, text_col, lang_col)
    rows = base_counts(docs, vocabulary, id_col, text_col, F.col(lang_col).cast("string").alias("ref"))
    rows = materialize(rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    kinds = {"classes": (len(CLASSES) + 1, class_factor, F.col("word_chars") >= least_chars), "common": (len(vocabulary) + 1, word_factor, F.col("n_words") >= least_words)}
    good = rows.where(~F.col("base_failed") & F.col("ref").isNotNull())
    found = good.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).collect()  # a row per language
    found.sort(key=lambda r: r["ref"])
    counts = {(r["ref"], a): [0] * n for r in found for a, (n, _, _) in kinds.items()}
    for a in kinds if found else ():  # rows per language and bin
        bins = good.where(F.col("ref").isin([r["ref"] for r in found])).select("ref", F.explode(a).alias("x")).groupBy("ref", "x.i").agg(F.sum("x.n").alias("n"))
        for r in bins.collect():
            counts[r["ref"], a][r["i"]] = r["n"]
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not found:
        none = F.lit(None).cast("double")
        return rows.select(*base, none.alias("class_distance"), none.alias("word_distance"), (~F.col("base_failed")).alias("kept"))
    # shares once per document, not once per bin or language
    rows = rows.withColumns({"p_classes": _shares(F.col("classes"), F.col("n_chars")), "p_common": _shares(F.col("common"), F.col("n_words"))})
    rows = rows.withColumns({f"d_{a}": _distances(F.col(f"p_{a}"), [counts[r["ref"], a] for r in found]) for a in kinds})
    rows = materialize(rows.drop("classes", "common", "p_classes", "p_common"))
    # a median of distances in steps of 0.0001: its state is bounded
    own = F.array_position(F.array(*[F.lit(r["ref"]) for r in found]), F.col("ref")).cast("int") - 1
    medians = {r["ref"]: r for r in rows.where(~F.col("base_failed") & F.col("ref").isin([r["ref"] for r in found])).groupBy("ref").agg(
        *[F.percentile(F.when(long, F.round(F.get(f"d_{a}", own), 4)), 0.5).alias(a) for a, (_, _, long) in kinds.items()]).collect()}

    def near(at, lang):  # both histograms near this language, as far as they are judged
        each = []
        for a, (_, factor, long) in kinds.items():
            if (m := medians[lang][a]) is not None:
                each.append(~long | (F.get(f"d_{a}", F.lit(at)) <= max(least_limit, round(factor * m, 6))))
        return reduce(lambda x, y: x & y, each, F.lit(True))
    fits = reduce(lambda x, y: x | y, [near(i, r["ref"]) for i, r in enumerate(found)])
    return rows.select(*base, F.array_min("d_classes").alias("class_distance"), F.array_min("d_common").alias("word_distance"),
                       (~F.col("base_failed") & fits).alias("kept"))
