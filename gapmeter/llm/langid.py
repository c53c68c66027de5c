"""Language ID, word first: known words by log frequency, unseen words by shorter and shorter character n-grams.

Learning counts words per language over a bounded sample of the training rows
(``sample_rows`` in expectation, chosen by a hash of the id) with Spark; only the
``words`` most frequent words and ``grams`` most frequent n-grams per length reach
the driver, so the broadcast model has a fixed bound. Scoring reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
CACHE = 200_000
#: Stands before and after a word; alone it says nothing about the word.
MARK = "_"
#: A letter belongs to a language from this share of its 1-grams on: a few foreign words in its texts don't add a script.
LETTER_SHARE = 1e-4


def learn(docs: DataFrame, train: Column, sample_rows: int = 20_000, words: int = 20_000, grams: int = 10_000,
          text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """Model from the rows where ``train`` is true and text and language aren't null.

    No such row: a model without languages, which answers ``und``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), train.alias("train")) \
        .where("train and lang is not null and text is not null")
    n = rows.select("lang").count()
    share = min(1.0, sample_rows / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 30)) < int(share * (1 << 30)))
    tokens = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = tokens.groupBy("lang", "w").agg(F.count("*").alias("n")).persist()
    try:
        langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
        total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
        top = counts.groupBy("w").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")) \
            .where("n > 1").orderBy(F.desc("n"), "w").limit(words).collect()
        model = {"langs": langs, "words": _table(top, langs, total), "grams": {}}
        for k in ORDERS:
            marked = F.concat(F.lit("_"), "w", F.lit("_"))
            pieces = F.transform(F.sequence(F.lit(1), F.length(marked) - k + 1), lambda i: F.substr(marked, i, F.lit(k)))
            g = counts.where(F.length("w") + 2 >= k).select("lang", "n", F.explode(pieces).alias("w")).where(F.col("w") != MARK) \
                .groupBy("lang", "w").agg(F.sum("n").alias("n"))
            sums = {r[0]: r[1] for r in g.groupBy("lang").agg(F.sum("n")).collect()}
            top = g.groupBy("w").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")) \
                .orderBy(F.desc("n"), "w").limit(grams).collect()
            model["grams"][k] = _table(top, langs, sums)
        return model
    finally:
        counts.unpersist()


def _table(rows, langs, total) -> dict[str, list[float]]:
    """Smoothed log frequency of each entry in each language."""
    a = 0.5
    size = len(rows) + 1
    return {r["w"]: [math.log((r["by"].get(x, 0) + a) / (total.get(x, 0) + a * size)) for x in langs] for r in rows}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.letters = {g: [float(x >= math.log(LETTER_SHARE)) for x in row] for g, row in self.grams.get(1, {}).items()}
        self.place: dict[str, int] = {}
        self.rows = np.zeros((CACHE, max(1, len(self.langs))))
        self.known = np.zeros((CACHE, max(1, len(self.langs))))

    def _row(self, word: str) -> list[float]:
        if (known := self.words.get(word)) is not None:
            return known
        marked = f"_{word}_"
        for k in ORDERS:
            table = self.grams.get(k, {})
            found = [table[g] for i in range(len(marked) - k + 1) if (g := marked[i:i + k]) in table and g != MARK]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(self.langs)

    def _letters(self, word: str) -> list[float]:
        """Per language: how many of the word's letters belong to it."""
        found = [(self.letters[c], n) for c, n in Counter(word).items() if c in self.letters]
        return [sum(x * n for x, n in zip(has, [n for _, n in found])) for has in zip(*(row for row, _ in found))] or [0.0] * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior)"""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, posterior, share of the text's letters that belong to the language)"""
        words = Counter(LETTERS.findall((text or "").lower()))
        if not self.langs or not words or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0, 0.0
        if len(self.place) + len(words) > CACHE:
            self.place.clear()
        score, share = np.zeros(len(self.langs)), np.zeros(len(self.langs))
        seen, times = [], []
        for w, n in words.items():
            at = self.place.get(w)
            if at is None:
                row, known = self._row(w), self._letters(w)
                if len(self.place) < CACHE:
                    at = self.place[w] = len(self.place)
                    self.rows[at], self.known[at] = row, known
                else:  # one text alone has more distinct words than the cache holds
                    score += n * np.array(row)
                    share += n * np.array(known)
                    continue
            seen.append(at)
            times.append(n)
        if seen:
            times = np.array(times, float)
            score += times @ self.rows[seen]
            share += times @ self.known[seen]
        p = np.exp(score - score.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum()), float(share[best] / sum(len(w) * n for w, n in words.items()))


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None,
             pred_col: str = "lang_pred", score_col: str = "score", known_col: str | None = None) -> DataFrame:
    """``keep`` columns of every row plus predicted language and its posterior probability.

    ``known_col`` adds the share of letters that belong to that language: unlike the posterior, a
    longer text doesn't raise it. Words of which not even a letter is known have no vote.

    Null text or no letter: ``und`` with score 0. Ties go to the first language in code point
    order. Rows are judged one by one, repeated ones alike. ``keep`` must not hold the two new names.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c not in (pred_col, score_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    names = [pred_col, score_col] + [known_col] * (known_col is not None)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(zip(*(scorer.judge(t.as_py()) for t in batch.column(batch.num_columns - 1)))) or [(), (), ()]
            new = [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64()))][:len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *names])

    schema = kept.drop("__text").schema.add(pred_col, "string").add(score_col, "double")
    return kept.mapInArrow(run, schema if known_col is None else schema.add(known_col, "double"))
