"""Toxicity: character n-grams, scaled by naive Bayes log-count ratios, under a linear model.

A text's features are its character 3- to 6-grams (lower case, runs of white space as one
space), hashed to ``DIMENSIONS`` places, as occurrences per 100 words. Each place has a
ratio r = log((1 + its sum over positive texts) / (all + ...)) - the same for negative
texts. A logistic regression is fitted on features times r, so its weights and the ratios
multiply to one weight per place: the model has a fixed size whatever the corpus, and a
score is a mean over a text that its length doesn't shift.

Ratios are counted and the model is fitted on a sample of labelled training rows bounded
by ``sample_rows`` (in expectation). Feature rows of the sample are written to the shared
folder, each gradient is a Spark job over them; only sums of fixed size reach the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ORDERS = (3, 4, 5, 6)
DIMENSIONS = 1 << 18
SPACES = re.compile(r"\s+")


class Features:
    """Places of a text's n-grams, in slices: no array grows with the text."""

    SLICE = 1 << 16

    def __init__(self):
        r = np.random.default_rng(8)
        self.mult = r.integers(1, 1 << 63, max(ORDERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = r.integers(0, 1 << 63, max(ORDERS) + 1, dtype=np.uint64)

    def slices(self, text: str | None):
        """(number of word ends, places of the n-grams that start in the slice)."""
        s = " " + SPACES.sub(" ", (text or "").lower()).strip() + " "
        c = np.frombuffer(s.encode("utf-32-le"), "<u4")
        shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
        for at in range(0, len(c) if len(c) > 2 else 0, self.SLICE):
            x = c[at:at + self.SLICE + max(ORDERS) - 1].astype(np.uint64)
            parts, h = [], np.zeros(len(x), np.uint64)
            for k in range(max(ORDERS)):
                n = len(x) - k
                if n <= 0:
                    break
                h = h[:n] + x[k:] * self.mult[k]
                if k + 1 in ORDERS:
                    y = h[:self.SLICE] ^ self.salt[k + 1]
                    y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    parts.append((y >> shift).astype(np.int32))
            yield int((c[at + 1:at + 1 + self.SLICE] == 32).sum()), np.concatenate(parts or [np.zeros(0, np.int32)])

    def counts(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, distinct places ascending, occurrences)."""
        words, places, counts = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for n, p in self.slices(text):
            words += n
            u, c = np.unique(p, return_counts=True)
            places, back = np.unique(np.concatenate((places, u)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, c))).astype(np.int64)
        return words, places, counts

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct places, occurrences per 100 words)."""
        words, places, counts = self.counts(text)
        return places, counts * (100 / max(words, 1))

    def mean_weight(self, text: str | None, weight: np.ndarray) -> float:
        """Sum over features of weight times value."""
        words, total = 0, 0.0
        for n, p in self.slices(text):
            words += n
            total += float(weight[p].sum(dtype=np.float64))
        return total * 100 / max(words, 1)


def _shrink(a: np.ndarray) -> bytes:
    return pa.compress(a.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _grow(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, 4 * n, codec="zstd", asbytes=True), "<u4")


def _columns(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(text_col).cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 6_000, steps: int = 25, penalty: float = 1e-3,
          label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Weights and intercept from documents whose ``train`` is true and whose label isn't null.

    Several labels of one document: toxic if any says so. Documents without a label aren't
    used; if either class has no row, every score is near that of the other (0 without rows).
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    total = marks.count()
    limit = int(min(1.0, sample_rows / max(1, total)) * (1 << 30))
    marks = marks.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < limit)
    rows = _columns(docs, text_col, F.col(id_col).alias("id"), train.alias("train")).where("train").join(marks, "id").select("y", "text")

    def extract(batches):
        f = Features()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, places, counts = f.counts(text.as_py())
                blobs = [_shrink(a) for a in (np.diff(places, prepend=0), counts)]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([words], pa.int64()), pa.array([len(places)], pa.int64()),
                                                  *[pa.array([b], pa.binary()) for b in blobs]], ["y", "words", "n", "steps", "counts"])

    sample = materialize(rows.mapInArrow(extract, "y int, words long, n long, steps binary, counts binary").repartition(8))

    def sums(partial, size):
        """Sum over the sample of vectors of ``size`` numbers: a row per task."""
        def run(batches):
            acc = np.zeros(size)
            for batch in batches:
                for y, words, n, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    partial(acc, y, np.cumsum(_grow(steps, n)), _grow(counts, n) * np.float32(100 / max(words, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([acc.astype("<f4").tobytes()], pa.binary())], ["acc"])
        out = np.zeros(size)
        for r in sample.mapInArrow(run, "acc binary").collect():  # 8 rows of fixed size
            out += np.frombuffer(r[0], "<f4")
        return out

    return fit(sums, steps, penalty)


def fit(sums, steps: int, penalty: float) -> dict:
    """The model; ``sums(partial, size)`` adds up partial(acc, label, places, values) over all rows."""
    d = DIMENSIONS

    def count(acc, y, p, x):
        acc[p + (d if y else 0)] += x
        acc[2 * d + (1 if y else 0)] += 1

    c = sums(count, 2 * d + 2)
    n = c[2 * d:]
    if not n.all():
        return {"weight": np.zeros(d, np.float32).tobytes(), "bias": 20.0 if n[1] else -20.0}
    # mean value per text of each class, with one occurrence per 100 words in one text more
    ratio = np.log((1 + c[d:2 * d]) / (2 + n[1])) - np.log((1 + c[:d]) / (2 + n[0]))
    ratio[c[:d] + c[d:2 * d] == 0] = 0
    share = np.array([0.5 / n[0], 0.5 / n[1]])  # both classes weigh the same

    def loss_gradient(w):
        v, b = (w[:-1] * ratio), w[-1]

        def partial(acc, y, p, x):
            z = float(v[p] @ x) + b
            k, s = share[1 if y else 0], 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            acc[p] += k * (s - (1 if y else 0)) * x
            acc[d] += k * (s - (1 if y else 0))
            acc[d + 1] += k * np.logaddexp(0, -z if y else z)

        g = sums(partial, d + 2)
        grad = np.concatenate((g[:d] * ratio, [g[d]]))
        grad[:-1] += penalty * w[:-1]
        return g[d + 1] + penalty / 2 * float(w[:-1] @ w[:-1]), grad

    w = _minimise(loss_gradient, np.zeros(d + 1), steps)
    return {"weight": (w[:-1] * ratio).astype(np.float32).tobytes(), "bias": float(w[-1])}


def _minimise(f, w, steps, memory=6):
    """Limited-memory quasi-Newton descent with halving steps."""
    value, g = f(w)
    past = []
    for _ in range(steps):
        q, keep = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            q -= a * y
            keep.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(keep)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0 if past else min(1.0, 1 / max(np.abs(g).sum(), 1e-9))
        for _ in range(12):
            new = w - step * q
            v, h = f(new)
            if v <= value - 1e-4 * step * float(g @ q):
                break
            step /= 2
        else:
            break
        s, y = new - w, h - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - v < 1e-4 * max(value, 1e-9)
        w, value, g = new, v, h
        if done:
            break
    return w


def score(docs: DataFrame, model: dict, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row, score (0 to 1) and predicted (1 if score >= 0.5).

    Null or empty text: no features, the score of the intercept alone. Rows are scored one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _columns(docs, text_col, *keep)

    def run(batches):
        f, w, b = Features(), np.frombuffer(shared.value["weight"], np.float32), shared.value["bias"]
        for batch in batches:
            z = np.array([f.mean_weight(t.as_py(), w) + b for t in batch.column(batch.num_columns - 1)])
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             [*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("score", "double").add("predicted", "integer"))
