"""Improbable-feature digests of documents.

Every window of 64 bytes has a Shannon entropy, cut to 1001 levels. How rare a level
is over all windows of the corpus ranks it (rarest first; levels below ``FLOOR`` hold
runs of few symbols and never count). In each neighbourhood of 64 windows the rarest,
leftmost one gets a vote; windows with ``VOTES`` or more are the text's features. They
go into Bloom filters of 2048 bits, a new one chained after every 160 features. Two
digests compare filter by filter: the overlap in bits, normalised between what chance
gives and what is possible, best partner for each filter of the smaller digest.

Entropies of all windows come from a running sum: sliding by a byte changes two counts,
and both are counts of equal bytes within 63 places, found by 63 shifted comparisons.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix64, text_groups

WINDOW = 64
LEVELS = 1000
FLOOR = 100
VOTES = 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
TILE = 1 << 17
NO_ID = -(1 << 63)


class Entropy:
    """Levels of all windows of a block of texts."""

    def __init__(self):
        c = np.arange(WINDOW + 2, dtype=float)
        self.plogp = np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0) * (1 << 20)).astype(np.int64)
        self.gain = np.diff(self.plogp)

    def levels(self, b: np.ndarray) -> np.ndarray:
        """Level of the window at each start of ``b``."""
        n, w = len(b), WINDOW
        if n < w:
            return np.zeros(0, np.int64)
        change = np.empty(n - w + 1, np.int64)
        change[0] = self.plogp[np.bincount(b[:w], minlength=256)].sum()
        for at in range(0, n - w, TILE):
            t = b[at:at + TILE + w]
            after, before = np.zeros(len(t), np.uint8), np.zeros(len(t), np.uint8)
            for k in range(1, w):
                same = (t[k:] == t[:-k]).view(np.uint8)
                after[:-k] += same
                before[k:] += same
            m = len(t) - w
            change[at + 1:at + 1 + m] = self.gain[before[w:]] - self.gain[after[:m]]
        bits = 6.0 - np.cumsum(change) / (w << 20)
        return np.clip(np.round(bits * (LEVELS / 6)), 0, LEVELS).astype(np.int64)


def _join(texts: list[bytes]):
    """One buffer with a window of padding after each text; (buffer, starts, windows per text)."""
    starts = np.cumsum([0] + [len(t) + WINDOW for t in texts])[:-1]
    return np.frombuffer((b"\0" * WINDOW).join(texts) + b"\0" * WINDOW, np.uint8), starts, \
        np.array([max(0, len(t) - WINDOW + 1) for t in texts])


def _valid(n: int, starts, windows) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + windows, 1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows per level over all texts (1001 numbers)."""
    def run(batches):
        e, counts = Entropy(), np.zeros(LEVELS + 1, np.int64)
        for _, texts in text_groups(batches, 1 << 20):
            b, starts, windows = _join([t or b"" for t in texts])
            lev = e.levels(b)
            counts += np.bincount(lev[_valid(len(lev), starts, windows)], minlength=LEVELS + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["level", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in found.collect():
        counts[r["level"]] = r["n"]
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, rarest first; -1 below FLOOR. Levels never seen rank as rare."""
    order = np.lexsort((np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    out[:FLOOR] = -1
    return out


class Digest:
    """Fingerprints of many texts with one rank table."""

    def __init__(self, rank: np.ndarray):
        self.rank, self.entropy, self.hasher = rank, Entropy(), WordHasher(seed=2)

    def make(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(features, filters as rows of 256 bytes) of each text."""
        b, starts, windows = _join(texts)
        lev = self.entropy.levels(b)
        n = len(lev)
        rank = self.rank[lev]
        never = 1 << 60
        key = np.where(_valid(n, starts, windows) & (rank >= 0), (rank << 40) + np.arange(n), never)
        low = np.concatenate((key, np.full(WINDOW, never)))
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        low = low[:n][key < never]
        votes = np.bincount(low & ((1 << 40) - 1), minlength=n) if len(low) else np.zeros(n, np.int64)
        at = np.flatnonzero(votes >= VOTES)
        h = self._hash(b, at)
        doc = np.searchsorted(starts, at, "right") - 1
        whole = np.array([i for i, t in enumerate(texts) if t], np.int64)
        whole = whole[~np.isin(whole, doc)]  # too short or too plain for a window: the whole text is the feature
        doc = np.concatenate((doc, whole))
        h = np.concatenate((h, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in whole], np.uint64)))
        o = np.lexsort((h, doc))
        first = np.ones(len(o), bool)
        first[1:] = (h[o][1:] != h[o][:-1]) | (doc[o][1:] != doc[o][:-1])
        pick = np.sort(o[first])
        pick = pick[np.argsort(doc[pick], kind="stable")]
        doc, h = doc[pick], h[pick]
        count = np.bincount(doc, minlength=len(texts))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        filters = -(-count // PER_FILTER)
        row = (np.cumsum(filters) - filters)[doc] + place // PER_FILTER
        bits = np.zeros((int(filters.sum()), BITS), bool)
        for k in range(HASHES):
            bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
        packed = np.packbits(bits, axis=1)
        ends = np.cumsum(filters)
        return [(int(c), packed[e - f:e]) for c, f, e in zip(count, filters, ends)]

    def _hash(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        w, tab = self.hasher, self.hasher.table
        w._powers(WINDOW + 1)
        out = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            out += tab[b[at + k]] * w.up[k]
        return mix64(out)


def as_text(digest: tuple[int, np.ndarray]) -> str:
    return f"{digest[0]}:{base64.b64encode(digest[1].tobytes()).decode()}"


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """0 to 1; two empty digests are alike, an empty and another are not."""
    if not x[0] or not y[0]:
        return float(x[0] == y[0])
    if (len(x[1]), x[0]) > (len(y[1]), y[0]):
        x, y = y, x
    a, b = x[1].view(np.uint64), y[1].view(np.uint64)
    pa_, pb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        chance, most = pa_[i] * pb / BITS, np.minimum(pa_[i], pb)
        score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
        score = np.where((pa_[i] == pb) & (both == pb), 1.0, score)
        total += float(score.max()) * min(PER_FILTER, x[0] - i * PER_FILTER)
    return total / x[0]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text, of the text edited by the next document, and likenesses.

    The next document is the one with the next smaller id (after the last the first; rows of
    one id in text order; a null id comes after all). The last half of the code points gives
    way to as many from the next one's start. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null text: empty. Empty texts:
    no features, alike to one another only. One row alone is its own next. Empty table: no rows.

    Ids are dealt to ranges (sizes from approximate quantiles; any cut is right). The first
    document of a range also goes to the range before it, so no range waits for another
    and the text is shuffled once.
    """
    spark = docs.sparkSession
    rank = ranks(level_counts(docs, text_col))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select("id")
    q = ids.agg(F.percentile_approx("id", [i / (4 * parts) for i in range(1, 4 * parts)], max(10_000, 40 * parts)).alias("q")).first()["q"]
    cuts = np.unique(np.array(q or [], np.int64))

    @F.pandas_udf("int")
    def range_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, s.to_numpy(), "right").astype(np.int32))

    ids = ids.withColumn("range", range_of("id"))
    tops = sorted((r["range"], r["top"]) for r in ids.groupBy("range").agg(F.max("id").alias("top")).collect())  # a row per range
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf("array<int>")
    def places(s: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, s.to_numpy(), "right").tolist()
        return pd.Series([[r, to[i]] if i in to else [r] for r, i in zip(at, s.tolist())])

    dealt = rows.select("id", "text", F.posexplode(places("id")).alias("guest", "range")) \
        .repartitionById(parts, F.pmod("range", F.lit(parts))).select("range", "guest", "id", "text") \
        .sortWithinPartitions("range", "guest", F.desc("id"), "text")

    def run(batches):
        digest, held = Digest(rank), None
        for (where, guest, doc), texts in text_groups(batches, 1 << 20):
            new = list(zip(where, guest, doc, texts, digest.make([t or b"" for t in texts])))
            group = ([held] if held else []) + new
            yield from _rows(digest, group)
            held = group[-1]

    def _rows(digest, group):
        pairs = [(x, y) for x, y in zip(group, group[1:]) if not x[1] and x[0] == y[0]]
        if not pairs:
            return
        edited = []
        for x, y in pairs:
            own, following = (x[3] or b"").decode(), (y[3] or b"").decode()
            half = len(own) // 2
            edited.append((len(own), (own[:len(own) - half] + following[:half]).encode()))
        prints = digest.make([e for _, e in edited])
        yield pa.RecordBatch.from_arrays([
            pa.array([None if x[2] == NO_ID else x[2] for x, _ in pairs], pa.int64()),
            pa.array([n for n, _ in edited], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for _, e in edited], pa.string()),
            pa.array([as_text(x[4]) for x, _ in pairs], pa.string()),
            pa.array([as_text(p) for p in prints], pa.string()),
            pa.array([likeness(x[4], p) for (x, _), p in zip(pairs, prints)], pa.float64()),
            pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
