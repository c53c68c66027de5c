"""Collocations by Toivonen's method: phrases of 2 to 4 words and how firmly their parts hold together, per language.

1. A share of the documents is mined level by level with a lowered threshold; what is frequent there is proposed.
2. A pass over all documents counts every word, and every phrase whose two longest parts are both proposed: the
   proposed phrases and their negative border, exactly. A border phrase that proves frequent is a failure of the sample:
   it joins the proposals, and a further pass counts the phrases that this brings in, of any length (and no phrase
   twice). Then no frequent phrase can be uncounted.
3. A last pass takes the frequent phrases as text and counts them again by text, so no result rests on a hash.

The passes know the proposals as a bit array of bounded size, the same for every task. A place taken by chance only
lets a phrase in that need not be counted: whether a phrase is counted depends on its words alone, so a count is
always whole. Tasks count with numpy over about 1 MB of text at a time and send (phrase, count) rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WordHasher, mix64, rolling, text_groups

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
TEXT_BYTES = 1 << 20


class Words:
    """Words of a group of texts: hashes, places, and the keys of all phrases in them."""

    @staticmethod
    def hasher() -> WordHasher:
        h = WordHasher(31)
        h.space[:] = False
        h.space[list(BREAKS + b" \t")] = True
        return h

    def __init__(self, langs: list[str], texts: list[bytes], hasher: WordHasher):
        self.buf = b"\n".join(texts).translate(LOWER)
        b = np.frombuffer(self.buf, np.uint8)
        gap = hasher.space[b] if len(b) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
        self.start, self.end = edge[::2], edge[1::2]
        breaks = np.zeros(256, bool)
        breaks[list(BREAKS)] = True
        self.piece = np.searchsorted(np.flatnonzero(breaks[b]), self.start) if len(b) else np.zeros(0, np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        names = list(dict.fromkeys(langs))
        code = {n: i for i, n in enumerate(names)}
        self.names = names
        self.lang = np.array([code[x] for x in langs], np.int64)[np.searchsorted(ends, self.start, side="right")]
        salt = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
        self.hash, self.salt = hasher.words(self.buf), salt[self.lang]

    def keys(self, k: int) -> np.ndarray:
        """Key of each run of k words; its two low bits are k - 1."""
        h = rolling(self.hash, k, 40 + k)
        return mix64(h ^ self.salt[:len(h)]) & ~np.uint64(3) | np.uint64(k - 1)

    def whole(self, k: int) -> np.ndarray:
        """Whether each run of k words lies in one piece."""
        return self.piece[:max(0, len(self.piece) - k + 1)] == self.piece[k - 1:]


class Places:
    """Bit array that phrases are looked up in; two places for each key. No bits: nothing is in it."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.last = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (2, 33):
            at = (keys >> np.uint64(shift)) & self.last
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _groups(batches):
    """(langs, texts) of about TEXT_BYTES; longer texts are cut behind a break between pieces, where there is one."""
    for (langs,), texts in text_groups(batches, TEXT_BYTES):
        small = [i for i, t in enumerate(texts) if t and len(t) <= TEXT_BYTES]
        if small:
            yield [langs[i] for i in small], [texts[i] for i in small]
        for lang, t in zip(langs, texts):
            at = 0
            while t and len(t) > TEXT_BYTES and at < len(t):
                end = at + TEXT_BYTES
                if end < len(t):
                    cut = max(t.rfind(bytes([c]), at, end) for c in BREAKS)
                    if cut < 0:
                        cut = min((x for x in (t.find(bytes([c]), end) for c in BREAKS) if x >= 0), default=len(t))
                    end = cut + 1
                yield [lang], [t[at:end]]
                at = end


def _counted(keys: np.ndarray):
    s = np.sort(keys)
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[start], np.diff(np.concatenate((start, [len(s)])))


def _count_pass(docs: DataFrame, first: bool, shared, ahead: bool = False) -> DataFrame:
    """(key, n) over ``docs``: all words in the first pass; phrases with both longest parts in the first
    bit array of ``shared`` but not both in the second. ``ahead``: a part that is counted in this pass
    itself may do, so that what longer phrases need is there, whichever of the parts prove frequent."""
    def run(batches):
        now, before = (None if x is None else Places(x) for x in shared.value)
        hasher = Words.hasher()
        for langs, texts in _groups(batches):
            w = Words(langs, texts, hasher)
            part, taken = w.keys(1), None
            if first and len(part):
                yield _rows(*_counted(part))
            if now is None:
                continue
            for k in range(2, LONGEST + 1):
                fits = now.has(part)
                if ahead and taken is not None:
                    fits |= taken
                take = w.whole(k) & fits[:-1] & fits[1:]
                if before is not None and take.any():
                    is_old = before.has(part)
                    take &= ~(is_old[:-1] & is_old[1:])
                part, taken = w.keys(k), take
                if take.any():
                    yield _rows(*_counted(part[take]))
                if not len(part):
                    break

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _with(bits: np.ndarray, keys: DataFrame) -> np.ndarray:
    """``bits`` and the places of ``keys``; at most one row per 64 places comes to the driver."""
    last = len(bits) * 64 - 1
    at = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(last)) for s in (2, 33)])).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = bits.copy()
    out[words.column("word").to_numpy()] |= words.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(docs: DataFrame, least: int, first: bool, new: np.ndarray | None, old: np.ndarray | None, ahead: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((new, old))
    found = materialize(_count_pass(docs, first, shared, ahead).where(F.col("n") >= least))
    shared.destroy()
    return found


def _parts(found: DataFrame) -> DataFrame:
    """Phrases that longer ones may have as a part: all but those of the greatest length."""
    return found.where(F.col("key").bitwiseAND(F.lit(3)) < LONGEST - 1)


def _propose(sample: DataFrame, least: int, most_bits: int) -> np.ndarray:
    """Places of the phrases that are frequent in the sample, mined level by level."""
    found = _passes(sample, least, True, None, None)
    # places for the words and some 15 times as many phrases, 4 for each
    wanted = 1 << math.ceil(math.log2(64 * max(found.count(), 1 << 10)))
    new, old = _with(np.zeros(min(most_bits, wanted) // 64, np.uint64), found), None
    while True:
        more = _with(new, _parts(_passes(sample, least, False, new, old)))
        if (more == new).all():
            return new
        old, new = new, more


def _frequent(docs: DataFrame, least: int, proposed: np.ndarray) -> np.ndarray:
    """Places of all frequent phrases.

    The first pass counts words, proposals and their border. If a frequent phrase was not proposed, a second one counts what
    it can bring in, of any length: phrases whose longest parts are each known by now or counted in this pass
    too. A frequent phrase has frequent parts, so after that none is left uncounted.
    """
    found = _passes(docs, least, True, proposed, None)
    frequent = _with(np.zeros(len(proposed), np.uint64), found)
    new = _with(proposed, _parts(found))
    if (new == proposed).all():
        return frequent
    return _with(frequent, _passes(docs, least, False, new, proposed, ahead=True))


def _spell_pass(docs: DataFrame, shared) -> DataFrame:
    """(lang, phrase, n): phrases found in the bit array ``shared``, and per language the number of words (phrase null)."""
    def run(batches):
        places, hasher = Places(shared.value), Words.hasher()
        for langs, texts in _groups(batches):
            w = Words(langs, texts, hasher)
            size = np.bincount(w.lang, minlength=len(w.names))
            out = [(np.arange(len(size)), [None] * len(size), size)]
            start, end, b = w.start, w.end, np.frombuffer(w.buf, np.uint8)
            # words that one space parts from the next: such phrases stand in the text as they are
            plain = np.concatenate(((end[:-1] + 1 == start[1:]) & (b[end[:-1]] == 32), [False])) if len(start) else np.zeros(0, bool)
            for k in range(1, LONGEST + 1):
                keys = w.keys(k)
                at = np.flatnonzero(w.whole(k) & places.has(keys))
                if not len(at):
                    continue
                _, one, times = np.unique(keys[at], return_index=True, return_counts=True)
                at = at[one]
                buf, as_is = w.buf, np.ones(len(at), bool)
                for j in range(k - 1):
                    as_is &= plain[at + j]
                phrase = [buf[s:e] for s, e in zip(start[at].tolist(), end[at + k - 1].tolist())]
                for i in np.flatnonzero(~as_is).tolist():
                    phrase[i] = b" ".join([buf[start[at[i] + j]:end[at[i] + j]] for j in range(k)])
                out.append((w.lang[at], phrase, times))
            names = pa.array(w.names)
            for lang, phrase, n in out:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                                 ["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, sample_share: int = 8, inside_percent: int = 80,
                 most_bits: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; texts fall into pieces at ``.,;:!?`` and LF to CR, pieces into words at space and tab. a counts the
    phrase, l and r the parts at its weakest cut, n all words of the language; score = floor(2000000 a / (l + r)) at that cut
    (ties: the earliest). Phrases of 2 to 4 words with a >= ``least`` are candidates; one inside a longer candidate
    with at least ``inside_percent`` of its own count is dropped. Order: score, a descending, phrase ascending by UTF-8 bytes.

    Null text: no words. Null language: ``und``. Repeated rows and rows without id count like any other. A language
    without candidates has no row; empty table: no rows. Other columns are ignored, whatever their names.

    One in ``sample_share`` documents (by a hash of the row) is the sample; any sample gives the same result, a poor one takes
    more passes. Proposals are looked up in up to ``most_bits`` places (32 MB, the bound of what is broadcast); beyond about a
    tenth as many proposals, more phrases are counted than need be.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = rows.select("lang", "text")
    sample = rows.where(F.pmod(F.xxhash64("id", "lang", "text"), F.lit(sample_share)) == 0).select("lang", "text")
    proposed = _propose(sample, max(2, least // (2 * sample_share)), most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(texts, least, proposed))
    counts = materialize(_spell_pass(texts, shared))
    shared.destroy()
    return _ranked(counts, least, top, inside_percent)


def _ranked(counts: DataFrame, least: int, top: int, inside_percent: int) -> DataFrame:
    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products pass 64 bits
    size = counts.where("phrase is null").select("lang", F.col("n").alias("n"))
    known = counts.where((F.col("phrase").isNotNull()) & (F.col("n") >= least)).select("lang", "phrase", F.col("n").alias("a"))
    cand = known.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")).where("k > 1")
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = cand.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "i", cut(F.lit(1), F.col("i")).alias("left"), cut(F.col("i") + 1, F.col("k") - F.col("i")).alias("right"))
    part = lambda side, c: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(c))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn(
        "score", F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "l", "r")).alias("x"), F.first("a").alias("a"))
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " ")))))
    inside = cand.where("k > 2").select("lang", span.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * inside_percent)).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within parts of a language, so that no task has all of one
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
