"""Substring dedup by suffix arrays: bytes inside any string of ``length`` bytes that stands twice or more.

Documents are dealt to shards by a hash of the text, so equal texts meet and are worked on once.

1. Which windows of ``length`` bytes can repeat at all: each window names its least gram (the leftmost
   of equal ones), which is the same wherever the window stands. Shards send their distinct grams as sorted
   blobs, and learn which stand in two places of the corpus. Text without such a gram needs no suffix array.
2. Over what is left, a shard sorts its suffixes by Larsson-Sadakane refinement (first by 8 bytes, then by
   doubled ranks, only groups that are still equal are sorted again) and finds the common
   prefixes of neighbours by Kasai's scan, run in many lanes side by side. Neighbours that share ``length``
   bytes are one class: the shard's distinct windows, and which of them stand there twice.
3. Shards send their classes as sorted runs of fingerprints, cut into equal ranges. A range merges its runs;
   equal fingerprints of two shards are a repeat. One bit per class goes back.

A fingerprint has 2 log2(bytes) + 20 bits, so that at any size the chance that two different windows of the
corpus share one is below 2^-20. Text moves once, all passes read the same exchange.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import cuts, mix64, pack, pack_sorted, unpack, unpack_sorted

#: Bytes hashed at a time, so that what they need stays in a core's cache.
SLICE = 1 << 16
SHARD = 1 << 21
LANE = 512
GRAM = 32
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Above so many texts with very many copies they are joined instead of broadcast.
BROADCAST_ROWS = 100_000


class ByteHasher:
    """Hash of each run of ``width`` bytes of a buffer, by prefix sums over SLICE runs at a time."""

    def __init__(self, width: int, seed: int):
        r = np.random.default_rng(seed)
        base = int(r.integers(1, 1 << 62)) * 2 + 1
        self.width, self.table = width, r.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = (np.full(SLICE + width, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(b) - self.width + 1), np.uint64)
        for a in range(0, len(out), SLICE):
            h, part = out[a:a + SLICE], b[a:a + SLICE + self.width - 1]
            acc = self.table[part]
            acc *= self.up[:len(part)]
            np.cumsum(acc, out=acc)
            h[0] = acc[self.width - 1]
            np.subtract(acc[self.width:], acc[:len(h) - 1], out=h[1:])
            h *= self.down[:len(h)]
            mix64(h)
        return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from the least of 2, 4, 8 and more."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:n], x[width - k:width - k + n]) if k < width else x


def words_at(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, the first byte highest (beyond the end: zeros)."""
    x, k = np.concatenate((b, np.zeros(8, np.uint8))), 1
    for kind in (np.uint16, np.uint32, np.uint64):
        x = x[:-k].astype(kind) << kind(8 * k) | x[k:]
        k *= 2
    return x[:len(b)]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array (Larsson-Sadakane: ranks by twice as many bytes each round, only groups still equal are sorted)."""
    n = len(text)
    key = words_at(text)
    order = np.argsort(key)
    key = key[order]
    live, done = np.arange(n), 8
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at = order
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1], [True]))
        rank[at] = np.maximum.accumulate(np.where(new[:-1], live, 0))  # a group is named by its first place
        equal = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(equal):
            return order
        live, at = live[equal], at[equal]
        ahead = at + done
        second = rank[np.minimum(ahead, n)] + (n + 1)
        ended = np.flatnonzero(ahead >= n)
        second[ended] = n - at[ended]  # the shorter first
        key = rank[at] << 32 | second
        o = np.argsort(key)
        at, key = at[o], key[o]
        order[live] = at
        done *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By place: bytes shared with the suffix one place before, up to ``most``.

    Kasai: going through the text, the next suffix shares at least one byte less. Lanes of LANE bytes
    start at nothing and go side by side, up to 8 bytes a step.
    """
    n = len(text)
    words = np.concatenate((words_at(text).byteswap(), np.zeros(most + 1, np.uint64)))  # the first byte lowest
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n  # shares nothing
    shared = np.zeros(n, np.int32)
    i = np.arange(0, n, LANE)
    end = np.minimum(i + LANE, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        room = np.minimum(n - np.maximum(i, j), most)
        x = words[i + h] ^ words[j + h]
        same = np.bitwise_count(~x & (x - np.uint64(1))) >> 3  # bits below the lowest that differs
        h = np.minimum(h + same, room)
        stop = (same < 8) | (h == room)
        shared[i[stop]] = h[stop]
        i = i + stop
        h = np.maximum(h - stop, 0)
        left = i < end
        if not left.all():
            i, h, end = i[left], h[left], end[left]
    return shared[order]


class Chunk:
    """Distinct texts of a shard in one buffer; ``copies`` counts the rows of each."""

    def __init__(self, rows: pa.Table, length: int):
        self.length = length
        texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
        times = rows.column("times").to_pylist()
        slot: dict[bytes, int] = {}
        self.slots = [slot.setdefault(t, len(slot)) for t in texts]
        self.texts = list(slot)
        self.copies = np.bincount(np.array(self.slots, np.int64), weights=times, minlength=len(slot)).astype(np.int64)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.end = np.cumsum(size)
        self.first = self.end - size
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)
        n = len(self.buf)
        edge = np.zeros(n + 1, np.int8)  # no window starts in the last length - 1 bytes of a text
        np.add.at(edge, np.maximum(self.first, self.end - length + 1), 1)
        np.subtract.at(edge, self.end, 1)
        self.valid = np.cumsum(edge[:-1], dtype=np.int8) == 0

    def weight(self, at: np.ndarray) -> np.ndarray:
        """Rows of the text that holds each byte."""
        return self.copies[np.searchsorted(self.end, at, side="right")]

    def runs(self):
        """Runs of windows with one least gram: first start, end, gram's hash, gram's place."""
        gram = min(GRAM, self.length)
        width, hasher, n = self.length - gram + 1, ByteHasher(gram, 21), len(self.buf) - self.length + 1
        low, out = np.uint64((1 << 24) - 1), []
        for a in range(0, max(n, 0), SLICE):
            ok = self.valid[a:min(a + SLICE, n)]
            if not ok.any():
                continue
            g = hasher(self.buf[a:a + len(ok) + self.length - 1])
            least = sliding_least((g & ~low) | np.arange(len(g), dtype=np.uint64), width)
            start = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]))))
            end = np.concatenate((start[1:], [len(least)]))
            keep = ok[start]
            start, end = start[keep], end[keep]
            at = (least[start] & low).astype(np.int64)
            out.append((a + start, a + end, g[at], a + at))
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        return tuple(map(np.concatenate, zip(*out)))

    def grams(self, bits: int):
        """Distinct gram keys, ascending, and whether each stands in several places."""
        _, _, value, place = self.runs()
        place, one = np.unique(place, return_index=True)
        key = value[one] >> np.uint64(64 - bits)
        o = np.argsort(key, kind="stable")
        key, w = key[o], self.weight(place)[o]
        if not len(key):
            return key, np.zeros(0, bool)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[start], np.add.reduceat(w, start) > 1

    def candidates(self, bits: int, hits: dict, buckets: int) -> np.ndarray:
        """Windows whose gram was found in several places: a flag for each byte."""
        first, end, value, place = self.runs()
        key = value >> np.uint64(64 - bits)
        keys = np.unique(key)
        hit = _marked(keys, bits, buckets, hits)
        ok = hit[np.searchsorted(keys, key)] if len(keys) else np.zeros(0, bool)
        edge = np.zeros(len(self.buf) + 1, np.int8)  # runs don't overlap
        edge[first[ok]] += 1
        edge[end[ok]] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def pieces(self, flags: np.ndarray):
        """Byte ranges [start, end) of one text that flagged windows cover, of at most SHARD windows, and the flags' count."""
        step = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        if not len(step):
            return
        start, end = step[::2], step[1::2] + self.length - 1
        text = np.searchsorted(self.end, start, side="right")
        joined = np.concatenate(([False], (start[1:] <= end[:-1]) & (text[1:] == text[:-1])))
        head = np.flatnonzero(~joined)
        tail = np.concatenate((head[1:], [len(start)])) - 1
        for s, e in zip(start[head].tolist(), end[tail].tolist()):
            for a in range(s, e - self.length + 1, SHARD):
                yield a, min(a + SHARD + self.length - 1, e)

    def groups(self, flags: np.ndarray):
        """``pieces`` put together to about SHARD bytes."""
        group, size = [], 0
        for a, b in self.pieces(flags):
            group.append((a, b))
            size += b - a
            if size >= SHARD:
                yield group
                group, size = [], 0
        if group:
            yield group

    def joined(self, flags: np.ndarray):
        """Of each group the bytes, their places, and which of them start a flagged window."""
        for group in self.groups(flags):
            text = np.concatenate([self.buf[a:b] for a, b in group])
            at = np.concatenate([np.arange(a, b) for a, b in group])
            # a window starts at flagged bytes, but not in the last bytes of a piece: the next piece has those
            start = np.concatenate([flags[a:b] & (np.arange(b - a) <= b - a - self.length) for a, b in group])
            yield text, at, start

    def prints(self, flags: np.ndarray, spare: int):
        """(window start, hash, check) of the flagged windows, in blocks."""
        one, two = ByteHasher(self.length, 22), ByteHasher(self.length, 23)
        for text, at, start in self.joined(flags):
            on = np.flatnonzero(start)
            yield at[on], one(text)[on], _check(two(text)[on], spare)

    def classes(self, flags: np.ndarray, spare: int):
        """Distinct flagged windows as (hash, check), ascending, and whether each stands twice here."""
        one, two, found = ByteHasher(self.length, 22), ByteHasher(self.length, 23), []
        for text, at, start in self.joined(flags):
            order = suffix_order(text)
            of = np.cumsum(common_prefixes(text, order, self.length) < self.length)  # neighbours that share length bytes are one class
            on = start[order]
            order, of = order[on], of[on]
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            several = np.zeros(len(text), bool)
            several[order[begin]] = np.diff(np.concatenate((begin, [len(of)]))) > 1
            place = np.zeros(len(text), bool)
            place[order[begin]] = True
            place = np.flatnonzero(place)
            found.append((one(text)[place], _check(two(text)[place], spare), several[place] | (self.weight(at[place]) > 1)))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        h, c, several = map(np.concatenate, zip(*found))
        o, begin, h, c = _grouped(h, c)
        size = np.diff(np.concatenate((begin, [len(h)])))
        return h[begin], c[begin], np.bitwise_or.reduceat(several[o], begin) | (size > 1)


def _check(h: np.ndarray, spare: int) -> np.ndarray:
    return h >> np.uint64(64 - spare) if spare else np.zeros(len(h), np.uint64)


def _grouped(h: np.ndarray, c: np.ndarray, o: np.ndarray | None = None):
    """An order by (h, c), where each pair begins in it, and both in that order. ``o``: an order by h, where there is one."""
    o = np.argsort(h) if o is None else o
    h, c = h[o], c[o]
    same, twin = h[1:] == h[:-1], c[1:] == c[:-1]
    if (same & ~twin).any():  # two windows share 64 bits
        p = np.lexsort((c, h))
        o, h, c = o[p], h[p], c[p]
        twin = c[1:] == c[:-1]
    return o, np.flatnonzero(np.concatenate(([True], ~(same & twin)))) if len(h) else np.zeros(0, np.int64), h, c


def _marked(keys: np.ndarray, bits: int, buckets: int, marks: dict) -> np.ndarray:
    hit = np.zeros(len(keys), bool)
    for p, a, b in cuts(keys, bits, buckets):
        if p in marks:
            hit[a:b] = np.unpackbits(np.frombuffer(marks[p], np.uint8), count=b - a)
    return hit


def merge_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs merged (a stable sort does that pairwise): keys, and each one's place in the runs put one after the other."""
    key = np.concatenate(runs)
    at = np.argsort(key, kind="stable")
    return key[at], at


_GRAMS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])
_CLASSES = pa.schema([*_GRAMS, ("checks", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])


def _table(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table(list(map(list, zip(*out))), schema=schema) if out else schema.empty_table()


def _send_grams(length, bits, buckets):
    def run(key, rows):
        keys, several = Chunk(rows, length).grams(bits)
        return _table([(p, key[0].as_py(), b - a, pack_sorted(keys[a:b]), np.packbits(several[a:b]).tobytes())
                       for p, a, b in cuts(keys, bits, buckets)], _GRAMS)
    return run


def _send_classes(length, bits, buckets, spare):
    def run(key, docs, marks):
        if not docs.num_rows or not marks.num_rows:
            return _CLASSES.empty_table()
        c = Chunk(docs, length)
        h, check, several = c.classes(c.candidates(bits, _by_bucket(marks, 0), buckets), spare)
        return _table([(p, key[0].as_py(), b - a, pack_sorted(h[a:b]), np.packbits(several[a:b]).tobytes(), pack(check[a:b]))
                       for p, a, b in cuts(h, 64, buckets)], _CLASSES)
    return run


def _by_bucket(marks: pa.Table, kind: int) -> dict:
    return {b: m for k, b, m in zip(*(marks.column(c).to_pylist() for c in ("kind", "bucket", "marks"))) if k == kind}


def _merge(kind):
    """Marks for each shard the keys of its run that stand in several places."""
    def run(key, rows):
        n = rows.column("n").to_pylist()
        runs = [unpack_sorted(b, m) for b, m in zip(rows.column("keys").to_pylist(), n)]
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=m) for b, m in zip(rows.column("several").to_pylist(), n)]).astype(bool)
        _, at = merge_runs(runs)
        h = np.concatenate(runs)
        if kind:
            check = np.concatenate([unpack(b, m) for b, m in zip(rows.column("checks").to_pylist(), n)])
        else:
            check = np.zeros(len(h), np.uint64)
        at, begin, _, _ = _grouped(h, check, at)
        size = np.diff(np.concatenate((begin, [len(at)])))
        hit = np.zeros(len(at), bool)
        hit[at] = np.repeat((size > 1) | np.bitwise_or.reduceat(several[at], begin), size)
        edge = np.concatenate(([0], np.cumsum(n))).tolist()
        return _table([(c, kind, key[0].as_py(), np.packbits(hit[a:b]).tobytes())
                       for c, a, b in zip(rows.column("chunk").to_pylist(), edge, edge[1:]) if hit[a:b].any()], _MARKS)
    return run


def _remove(length, bits, buckets, spare, with_bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
                       + [("kept", pa.binary())] * with_bytes)

    def run(key, docs, marks):
        if not docs.num_rows:
            return schema.empty_table()
        c = Chunk(docs, length)
        gone = np.zeros(len(c.buf) + 1, np.int32)
        found = _by_bucket(marks, 1) if marks.num_rows else {}
        if found:
            flags = c.candidates(bits, _by_bucket(marks, 0), buckets)
            blocks = list(c.prints(flags, spare))
            at, h, check = map(np.concatenate, zip(*blocks))
            o, begin, h, check = _grouped(h, check)
            hit = _marked(h[begin], 64, buckets, found)
            size = np.diff(np.concatenate((begin, [len(h)])))
            at = at[o[np.repeat(hit, size)]]  # each window once
            gone[at] += 1
            gone[at + length] -= 1
        gone = np.cumsum(gone[:-1], dtype=np.int32) > 0
        rows = []
        for t, a, b in zip(c.texts, c.first.tolist(), c.end.tolist()):
            g = gone[a:b]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if b > a else 0
            kept = c.buf[a:b][~g].tobytes() if spans else t
            rows.append((b - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[:4 + with_bytes])
        # a text with very many copies is here for the others' sake only
        out = [(i, *rows[s]) for i, s, own in zip(docs.column("doc_id").to_pylist(), c.slots, docs.column("own").to_pylist()) if own]
        return _table(out, schema)
    return run


def remove_repeats(docs: DataFrame, length: int = 200, shard_bytes: int = 4 << 20, rows_per_shard: int = 4000, with_bytes: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes covered by a string of ``length`` bytes (at least 8) that starts anywhere else too, in any text of the column.

    Returns one row per input row: doc_id, n_bytes (UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256
    (hex, of the remaining bytes), ``with_bytes`` also kept (binary: a cut may fall inside a character).
    Strings are judged on the input; overlapping occurrences in one text count; none crosses texts.

    Null text: like the empty one, nothing to remove. Ids are carried only: null ids and repeated rows count like
    any other (equal texts of ``length`` bytes or more are removed whole). Empty table: no rows. Other
    columns are ignored, whatever their names.

    ``shard_bytes`` and ``rows_per_shard`` set the unit of work; a text above a quarter of ``shard_bytes`` is a shard of its
    own, its suffixes are sorted in parts of 2 MB. Texts whose copies would fill a shard are worked on once.
    """
    if length < 8:
        raise ValueError("length must be at least 8 bytes")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, digest = F.octet_length("text").cast("long"), F.xxhash64("text")
    n, total = base.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    chunks = max(1, math.ceil(n / rows_per_shard), math.ceil(total / shard_bytes))
    buckets = max(1, math.ceil(total / SHARD))
    scale = math.ceil(math.log2(max(total, 2)))
    bits, spare = min(64, max(20, scale + 6)), max(0, min(64, 2 * scale + 20 - 64))
    # at most as many texts as there are shards: each fills one with its copies
    heavy = materialize(base.select(digest.alias("h"), size.alias("b")).groupBy("h").agg(F.count("*").alias("c"), F.sum("b").alias("b"))
                        .where((F.col("c") > 1) & ((F.col("c") > rows_per_shard) | (F.col("b") > shard_bytes))).select("h"))
    many = heavy.count()
    flag = [F.lit(1).cast("long").alias("times"), F.lit(True).alias("own")]
    work, done = base.select("*", *flag), None
    if many:
        side = F.broadcast(heavy) if many <= BROADCAST_ROWS else heavy
        marked = base.withColumn("h", digest)
        copies = marked.join(side, "h", "left_semi")
        # a text alone under its hash goes the usual way, and one too short to hold a window needs none
        one = copies.groupBy("text").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id")).select(
            "doc_id", "text", "times", ((F.col("times") == 1) & (size >= length)).alias("own"))
        work = marked.join(side, "h", "left_anti").select("doc_id", "text", *flag).unionByName(one)
        told = one.where("not own").select(F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("s"))
        whole, empty = size >= length, F.lit("").cast("binary")
        done = copies.withColumn("s", F.sha2(F.col("text").cast("binary"), 256)).join(
            F.broadcast(told) if many <= BROADCAST_ROWS else told, ["h", "s"], "left_semi").select(
            "doc_id", size.alias("n_bytes"), F.when(whole, size).otherwise(F.lit(0)).alias("n_removed"), whole.cast("long").alias("n_spans"),
            F.when(whole, F.sha2(empty, 256)).otherwise(F.col("s")).alias("kept_sha256"),
            *[F.when(whole, empty).otherwise(F.col("text").cast("binary")).alias("kept")] * with_bytes)
    deal = F.pmod(digest, F.lit(chunks))
    work = work.withColumn("chunk", F.when(4 * F.octet_length("text") > shard_bytes, chunks + digest.bitwiseAND(F.lit((1 << 61) - 1))).otherwise(deal))
    grams = work.groupBy("chunk").applyInArrow(_send_grams(length, bits, buckets), "bucket long, chunk long, n long, keys binary, several binary")
    marks = "chunk long, kind long, bucket long, marks binary"
    hits = grams.groupBy("bucket").applyInArrow(_merge(0), marks)
    classes = work.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _send_classes(length, bits, buckets, spare), "bucket long, chunk long, n long, keys binary, several binary, checks binary")
    found = classes.groupBy("bucket").applyInArrow(_merge(1), marks)
    out = work.groupBy("chunk").cogroup(hits.unionByName(found).groupBy("chunk")).applyInArrow(
        _remove(length, bits, buckets, spare, with_bytes), RESULT + ", kept binary" * with_bytes)
    return out.unionByName(done) if done is not None else out
