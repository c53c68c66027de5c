"""Helpers shared by the operators: words of a text, rolling hashes, compact blobs."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_column(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 0 by 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_groups(batches, limit: int = 4 << 20):
    """Regroup Arrow batches into lists of rows of about ``limit`` text bytes.

    Each batch has the text in its last column. Yields (columns, texts): the
    leading columns as lists, texts as bytes (null stays None).
    """
    lead, texts, size = None, [], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        lead = lead or [[] for _ in cols]
        for i, t in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())):
            for to, col in zip(lead, cols):
                to.append(col[i])
            texts.append(t := t.as_py())
            size += len(t or b"")
            if size >= limit:
                yield lead, texts
                lead, texts, size = [[] for _ in cols], [], 0
    if texts:
        yield lead, texts


def mix64(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (splitmix64), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """64-bit hashes of all words of many texts, by prefix sums over bytes."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.base = int(r.integers(1, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, x in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, x, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def _slice(self, b: np.ndarray) -> np.ndarray:
        n = len(b)
        self._powers(n + 1)
        edge = np.flatnonzero(np.diff(self.space[b].astype(np.int8), prepend=1, append=1))
        s, e = edge[::2], edge[1::2]
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[b] * self.up[:n], out=acc[1:])
        return mix64((acc[e] - acc[s]) * self.down[s])

    def words(self, text: bytes) -> np.ndarray:
        """Hash of each word of one buffer, in slices that end at white space."""
        b = np.frombuffer(text, np.uint8)
        out, at = [], 0
        while at < len(b):
            end = at + SLICE_BYTES
            if end < len(b):
                cut = np.flatnonzero(self.space[b[at:end]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    while end < len(b) and not self.space[b[end]]:
                        end += 1
            out.append(self._slice(b[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes of all texts in order, words per text)."""
        hashes, counts, group, size = [], [], [], 0

        def flush():
            if group:
                joined = b"\n".join(group)
                h = self.words(joined)
                # words per text: word starts before each text's end
                b = np.frombuffer(joined, np.uint8)
                sp = self.space[b]
                starts = np.flatnonzero(~sp & np.concatenate(([True], sp[:-1]))) if len(b) else np.zeros(0, int)
                ends = np.cumsum([len(t) + 1 for t in group])
                counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
                hashes.append(h)
                group.clear()

        for t in texts:
            if size + len(t) > SLICE_BYTES and group:
                flush()
                size = 0
            group.append(t)
            size += len(t)
        flush()
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
                np.concatenate(counts) if counts else np.zeros(0, np.int64))


def rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items of ``h``."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(np.random.default_rng(seed).integers(0, 1 << 63, width, dtype=np.uint64)):
        out += h[k:k + n] * (m * np.uint64(2) + np.uint64(1))
    return mix64(out)


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes under zstd (sorted input: pass differences)."""
    a = np.ascontiguousarray(a, "<u8")
    return pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(b, n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n), dtype=np.uint64)


def ranges(lengths) -> list[int]:
    return [0, *itertools.accumulate(lengths)]


def cuts(keys: np.ndarray, bits: int, buckets: int):
    """(bucket, from, to) of the buckets that sorted keys of ``bits`` bits fall in; buckets are equal ranges of the key space."""
    if not len(keys):
        return
    top = (keys >> np.uint64(max(0, bits - 32))).astype(np.uint64)
    bucket = (top * np.uint64(buckets)) >> np.uint64(min(bits, 32))
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)])).tolist()
    yield from zip(bucket[at[:-1]].tolist(), at[:-1], at[1:])
