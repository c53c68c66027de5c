"""Substring dedup by fixed-block anchors.

A window of ``window`` words always holds one whole aligned block of
``(window + 1) // 2`` words. So non-overlapping blocks are indexed, every
rolling run of block length probes the index, and only windows around a hit are
extended: windows are matched over the corpus by a 96-bit hash, and touching
matched windows merge into maximal exact repeats (``spans``).

Documents are dealt to chunks by a hash of the row, chunks bounded by rows and text bytes. A chunk sends, per hash
bucket, one compact blob of its distinct anchors (no row per word), and gets
back one bit per anchor; the same holds for the windows around hits, which come
back with the smallest doc_id they start in. Each bucket and chunk is bounded:
a frequent passage counts once per chunk. The text moves once (all three passes
read the same exchange), only anchors and candidate windows move besides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import WordHasher, cuts, pack, pack_sorted, rolling, unpack, unpack_sorted

ANCHOR_SEED, WINDOW_SEED, CHECK_SEED = 11, 12, 13
#: Up to so many groups of equal rows are broadcast.
BROADCAST_ROWS = 100_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


class Chunk:
    """Words of a chunk's documents, in (doc_id, text) order."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is not None, texts[i] or b""))
        self.order = order
        self.ids = [ids[i] for i in order]
        self.null_text = [texts[i] is None for i in order]
        self.texts = [texts[i] or b"" for i in order]
        self.hash, self.counts = WordHasher().texts(self.texts)
        self.ends = np.cumsum(self.counts)
        self.first = self.ends - self.counts

    def runs(self, width: int, seed: int):
        """(hash, document index, first word) of each run inside one document."""
        h = rolling(self.hash, width, seed)
        doc = np.repeat(np.arange(len(self.ids)), self.counts)
        at = np.flatnonzero(doc[:len(h)] == doc[width - 1:width - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
        at = at[np.array([i is not None for i in self.ids], bool)[doc[at]]] if len(at) else at
        return h[at], doc[at], at

    def anchors(self, block: int, bits: int):
        """Distinct anchors, ascending, with flags: in several documents; an aligned block."""
        h, doc, at = self.runs(block, ANCHOR_SEED)
        key = h >> np.uint64(64 - bits)
        if not len(at):
            return key, np.zeros(0, bool), np.zeros(0, bool), key, at
        x = doc.astype(np.uint64) << np.uint64(1) | ((at - self.first[doc]) % block == 0).astype(np.uint64)
        low = len(self.ids).bit_length() + 1
        if bits + low <= 64:  # one sort of packed integers does the same as a sort by two columns
            k = np.sort(key << np.uint64(low) | x)
            k, x = k >> np.uint64(low), k & np.uint64((1 << low) - 1)
        else:
            o = np.lexsort((x, key))
            k, x = key[o], x[o]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        last = np.concatenate((start[1:], [len(k)])) - 1
        is_block = np.bitwise_or.reduceat(x & np.uint64(1), start).astype(bool)
        return k[start], x[start] >> np.uint64(1) != x[last] >> np.uint64(1), is_block, key, at


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_PROBE = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                    ("several", pa.binary()), ("blocks", pa.binary())])
_HITS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("hits", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                      ("checks", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                    ("checks", pa.binary()), ("least", pa.binary())])


def _probe(block, bits, buckets):
    def run(key, rows):
        c = Chunk(rows)
        k, several, is_block, _, _ = c.anchors(block, bits)
        out = [(p, key[0].as_py(), b - a, pack_sorted(k[a:b]), np.packbits(several[a:b]).tobytes(), np.packbits(is_block[a:b]).tobytes())
               for p, a, b in cuts(k, bits, buckets)]
        return pa.table(list(map(list, zip(*out))), schema=_PROBE) if out else _empty(_PROBE)
    return run


def _bits(blobs, sizes):
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(blobs, sizes)]).astype(bool)


def _match_anchors(key, rows):
    """An anchor counts if it is an aligned block somewhere and stands in two documents."""
    n = rows.column("n").to_pylist()
    k = np.concatenate([unpack_sorted(b, m) for b, m in zip(rows.column("keys").to_pylist(), n)])
    several, block = (_bits(rows.column(c).to_pylist(), n) for c in ("several", "blocks"))
    order = np.argsort(k, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], np.diff(k[order]) != 0)))
    size = np.diff(np.concatenate((start, [len(k)])))
    good = np.bitwise_or.reduceat(block[order], start) & (np.bitwise_or.reduceat(several[order], start) | (size > 1))
    hit = np.zeros(len(k), bool)
    hit[order] = np.repeat(good, size)
    at = np.concatenate(([0], np.cumsum(n)))
    out = [(c, key[0].as_py(), m, np.packbits(hit[a:a + m]).tobytes())
           for c, m, a in zip(rows.column("chunk").to_pylist(), n, at) if hit[a:a + m].any()]
    return pa.table(list(map(list, zip(*out))), schema=_HITS) if out else _empty(_HITS)


def _around_hits(block, window, bits, buckets):
    """Windows around hit anchors: distinct (hash, check) with the least and greatest doc_id in this chunk."""
    def run(key, docs, hits):
        if not docs.num_rows or not hits.num_rows:
            return _empty(_WINDOWS)
        c = Chunk(docs)
        k, _, _, keys, at = c.anchors(block, bits)
        hit, found = np.zeros(len(k), bool), dict(zip(*(hits.column(x).to_pylist() for x in ("bucket", "hits"))))
        for p, a, b in cuts(k, bits, buckets):
            if p in found:
                hit[a:b] = np.unpackbits(np.frombuffer(found[p], np.uint8), count=b - a).astype(bool)
        good = k[hit]
        place = np.minimum(np.searchsorted(good, keys), max(len(good) - 1, 0))
        near = np.zeros(len(c.hash) + 1, np.int64)
        near[1:][at[good[place] == keys]] = 1
        near = np.cumsum(near)
        h, doc, first = c.runs(window, WINDOW_SEED)
        check = rolling(c.hash, window, CHECK_SEED)[first] >> np.uint64(32)
        take = near[first + window - block + 1] > near[first]
        h, check, doc = h[take], check[take], doc[take]
        if not len(h):
            return _empty(_WINDOWS)
        o = np.lexsort((doc, check, h))
        h, check, doc = h[o], check[o], doc[o]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
        last = np.concatenate((start[1:], [len(h)])) - 1
        ids = np.array([i or 0 for i in c.ids], np.int64)
        least, most = ids[doc[start]].view(np.uint64), ids[doc[last]].view(np.uint64)
        h, check = h[start], check[start]
        out = [(p, key[0].as_py(), b - a, pack_sorted(h[a:b]), pack(check[a:b]), pack(least[a:b]), pack(most[a:b] - least[a:b]))
               for p, a, b in cuts(h, 64, buckets)]
        return pa.table(list(map(list, zip(*out))), schema=_WINDOWS) if out else _empty(_WINDOWS)
    return run


def _match_windows(key, rows):
    """Per chunk the windows that start in a smaller document than one of the chunk's own."""
    n = rows.column("n").to_pylist()
    h, check, least, most = (np.concatenate([f(b, m) for b, m in zip(rows.column(c).to_pylist(), n)])
                             for c, f in (("keys", unpack_sorted), ("checks", unpack), ("least", unpack), ("most", unpack)))
    most = (least + most).view(np.int64)
    least = least.view(np.int64)
    o = np.lexsort((least, check, h))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(h[o]) != 0) | (np.diff(check[o]) != 0))))
    low = np.empty(len(h), np.int64)
    low[o] = np.repeat(least[o][start], np.diff(np.concatenate((start, [len(h)]))))
    found, at, out = low < most, np.concatenate(([0], np.cumsum(n))), []
    for c, m, a in zip(rows.column("chunk").to_pylist(), n, at):
        f = found[a:a + m]
        if f.any():
            out.append((c, key[0].as_py(), int(f.sum()), pack_sorted(h[a:a + m][f]), pack(check[a:a + m][f]),
                        pack(low[a:a + m][f].view(np.uint64))))
    return pa.table(list(map(list, zip(*out))), schema=_FOUND) if out else _empty(_FOUND)


def _remove(window, with_text):
    def run(key, docs, found):
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)
        others = [(n, docs.column(n)) for n in docs.column_names if n.startswith("keep_") or n == "times"]
        if not docs.num_rows:
            out = _empty(schema)
            for n, col in others:
                out = out.append_column(n, col)
            return out
        c = Chunk(docs)
        cover = np.zeros(len(c.hash) + 1, np.int64)
        if found.num_rows:
            n = found.column("n").to_pylist()
            fh, fc, fl = (np.concatenate([f(b, m) for b, m in zip(found.column(x).to_pylist(), n)])
                          for x, f in (("keys", unpack_sorted), ("checks", unpack), ("least", unpack)))
            h, doc, first = c.runs(window, WINDOW_SEED)
            check = rolling(c.hash, window, CHECK_SEED)[first] >> np.uint64(32)
            o = np.lexsort((fc, fh))
            fh, fc, fl = fh[o], fc[o], fl[o].view(np.int64)
            ids = np.array([i or 0 for i in c.ids], np.int64)[doc]
            place, gone = np.searchsorted(fh, h), np.zeros(len(h), bool)
            while True:  # a second turn only where two windows share 64 bits
                ok = place < len(fh)
                same = ok.copy()
                same[ok] = fh[place[ok]] == h[ok]
                if not same.any():
                    break
                hit = same.copy()
                hit[same] = (fc[place[same]] == check[same]) & (fl[place[same]] < ids[same])
                gone |= hit
                place = np.where(same, place + 1, len(fh))
            np.add.at(cover, first[gone], 1)
            np.subtract.at(cover, first[gone] + window, 1)
        removed = np.cumsum(cover[:-1]) > 0
        out = []
        for i, text in enumerate(c.texts):
            a, b = int(c.first[i]), int(c.ends[i])
            gone = removed[a:b]
            words, spans = text.split(), []
            if k := int(gone.sum()):
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            row = (c.ids[i], b - a, k, hashlib.sha256(kept).hexdigest(), spans)
            out.append(row + ((None if c.null_text[i] else (kept if k else text).decode(),) if with_text else ()))
        table = pa.table(list(map(list, zip(*out))), schema=schema)
        for n, col in others:
            table = table.append_column(n, col.take(pa.array(c.order)))
        return table
    return run


def substring_dedup(docs: DataFrame, window: int = 13, docs_per_chunk: int = 2000, chunk_bytes: int = 8 << 20, with_text: bool = False,
                    keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 and the
    removed maximal ``spans`` [start, end) in words; ``with_text`` adds kept_text (the
    text itself where nothing is removed), ``keep`` adds those columns of the input as keep_<name>.
    Other columns are ignored, whatever their names.

    Null text: no words (kept_text null). Null id: never removed, and no reference for others.
    Rows with one id: none of them counts as smaller than the other. Fewer words than
    ``window``: nothing is removed. Empty table: no rows.

    ``docs_per_chunk`` and ``chunk_bytes`` set the unit of work (about 1 M words): a chunk holds about as
    many rows or text bytes, whichever are fewer; a document above a quarter of ``chunk_bytes`` is a chunk
    of its own. Equal rows (text, id and kept columns) that together exceed a chunk are worked on once and
    repeated in the result: they never remove words from each other. Anchors are cut to
    log2(words) + 8 bits for the probe, which only adds candidates, never drops one.
    """
    block = (window + 1) // 2
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"keep_{c}") for c in keep or []])
    named = base.columns
    row, size = F.xxhash64(*named), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n, total = base.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    chunks = max(1, math.ceil(n / docs_per_chunk), math.ceil(total / chunk_bytes))
    bits = max(20, math.ceil(math.log2(max(n * 600, total // 6, 1))) + 8)
    # equal rows that would fill a chunk: at most as many groups as there are chunks of either kind
    heavy = materialize(base.select(row.alias("h"), size.alias("b")).groupBy("h").agg(F.count("*").alias("c"), F.sum("b").alias("b"))
                        .where((F.col("c") > 1) & ((F.col("c") > docs_per_chunk) | (F.col("b") > chunk_bytes))).select("h"))
    n_heavy = heavy.count()
    collapsed = n_heavy > 0
    if collapsed:
        marked = base.withColumn("h", row)
        side = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
        few = marked.join(side, "h", "left_anti").select(*named, F.lit(1).cast("long").alias("times"))
        many = marked.join(side, "h", "left_semi").groupBy(*named).agg(F.count("*").alias("times"))
        base = few.unionByName(many)
    deal = F.pmod(row, F.lit(chunks))
    # a long document is a chunk of its own, numbered above the others
    base = base.withColumn("chunk", F.when(4 * size > chunk_bytes, chunks + row.bitwiseAND(F.lit((1 << 61) - 1))).otherwise(deal))
    by_chunk = base.groupBy("chunk")
    # the wide exchange of ``base`` by chunk is planned once and reused by the three passes
    probes = by_chunk.applyInArrow(_probe(block, bits, chunks), "bucket long, chunk long, n long, keys binary, several binary, blocks binary")
    hits = probes.groupBy("bucket").applyInArrow(_match_anchors, "chunk long, bucket long, n long, hits binary")
    windows = base.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _around_hits(block, window, bits, chunks),
        "bucket long, chunk long, n long, keys binary, checks binary, least binary, most binary")
    found = windows.groupBy("bucket").applyInArrow(_match_windows, "chunk long, bucket long, n long, keys binary, checks binary, least binary")
    schema = StructType.fromDDL(RESULT + ", kept_text string" * with_text)
    for f in base.schema:
        if f.name.startswith("keep_") or f.name == "times":
            schema.add(f.name, f.dataType)
    out = base.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove(window, with_text), schema)
    if collapsed:
        out = out.select(*[c for c in out.columns if c != "times"], F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("times")).drop("times")
    return out
