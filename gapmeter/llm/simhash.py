"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit set where over half of its shingles' XXH64
hashes have it set. Equal fingerprints collapse first. Each distinct one gets its row of the pivot table,
its Hamming distances to many reference fingerprints, computed once and stored with it. Fingerprints meet in
buckets: two with at most k differing bits share at least two of
k + 2 segments, so each is dealt to one bucket per pair of segments (lossless).
Within a bucket rows of the table are compared: by the triangle inequality a pair
whose largest coordinate difference exceeds k can't link. The bucket is sorted by its first coordinate, so a block of
fingerprints is held against those within k of it only, coordinate by coordinate while pairs are left.
Survivors are verified by their bits.

A bucket with more than ``bucket_rows`` distinct fingerprints isn't compared in one task:
its members are joined exactly by shared neighbours instead (for k = 2, distance
<= 2 if and only if the balls of radius 1 meet; a ball centre has 65 members at
most). So no pairs of an unbounded group are ever made. A bucket emits links to
roots, not all pairs; components follow by label propagation.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few_tasks, materialize
from .common import text_groups
from .components import connected_components

PIVOTS = 32
#: Fingerprints of a block, pairs looked at together, and coordinates judged for all of them.
BLOCK, PAIRS, DENSE = 1024, 1 << 21, 4


def text_fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                    np.dtype("<u8"), len(words) - k + 1)
    count, block = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(h), block):
        bits = np.unpackbits(h[at:at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; with ``row`` (a string) also that."""
    names = ["doc_id", "row"][:1 + (row is not None)]
    types = [pa.int64(), pa.string()]

    def run(batches):
        for lead, texts in text_groups(batches):
            fp = np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(lead, types)], pa.array(fp)], [*names, "fp"])
    more = [] if row is None else [row.cast("string").alias("row")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, row string, fp long" if more else "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of max_bits + 2 segments of the 64 bits."""
    m = max_bits + 2
    cut = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cut)]


def _table(pivots: int) -> np.ndarray:
    """Reference fingerprints."""
    return np.random.default_rng(5).integers(0, 1 << 64, pivots, dtype=np.uint64)


def _coordinates(fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ table).astype(np.int8)


def with_coordinates(fps: DataFrame, pivots: int) -> DataFrame:
    """(fp, rep, co): the row of the pivot table next to each distinct fingerprint."""
    def run(batches):
        table = _table(pivots)
        for x in batches:
            co = _coordinates(x.column(0).to_numpy(), table)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([r.tobytes() for r in co], pa.binary())], ["fp", "rep", "co"])
    return fps.select("fp", "rep").mapInArrow(run, "fp long, rep long, co binary")


def _keyed(fps: DataFrame, max_bits: int) -> DataFrame:
    seg = _segments(max_bits)
    keys = []
    for i, ((a, wa), (b, wb)) in enumerate(itertools.combinations(seg, 2)):
        part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in ((a, wa), (b, wb))]
        keys.append(F.struct(F.lit(i).alias("part"), F.shiftleft(part[0], wb).bitwiseOR(part[1]).alias("bits")))
    more = ["co"] if "co" in fps.columns else []
    return fps.select("fp", *more, F.explode(F.array(*keys)).alias("k")).select("fp", *more, "k.part", "k.bits")


def _root(root: np.ndarray) -> np.ndarray:
    """Each one's root, all paths cut short."""
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root[:] = up


def _bucket_roots(u: np.ndarray, co: np.ndarray, max_bits: int) -> np.ndarray:
    """For the fingerprints of one bucket in order of their first coordinate: the first one that each is linked with."""
    n = len(u)
    root, wide = np.arange(n), co.T.astype(np.int16)
    first = wide[0]
    block = max(16, min(BLOCK, PAIRS // max(n, 1)))
    for a in range(0, n, block):
        b = min(a + block, n)
        stop = int(np.searchsorted(first, first[b - 1] + max_bits, side="right"))
        rows, cols = np.arange(a, b), np.arange(a, stop)
        near = cols[None, :] > rows[:, None]
        for c in wide[:DENSE]:
            near &= np.abs(c[None, a:stop] - c[a:b, None]) <= max_bits
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        for c in wide[DENSE:]:  # few pairs are left
            if not len(i):
                break
            ok = np.abs(c[i] - c[j]) <= max_bits
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(u[i] ^ u[j]) <= max_bits
        i, j = i[ok], j[ok]
        while len(i):  # only pairs that are apart yet; many meet in one step
            p, q = _root(root)[i], root[j]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
    return _root(root)


def _verify(max_bits: int, pivots: int):
    """Links within buckets: a column of fingerprint lists and, where stored, one of their coordinates."""
    def run(batches):
        table = _table(pivots)
        for batch in batches:
            a, b = [], []
            stored = batch.num_columns > 1
            for k, fps in enumerate(batch.column(0)):
                f = np.array(fps.as_py(), np.int64)
                co = np.frombuffer(b"".join(batch.column(1)[k].as_py()), np.int8).reshape(len(f), -1) if stored else _coordinates(f, table)
                o = np.lexsort((f, co[:, 0]))
                f = f[o]
                root = _bucket_roots(f.view(np.uint64), co[o], max_bits)
                linked = np.flatnonzero(root != np.arange(len(f)))
                a.append(f[linked])
                b.append(f[root[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])
    return run


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links by shared neighbours, exact for any max_bits: a ball of radius ceil(k / 2) meets one of floor(k / 2)."""
    wide, narrow = (max_bits + 1) // 2, max_bits // 2

    def masks(radius):
        return [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(64), r)]

    def ball(radius):
        signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
        return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: m.bitwiseXOR(F.col("fp")))

    near = fps.select("fp", F.explode(ball(wide)).alias("node"))
    if wide == narrow:
        return near.groupBy("node").agg(F.sort_array(F.collect_list("fp")).alias("g")).where(F.size("g") > 1) \
            .select(F.col("g")[0].alias("b"), F.explode("g").alias("a")).where("a <> b").select("a", "b")
    inner = fps.select(F.col("fp").alias("b"), F.explode(ball(narrow)).alias("node"))
    return near.join(inner, "node").where("fp > b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket_rows: int = 16_384, pivots: int = PIVOTS,
                    id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id
    (the smallest doc_id reachable over links of at most ``max_bits`` differing bits). With ``row``
    (a digest that names rows without an id) also that and ``component``, which no component has null.

    Null or empty text: fingerprint zero, linked like any other. Rows with equal id stay rows of
    their own. A null id gets a component like any row but never names one, unless all members
    are null (component_id null). Empty table: no rows. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col, row))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    keyed = _keyed(materialize(with_coordinates(distinct, pivots)), max_bits)
    size = materialize(keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    cold = keyed.join(size.where(F.col("n") <= bucket_rows), ["part", "bits"]) \
        .groupBy("part", "bits").agg(F.collect_list(F.struct("fp", "co")).alias("x")).select("x.fp", "x.co").mapInArrow(_verify(max_bits, pivots), "a long, b long")
    links = cold
    if size.where(F.col("n") > bucket_rows).limit(1).count():
        hot = keyed.join(size.where(F.col("n") > bucket_rows), ["part", "bits"]).select("fp").distinct()
        links = cold.union(_ball_links(hot, max_bits))
    label = connected_components(links)
    with few_tasks(docs.sparkSession):
        named = label.join(distinct, label["id"] == distinct["fp"])
        smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        of = materialize(distinct.join(materialize(named.select("fp", "label")), "fp", "left").join(materialize(smallest), "label", "left")
                         .select("fp", F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
                                 F.coalesce("label", "fp").alias("component")))
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                                     *([] if row is None else ["row", "component"]))
