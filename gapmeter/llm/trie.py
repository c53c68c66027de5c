"""Prefix trie of conversations: which prefixes of turns are shared, by how many, and what sharing saves.

A turn is named by 120 bits of the SHA-256 of its role and text, a trie node by the exclusive or of 128 hashed
bits per (turn, depth) on its path: a path's name can be had from any cut of it, so no conversation has to be in one task.

1. Turns are numbered by a range exchange: counts per range give offsets, so one conversation may spread over many tasks.
2. Sequences are cut into blocks of BLOCK turns, a later block hanging from the node its conversation has reached. Equal
   blocks below one node become one row with a count, so copies weigh nothing.
3. Blocks are sorted by range. Each batch of a range is a shard: its turns get dictionary codes, and its blocks go into a
   ternary search tree, medians first, so the trees of siblings are balanced. A bottom-up walk in reverse order of
   insertion adds up members, leaves and savings.
4. A node is closed if all of its subtree lies in the shard. Only open nodes (on a shard's first and last path,
   and above deeper blocks) are merged over shards; their subtree sums follow by doubling: in round k each node adds
   what its descendants 2^k below have gathered, so there are log2(depth) rounds.
5. Digests of the members that end at a node are taken over sorted runs of ids, which are joined as text in many tasks
   and only hashed one after the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few_tasks, materialize

BLOCK = 64
HEAD = 5  # most turns that are taken over
ID = ["a", "b"]
NODE = "a long, b long, depth long, up_a long, up_b long, n_convs long, least long, n_children long, n_leaves long, saved long, chars long, up_least long, closed boolean"


def numbered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, da, db, chars) of each turn; pos from 1, by (turn, role, text), null turn first.

    Role and text are compared by their first 32 characters, then by digest, so that keys stay short.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    base = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.substring(role, 1, 32).alias("r"),
        F.substring(text, 1, 32).alias("t"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    base = base.select("conv_id", "turn", "r", "t", part(1).alias("da"), part(16).alias("db"), "chars", F.rand(7).alias("salt"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "r", "t", "da", "db"]

    def number(batches):
        p, last, count = TaskContext.get().partitionId(), None, 0
        for x in batches:
            ids = x.column(0).to_numpy()
            if not len(ids):
                continue
            start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            k = np.arange(1, len(ids) + 1) - np.repeat(start, np.diff(np.concatenate((start, [len(ids)]))))
            if ids[0] == last:
                k[:start[1] if len(start) > 1 else None] += count
            last, count = ids[-1], int(k[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), p)), x.column(0), pa.array(k), *x.columns[1:]], ["p", "conv_id", "k", "da", "db", "chars"])

    # equal rows may be many: the salt deals them out, their order among themselves makes no difference
    out = materialize(base.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys).select("conv_id", "da", "db", "chars").mapInArrow(
        number, "p long, conv_id long, k long, da long, db long, chars long"))
    # one row per range: a conversation goes on in the next range if it is the last here and the first there
    edges = out.groupBy("p").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "k")).alias("last")).orderBy("p").collect()
    offsets, conv, so_far = [], None, 0
    for e in edges:
        if e["first"] == conv:
            offsets.append((e["p"], conv, so_far))
        so_far = e["last"]["k"] + (so_far if e["first"] == conv == e["last"]["conv_id"] else 0)
        conv = e["last"]["conv_id"]
    if offsets:
        offsets = out.sparkSession.createDataFrame(offsets, "p long, conv_id long, before long")
        out = out.join(F.broadcast(offsets), ["p", "conv_id"], "left")
    else:
        out = out.withColumn("before", F.lit(0))
    return out.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "da", "db", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Blocks of the rebuilt conversations: conv_id, block, last_block, items, xa, xb (the block's part of the node's name).

    The first h = crc32(conv_id) % 6 turns come from conversation c - c % 100, the rest are own turns after the first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    item = F.struct("pos", "da", "db", "chars")
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("conv_id").alias("root")).agg(
        F.sort_array(F.collect_list(item)).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumn("root", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    info = convs.join(heads, "root", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h").cast("int")).alias("head"), "n_own")
    info = info.withColumn("taken", F.size("head").cast("long"))
    total = F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    info = info.withColumn("last_block", F.greatest(F.lit(0), F.floor((total - 1) / BLOCK))).drop("n_own")
    own = turns.join(info.select("conv_id", "h", "taken", "last_block"), "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", "last_block", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "da", "db", "chars")
    head = info.select("conv_id", "last_block", F.explode("head").alias("x")).select(
        "conv_id", "last_block", F.col("x.pos").alias("depth"), "x.da", "x.db", "x.chars")
    mark = info.select("conv_id", "last_block", *[F.lit(None).cast("long").alias(c) for c in ("depth", "da", "db", "chars")])
    all_ = own.unionByName(head).unionByName(mark)
    a, b = F.xxhash64("da", "db", "depth"), F.xxhash64("depth", "db", "da", F.lit(1))
    all_ = all_.withColumn("a", F.when(F.col("depth").isNotNull(), a)).withColumn("b", F.when(F.col("depth").isNotNull(), b))
    block = F.coalesce(F.floor((F.col("depth") - 1) / BLOCK), F.lit(0))
    one = F.when(F.col("depth").isNotNull(), F.struct("depth", "da", "db", "a", "b", "chars"))
    # turns of one conversation and block: at most BLOCK, and the mark
    return all_.groupBy("conv_id", block.alias("block")).agg(
        F.max("last_block").alias("last_block"), F.sort_array(F.collect_list(one)).alias("items"),
        F.coalesce(F.bit_xor("a"), F.lit(0)).alias("xa"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("xb"))


def _prefixes(deep: DataFrame) -> DataFrame:
    """Blocks of long conversations with ``pa``, ``pb``: the name of the node they hang from."""
    deep = deep.withColumn("part", F.floor(F.col("block") / 1024))
    zero = F.lit(0).cast("long")
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = rows(Window.partitionBy("conv_id", "part").orderBy("block"))
    far = rows(Window.partitionBy("conv_id").orderBy("part"))
    parts = deep.groupBy("conv_id", "part").agg(F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"))
    parts = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(far), zero).alias(f"f{c}") for c in ("sa", "sb")])
    near_by = deep.select("*", *[F.coalesce(F.bit_xor(f"x{c}").over(near), zero).alias(f"n{c}") for c in ID])
    return near_by.join(parts, ["conv_id", "part"]).select(
        "conv_id", "block", "last_block", "items", F.col("na").bitwiseXOR(F.col("fsa")).alias("pa"), F.col("nb").bitwiseXOR(F.col("fsb")).alias("pb"))


class TernaryTree:
    """Sequences of codes; each node stands for a path. Children of a node form a binary search tree."""

    def __init__(self):
        self.code, self.less, self.down, self.more, self.up, self.made_by = [], [], [], [], [], []
        self.top = -1

    def _new(self, code: int, up: int, by) -> int:
        for a, v in ((self.code, code), (self.less, -1), (self.down, -1), (self.more, -1), (self.up, up), (self.made_by, by)):
            a.append(v)
        return len(self.code) - 1

    def insert(self, codes: list[int], name) -> int:
        """Last node of the path; ``name`` and the position are kept with each node that is new."""
        code, less, down, more = self.code, self.less, self.down, self.more
        up = -1
        for i, c in enumerate(codes):
            at = self.top if up < 0 else down[up]
            if at < 0:
                at = self._new(c, up, (name, i))
                if up < 0:
                    self.top = at
                else:
                    down[up] = at
            else:
                while c != code[at]:
                    side = less if c < code[at] else more
                    if side[at] < 0:
                        side[at] = self._new(c, up, (name, i))
                    at = side[at]
            up = at
        return up


def medians(n: int):
    """0 .. n - 1, middles of ranges first."""
    todo = [(0, n)]
    for a, b in todo:
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(a, m), (m + 1, b)]


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Dictionary codes of rows of some columns, in their order."""
    n = len(columns[0])
    o = np.lexsort(columns[::-1])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[o][1:] != c[o][:-1]
    out = np.empty(n, np.int64)
    out[o] = np.cumsum(new)
    return out


def _shard(x: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of one batch of sorted blocks, closed and open."""
    col = {n: x.column(n) for n in x.schema.names}
    block, pa_, pb_ = (col[c].to_numpy() for c in ("block", "pa", "pb"))
    n_convs, least, going = (col[c].to_pylist() for c in ("n_convs", "least", "going"))
    size = col["items"].value_lengths().to_numpy()
    edge = np.concatenate(([0], np.cumsum(size)))
    f = dict(zip(("depth", "da", "db", "a", "b", "chars"), col["items"].flatten().flatten()))
    turn = _codes(f["da"].to_numpy(), f["db"].to_numpy()).tolist() if edge[-1] else []
    root = _codes(block, pa_, pb_).tolist()
    tree = TernaryTree()
    last = [0] * len(root)
    edges = edge.tolist()
    for i in medians(len(root)):
        last[i] = tree.insert([root[i], *turn[edges[i]:edges[i + 1]]], i)
    n = len(tree.code)
    up = tree.up
    # names of nodes: exclusive or along the path (position 0 is the node that the block hangs from)
    row, place = (np.array(v, np.int64) for v in zip(*tree.made_by))
    item = edge[row] + place - 1
    inner = place > 0
    name = []
    for start, c in ((pa_, "a"), (pb_, "b")):
        own = np.where(inner, f[c].to_numpy()[np.where(inner, item, 0)], start[row]) if edge[-1] else start[row]
        own = own.tolist()
        for i in range(n):
            if up[i] >= 0:
                own[i] ^= own[up[i]]
        name.append(own)
    chars = np.where(inner, f["chars"].to_numpy()[np.where(inner, item, 0)], 0).tolist() if edge[-1] else [0] * n
    depth = (block[row] * BLOCK + place).tolist()
    count, low, on, is_open = [0] * n, [None] * n, [0] * n, [False] * n
    for i, at in enumerate(last):
        count[at] += n_convs[i]
        low[at] = least[i] if low[at] is None else min(low[at], least[i])
        on[at] += going[i]
    for at in (last[0], last[-1]):
        is_open[at] = True
    kids, leaves, saved = [0] * n, [0] * n, [0] * n
    out = []
    for i in range(n - 1, -1, -1):  # children were inserted after their parent
        u, top = up[i], up[i] < 0
        is_open[i] = is_open[i] or top or on[i] > 0
        if not top:
            count[u] += count[i]
            low[u] = low[i] if low[u] is None else min(low[u], low[i])
            is_open[u] = is_open[u] or is_open[i]
        if not is_open[i]:
            leaves[i] += not kids[i]
            saved[i] += (count[i] - 1) * chars[i]
            kids[u] += 1
            leaves[u] += leaves[i]
            saved[u] += saved[i]
    for i in range(n):
        u = up[i]
        hangs = u < 0 and depth[i] > 0  # counted where it is the last node of the block above
        out.append((name[0][i], name[1][i], depth[i], name[0][u] if u >= 0 else None, name[1][u] if u >= 0 else None,
                    0 if hangs else count[i], None if hangs else low[i], kids[i], leaves[i], saved[i], chars[i],
                    low[u] if u >= 0 and not is_open[u] else None, not is_open[i]))
    names = [c.split()[0] for c in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if c == "closed" else pa.int64()) for c, v in zip(names, zip(*out))], names)


def _shards(batches):
    for x in batches:
        if x.num_rows:
            yield _shard(x)


def _open_totals(nodes: DataFrame) -> DataFrame:
    """Open nodes merged over shards, with sums over their whole subtrees."""
    merged = materialize(nodes.where("not closed").groupBy(*ID).agg(
        F.max("depth").alias("depth"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars")))
    kids = merged.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("open_children"))
    nodes = materialize(merged.join(kids, ID, "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("open_children")
                        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                        .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")))
    sums = nodes.select(*ID, F.col("up_a").alias("j_a"), F.col("up_b").alias("j_b"), "n_leaves", "saved")
    reach, deepest = 1, nodes.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        below = sums.where("j_a is not null").groupBy(F.col("j_a").alias("a"), F.col("j_b").alias("b")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = sums.select(F.col("a").alias("j_a"), F.col("b").alias("j_b"), F.col("j_a").alias("k_a"), F.col("j_b").alias("k_b"))
        sums = materialize(sums.join(below, ID, "left").join(jump, ["j_a", "j_b"], "left").select(
            *ID, F.col("k_a").alias("j_a"), F.col("k_b").alias("j_b"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        reach *= 2
    return nodes.drop("n_leaves", "saved").join(sums.select(*ID, "n_leaves", "saved"), ID)


def _runs(batches):
    """Sorted (a, b, conv_id) rows: the ids of each run joined by commas."""
    for x in batches:
        if not x.num_rows:
            continue
        a, b, ids = (c.to_numpy() for c in x.columns)
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        edge = [*start.tolist(), len(a)]
        text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(edge, edge[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(ids[start]), pa.array(text)], ["a", "b", "first", "ids"])


def _digests(batches):
    """Runs in order: one digest per node, carried from batch to batch."""
    node, state = None, None
    for x in batches:
        out = []
        for a, b, ids in zip(*(x.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _digest_batch(out)
    if node:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows):
    a, b, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d)], ["a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations, one row each: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (digest of the comma-joined ids of members with exactly ``depth`` turns).

    Turns are ordered by (turn, role, text), null turn first (role and text by their first 32 characters, then by digest);
    repeated turn rows stay turns; null role or text counts as empty. Rows without conversation id belong to no
    conversation and are left out. c % 100 has the sign of c. Empty table: no rows (there is no member, so no root). Other
    columns are ignored, whatever their names.
    """
    blocks = materialize(rebuilt(materialize(numbered(turns, id_col, turn_col, role_col, text_col))))
    zero = F.lit(0).cast("long")
    flat, deep = blocks.where("last_block = 0"), blocks.where("last_block > 0")
    ends = flat.select(F.col("xa").alias("a"), F.col("xb").alias("b"), "conv_id")
    work = flat.select("conv_id", "block", "last_block", "items", zero.alias("pa"), zero.alias("pb"))
    if deep.limit(1).count():
        ends = ends.unionByName(deep.groupBy("conv_id").agg(F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b")).select("a", "b", "conv_id"))
        work = work.unionByName(_prefixes(deep))
    keys = ["block", "pa", "pb", "items"]
    distinct = work.groupBy(*keys).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"),
                                       F.sum((F.col("last_block") > F.col("block")).cast("long")).alias("going"))
    nodes = materialize(distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_shards, NODE))
    with few_tasks(turns.sparkSession):
        opened = materialize(_open_totals(nodes))
    digests = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_runs, "a long, b long, first long, ids string")
    digests = digests.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")
    cols = [*ID, "depth", "up_a", "up_b", "n_convs", "least", "n_children", "n_leaves", "saved"]
    all_ = nodes.where("closed").select(*cols, "up_least").unionByName(opened.select(*cols, F.lit(None).cast("long").alias("up_least")))
    parents = opened.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("least").alias("open_least"))
    return all_.join(parents, ["up_a", "up_b"], "left").join(digests, ID, "left").select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("up_least", "open_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
