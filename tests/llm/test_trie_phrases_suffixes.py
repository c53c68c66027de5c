"""Conversation trie, collocations and suffix-array dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- op11 ----------------------------------------------------------------

def _conversations(rng):
    talk = {}
    common = [("u", "same first turn"), ("b", "answer"), ("u", "and so on")]
    for c in [*range(100, 140), *range(200, 230), 300, 301, -5, -105, 1000]:
        own = common[:rng.randrange(4)] + [(rng.choice("ub"), rng.choice(["x", "y", "é日本", ""])) for _ in range(rng.randrange(5))]
        talk[c] = own
    for c in (400, 401, 407, 409):  # long ones: several blocks, shared far down
        talk[c] = [("u", f"t{i}") for i in range(150)] + [("b", str(c % 3))] * (c % 5)
    for c in range(500, 520):
        talk[c] = common
    return {c: t for c, t in talk.items() if t}


def _trie(talk):
    rebuilt = {}
    for c, own in talk.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = c - int(np.fmod(c, 100))
        rebuilt[c] = talk.get(root, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, depth string, items string, a string"


def test_conversation_trie(spark):
    from gapmeter.llm import trie
    talk = _conversations(random.Random(4))
    rows = [(c, i, r, t, "clash", "clash", "clash") for c, ts in talk.items() for i, (r, t) in enumerate(ts)]
    rows += [(None, 0, "u", "no conversation", "", "", ""), (600, None, None, "first", "", "", ""), (600, 0, "u", None, "", "", ""), (601, 0, "u", "tie b", "", "", ""),
             (601, 0, "u", "tie a", "", "", ""), (601, 0, "b", "z", "", "", ""), (601, 1, "u", "twice", "", "", ""), (601, 1, "u", "twice", "", "", "")]
    talk[600], talk[601] = [("", "first"), ("u", "")], [("b", "z"), ("u", "tie a"), ("u", "tie b"), ("u", "twice"), ("u", "twice")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = trie.prefix_trie(df)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == cols
    assert Counter(tuple(r) for r in got.collect()) == _trie(talk)
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_conversation_trie_small_shards(spark):
    """Shards of a few blocks: nearly every node is open and has to be merged."""
    from gapmeter.llm import trie
    talk = _conversations(random.Random(9))
    df = spark.createDataFrame([(c, i, r, t, "", "", "") for c, ts in talk.items() for i, (r, t) in enumerate(ts)], TURNS)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert Counter(tuple(r) for r in trie.prefix_trie(df).collect()) == _trie(talk)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_one_conversation_of_a_third_of_all_turns_is_spread(spark):
    from gapmeter.llm import trie
    talk = {c: [("u", f"{c} {i}") for i in range(4)] for c in range(1000, 1500)} | {700: [("u", f"long {i}") for i in range(1000)]}
    rows = [(c, i, r, t, "", "", "") for c, ts in talk.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = trie.numbered(df, "conv_id", "turn", "role", "text").withColumn("task", F.spark_partition_id())
        assert Counter((r.conv_id, r.pos) for r in numbered.collect()) == Counter((c, i + 1) for c, ts in talk.items() for i in range(len(ts)))
        per_task = [r.n for r in numbered.groupBy("task").agg(F.count("*").alias("n")).collect()]
        assert max(per_task) < 1600 and numbered.where("conv_id = 700").select("task").distinct().count() > 1
        assert Counter(tuple(r) for r in trie.prefix_trie(df).collect()) == _trie(talk)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ternary_tree_is_balanced():
    from gapmeter.llm.trie import TernaryTree, medians
    tree, n = TernaryTree(), 1000
    last = [tree.insert([i, 7], i) for i in medians(n)]
    assert len(set(last)) == n == len(tree.code) // 2 and sorted(medians(n)) == list(range(n))

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.less[at]), height(tree.more[at]))
    assert height(tree.top) == 10


# --- op12 ----------------------------------------------------------------

def _phrases(rows, least, top):
    size, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    dropped = {(g, p[i:i + m]) for (g, p), a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[g, p[i:i + m]]}
    for lang in {g for g, _ in cand}:
        best = []
        for (g, p), a in cand.items():
            if g == lang and (g, p) not in dropped:
                score, k = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, size[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return Counter(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("share", [2, 10**9])
def test_collocations(spark, edge_docs, edge_rows, no_docs, share):
    """Also where the sample is empty: then every frequent phrase is a failure of the sample."""
    from gapmeter.llm import collocations as m
    got = m.collocations(edge_docs, least=5, top=300, sample_share=share)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == _phrases([(r[1], r[2]) for r in edge_rows], 5, 300)
    assert m.collocations(no_docs).collect() == []


def test_collocations_case_breaks_ties_and_bits(spark):
    """Letters outside A-Z keep their case, pieces end at breaks, ranks go by count and bytes; few places let more in, nothing else."""
    from gapmeter.llm import collocations as m
    rng = random.Random(6)
    words = ["New", "new", "York", "ÉCOLE", "école", "x\x1cy", "日本", "a", "b", "c", "d"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "\t", "  ", ". ", "\n", "? ", "\x0b"]) for _ in range(60)), rng.choice(["en", None, "und", "fr"])) for _ in range(150)]
    rows += [("new york city hall " * 40, "en"), (None, "en"), ("", None), ("q w", "rare")]
    df = spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], "text string, lang string, doc_id long")
    want = _phrases(rows, 4, 50)
    assert Counter(tuple(r) for r in m.collocations(df, least=4, top=50).collect()) == want
    assert Counter(tuple(r) for r in m.collocations(df, least=4, top=50, most_bits=1 << 10).collect()) == want


def test_collocations_of_long_texts_in_parts(spark, monkeypatch):
    from gapmeter.llm import collocations as m
    rng = random.Random(8)
    rows = [("".join(rng.choice(["a", "bb", "ccc"]) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(4000)), "en"), ("w " * 5000, "en"), ("k l. " * 30, "en")]
    monkeypatch.setattr(m, "TEXT_BYTES", 1000)
    df = spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], "text string, lang string, doc_id long")
    assert Counter(tuple(r) for r in m.collocations(df, least=30).collect()) == _phrases(rows, 30, 2000)


def test_collocation_scores_pass_64_bits(spark):
    from gapmeter.llm import collocations as m
    big = 5 * 10**13
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a", 3 * big), ("en", "b", big), ("en", None, 9 * big)], "lang string, phrase string, n long")
    assert [tuple(r) for r in m._ranked(counts, 30, 10, 80).collect()] == [("en", 1, "a b", big, 3 * big, big, 9 * big, 500000)]


# --- op13 ----------------------------------------------------------------

def _without_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length if k + length < len(gone) else -1] -= 1
        g = np.cumsum(gone[:-1]) > 0
        spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if len(t) else 0
        out.append((i, len(t), int(g.sum()), spans, sha(np.frombuffer(t, np.uint8)[~g].tobytes())))
    return Counter(out)


@pytest.mark.parametrize("shard", [3000, 4 << 20])
def test_remove_repeats(spark, edge_docs, edge_rows, no_docs, shard):
    from gapmeter.llm import suffix
    got = suffix.remove_repeats(edge_docs, shard_bytes=shard)
    assert Counter(tuple(r) for r in got.collect()) == _without_repeats([r[:2] for r in edge_rows], 200)
    assert suffix.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("length", [8, 40])
def test_remove_repeats_periods_zero_bytes_and_hot_copies(spark, length):
    """Overlapping repeats in one text, zero bytes, texts whose copies fill shards, long texts in parts."""
    from gapmeter.llm import suffix
    rng = random.Random(length)
    pick = lambda n: "".join(rng.choice("abcdeé\x00") for _ in range(n))
    shared = [pick(length), pick(3 * length), pick(length - 1)]
    rows = [(i, pick(rng.randrange(90)) + rng.choice(shared) + pick(rng.randrange(60))) for i in range(80)]
    rows += [(i, "ab" * k) for i, k in ((100, length // 2), (101, length // 2 + 1), (102, 400))] + [(103, "z" * (length + 1)), (104, "\x00" * 300), (105, pick(9000)), (None, pick(50)), (1, None)]
    rows += [(200 + i, "many copies of one text " * 5) for i in range(400)] + [(None, "short")] * 300
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, times string, own string").repartition(3)
    got = suffix.remove_repeats(df, length=length, shard_bytes=2000, rows_per_shard=100, with_bytes=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == _without_repeats(rows, length)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_suffix_order_and_common_prefixes():
    from gapmeter.llm.suffix import common_prefixes, merge_runs, suffix_order
    rng = np.random.default_rng(2)
    for text in (rng.integers(97, 99, 3000, dtype=np.uint8), np.full(1200, 97, np.uint8), np.tile(rng.integers(0, 3, 700, dtype=np.uint8), 3), np.zeros(1, np.uint8), np.zeros(40, np.uint8),
                 np.array([5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0, 0, 0, 0], np.uint8)):
        raw = text.tobytes()
        order = suffix_order(text)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want
        shared = [0] + [next((k for k in range(50) if raw[a + k:a + k + 1] != raw[b + k:b + k + 1] or b + k >= len(raw) or a + k >= len(raw)), 50) for a, b in zip(want, want[1:])]
        assert common_prefixes(text, order, 50).tolist() == shared
    runs = [np.sort(rng.integers(0, 50, n).astype(np.uint64)) for n in (5, 0, 17, 30, 1)]
    key, at = merge_runs(runs)
    joined = np.concatenate(runs)
    assert key.tolist() == sorted(joined.tolist()) and (joined[at] == key).all() and sorted(at.tolist()) == list(range(len(joined)))


def test_text_moves_once(spark, edge_docs):
    from gapmeter.llm import suffix
    out = suffix.remove_repeats(edge_docs, shard_bytes=3000)
    out.collect()
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def test_a_chunk_visits_only_the_buckets_it_has():
    """Work follows the keys of a chunk, not the number of chunks there are; buckets are the same wherever keys are cut."""
    from gapmeter.llm.common import cuts
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 40, dtype=np.uint64))
    for buckets in (1, 7, 1000, 10**7):
        for bits in (64, 40, 20):
            k = keys >> np.uint64(64 - bits)
            got = list(cuts(k, bits, buckets))
            assert len(got) <= min(40, buckets) and got[0][1] == 0 and got[-1][2] == 40 and all(x[2] == y[1] and x[0] < y[0] < buckets for x, y in zip(got, got[1:]))
            alone = {p for x in k for p, _, _ in cuts(np.array([x]), bits, buckets)}
            assert alone == {p for p, _, _ in got}
    assert list(cuts(keys[:0], 64, 5)) == []


def test_hashes_least_and_words_of_long_buffers():
    """A buffer of any length is hashed in slices that fit a cache; a run's hash does not depend on where it stands."""
    from gapmeter.llm.suffix import SLICE, ByteHasher, sliding_least, words_at
    rng = np.random.default_rng(5)
    b = rng.integers(0, 256, 2 * SLICE + 700, dtype=np.uint8)
    for width in (8, 200):
        hashes = ByteHasher(width, 22)
        got = hashes(b)
        assert len(got) == len(b) - width + 1 and len(np.unique(got)) == len(got)
        for k in (0, 1, SLICE - width, SLICE - 1, SLICE, 2 * SLICE, len(got) - 1):
            assert hashes(b[k:k + width])[0] == got[k]
        assert len(hashes(b[:width - 1])) == 0
    x = rng.integers(0, 50, 400).astype(np.uint64)
    for width in (1, 2, 3, 64, 100, 169, 400):
        assert sliding_least(x, width).tolist() == [min(x[k:k + width].tolist()) for k in range(len(x) - width + 1)]
    raw = bytes([0, 255, 1, 0, 0, 7, 200, 128, 0, 0, 3])
    assert words_at(np.frombuffer(raw, np.uint8)).tolist() == [int.from_bytes(raw[k:k + 8].ljust(8, b"\x00"), "big") for k in range(len(raw))]
    assert len(words_at(np.zeros(0, np.uint8))) == 0


def test_hashing_follows_bytes_not_pieces(monkeypatch):
    """Many short repeated passages are hashed together, not one by one (CPU seconds of the last step)."""
    import pyarrow as pa

    from gapmeter.llm import suffix
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = pick(60)
    texts = [pick(80) + shared + pick(80) for _ in range(200)]
    chunk = suffix.Chunk(pa.table({"text": texts, "times": [1] * len(texts)}), 40)
    flags = np.zeros(len(chunk.buf), bool)
    for a in chunk.first:
        flags[a + 80:a + 80 + 21] = True
    assert len(list(chunk.pieces(flags))) == len(texts)
    calls, plain = [], suffix.ByteHasher.__call__
    monkeypatch.setattr(suffix.ByteHasher, "__call__", lambda self, b: calls.append(len(b)) or plain(self, b))
    at, h, check = map(np.concatenate, zip(*chunk.prints(flags, 20)))
    assert len(calls) == 2 and at.tolist() == np.flatnonzero(flags).tolist()
    assert len({*zip(h.tolist(), check.tolist())}) == len({chunk.buf[k:k + 40].tobytes() for k in at}) == 21
    found, _, several = chunk.classes(flags, 20)
    assert found.tolist() == sorted(set(h.tolist())) and several.all()
