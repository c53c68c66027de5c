"""Each operator against a brute-force version, on edge rows and on the small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

W = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(t):
    return W.findall(t or "")


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# --- op1 -----------------------------------------------------------------

PAGES = "page_id long, url string, html string, segment string, payload string"


def _pages(spark):
    big, same = "é" * 700_000 + "\r\n\r\nWARC/1.1\r\n", "<p>" + "copy " * 40
    rows = [(1, "u", big), (2, "a\r\nb", None), (3, None, ""), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", same), (9, "u", same), (7, "u", same),
            (None, "u", same), (8, "u", big), (6, "u", same), (None, None, "only null " * 20), (None, None, "only null " * 20), (11, "u", "x" * 100), (10, "u", "x" * 100)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES), rows


def _warc(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= 100 else None
        revisit = f is not None and f != i
        out.append((i, len(b), sha(b), "revisit" if revisit else "response", f if revisit else None))
    return Counter(out)


def test_warc_round_trip(spark):
    from gapmeter.llm import warc
    df, rows = _pages(spark)
    assert multiset(warc.round_trip(df, chunk_bytes=1 << 16).collect()) == _warc(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_segments_hold_the_payload(spark, tmp_path):
    from gapmeter.llm import warc
    df, rows = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(df), path, chunk_bytes=1 << 16)
    got = defaultdict(list)
    for r in warc.read_chunks(spark, path).where("page_id in (1, 4)").collect():
        got[r.page_id].append((r.segment, bytes(r.block), r.digest_so_far, r.last))
    parts = sorted(got[1])
    assert len(parts) == math.ceil(len(rows[0][2].encode()) / (1 << 16))
    assert b"".join(p[1] for p in parts) == rows[0][2].encode()
    so_far = hashlib.sha256()
    for _, block, digest, _ in parts:
        so_far.update(block)
        assert digest == so_far.hexdigest() and len(block) <= 1 << 16
    assert [p[3] for p in parts] == [False] * (len(parts) - 1) + [True]


# --- op2 -----------------------------------------------------------------

def _entropy_level(w):
    return round((6 - sum(v * math.log2(v) for v in Counter(w).values()) / 64) * 1000 / 6)


def _features(t, rank):
    """Positions with 16 votes or more; neighbourhoods end with the text."""
    n = len(t) - 63
    r = [rank[_entropy_level(t[i:i + 64])] for i in range(n)]
    votes = Counter()
    for i in range(n):
        if r[i] >= 0:
            votes[min((r[j], j) for j in range(i, min(n, i + 64)) if r[j] >= 0)[1]] += 1
    return sorted(p for p, v in votes.items() if v >= 16)


def test_improbable_features_and_pairs(spark, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import improbable as m
    counts = m.level_counts(edge_docs)
    brute = Counter()
    for r in edge_rows:
        t = (r[1] or "").encode()
        if len(t) < 20_000:
            brute.update(_entropy_level(t[i:i + 64]) for i in range(len(t) - 63))
    short = m.level_counts(edge_docs.where("text is null or octet_length(text) < 20000"))
    assert {k: v for k, v in enumerate(short.tolist()) if v} == dict(brute)
    rank = m.ranks(counts)
    digest = m.Digest(rank)
    for r in edge_rows[7:30]:
        t = r[1].encode()
        if len(t) >= 64:
            assert digest.make([b"other text", t])[1][0] == max(1, len({t[p:p + 64] for p in _features(t, rank)}))
    got = m.compare_edited(edge_docs).collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        own, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(own) // 2
        want.append((r[0], len(own), sha(own[:len(own) - half] + nxt[:half])))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[70] <= prints[edge_rows[12][0]]  # equal texts, equal fingerprints
    assert m.likeness(digest.make([b"a" * 500])[0], digest.make([b"a" * 500])[0]) == 1.0
    assert m.compare_edited(no_docs).collect() == []


def test_improbable_likeness_separates(spark, sf):
    from gapmeter.llm import improbable as m
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = m.compare_edited(docs).where("n_chars > 500").toPandas()
    assert got.near_edited.median() > 0.35 and got.near_next.median() < 0.1


# --- op3 -----------------------------------------------------------------

def _dedup(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("per_chunk", [7, 2000])
def test_substring_dedup(spark, edge_docs, edge_rows, no_docs, per_chunk):
    from gapmeter.llm import anchors
    got = anchors.substring_dedup(edge_docs, docs_per_chunk=per_chunk)
    assert multiset(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == _dedup(edge_rows)
    assert anchors.substring_dedup(no_docs).collect() == []


def test_substring_dedup_small_table(spark, sf):
    from gapmeter.llm import queries
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert multiset(got) == _dedup(docs)


def test_substring_dedup_bounds_the_work_of_a_chunk(spark, tmp_path):
    """Repeats of one row and long documents: no chunk, and so no task, holds much more than its share of rows or bytes."""
    from gapmeter.llm import anchors
    import random
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + passage) for i in range(120)]
    rows += [(7, rows[3][1])] * 150 + [(None, rows[4][1])] * 150 + [(200 + i, " ".join(f"l{rng.randrange(10**6)}" for _ in range(4000))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    class Spy(anchors.Chunk):
        def __init__(self, table):
            super().__init__(table)
            with open(log, "a") as f:
                f.write(f"{len(self.ids)} {sum(map(len, self.texts))}\n")

    log = tmp_path / "chunks"
    real, anchors.Chunk = anchors.Chunk, Spy
    try:
        got = anchors.substring_dedup(df, docs_per_chunk=40, chunk_bytes=20_000, with_text=True, keep=["text"])
        assert multiset(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == _dedup(rows)
        assert Counter((r.doc_id, r.keep_text) for r in got.collect()) == Counter(rows)
    finally:
        anchors.Chunk = real
    with open(log) as f:
        seen = [tuple(map(int, x.split())) for x in f]
    long = max(len(t) for _, t in rows)
    assert seen and all(n < 80 and (b < 60_000 or (n == 1 and b <= long)) for n, b in seen)


def test_substring_dedup_reuses_the_text_exchange(spark, edge_docs):
    from gapmeter.llm import anchors
    out = anchors.substring_dedup(edge_docs, docs_per_chunk=7)
    out.collect()
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


# --- op4 -----------------------------------------------------------------

def test_language_id(spark, sf, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import langid, queries
    from gapmeter.llm.common import held_out_column
    got = queries.op4_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in m.doc_id]).all()
    held = m[m.held_out & m.lang.notna()]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    model = langid.learn(edge_docs, ~held_out_column())
    rows = langid.identify(edge_docs.select("doc_id", "text", "lang"), model, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert 0 <= r.score <= 1 and (r.lang_pred in {"en", "de"}) == letters and (r.lang_pred == "und") == (not letters)
    assert langid.identify(no_docs, langid.learn(no_docs, F.lit(True))).collect() == []
    assert {r.lang_pred for r in langid.identify(edge_docs, langid.learn(no_docs, F.lit(True)), keep=["doc_id"]).collect()} == {"und"}


def test_language_backoff_order():
    from gapmeter.llm.langid import Scorer
    model = {"langs": ["a", "b"], "words": {"known": [-1.0, -9.0]}, "grams": {5: {"_unse": [-3.0, -2.0]}, 4: {"_uns": [0.0, -50.0], "zzzz": [-1.0, -5.0]}, 1: {"z": [-7.0, 0.0]}}}
    s = Scorer(model)
    assert s._row("known") == [-1.0, -9.0] and s._row("unseen") == [-3.0, -2.0] and s._row("zzzz") == [-1.0, -5.0] and s._row("zz") == [-7.0, 0.0]
    assert s._row("q") == [0.0, 0.0]
    assert s.predict("Known known")[0] == "a" and s.predict("unseen")[0] == "b"


# --- op5 -----------------------------------------------------------------

def _simhash(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps, bits):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("bucket_rows", [64, 1])
def test_simhash(spark, edge_docs, edge_rows, no_docs, bucket_rows):
    from gapmeter.llm import simhash
    got = simhash.near_duplicates(edge_docs, bucket_rows=bucket_rows).collect()
    fps = [_simhash(r[1]) for r in edge_rows]
    want = Counter(zip([r[0] for r in edge_rows], [f"{f:016x}" for f in fps], _components([r[0] for r in edge_rows], fps, 2)))
    assert multiset(got) == want
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("bucket_rows", [64, 2])
def test_simhash_links_of_planted_fingerprints(spark, bits, bucket_rows):
    """Fingerprints at known distances, many around one centre: pivots and balls find the same components."""
    from gapmeter.llm import simhash
    from gapmeter.llm.components import connected_components
    r = np.random.default_rng(bits)
    fps = set()
    for centre in r.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        x = centre
        for _ in range(25):
            fps.add(x ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)))
            if r.random() < 0.3:
                x ^= 1 << int(r.integers(64))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    keyed = simhash._keyed(df, bits)
    size = keyed.groupBy("part", "bits").agg(F.count("*").alias("n"))
    cold = keyed.join(size.where(F.col("n") <= bucket_rows), ["part", "bits"]).groupBy("part", "bits").agg(F.collect_list("fp").alias("fps")) \
        .select("fps").mapInArrow(simhash._verify(bits, 16), "a long, b long")
    hot = keyed.join(size.where(F.col("n") > bucket_rows), ["part", "bits"]).select("fp").distinct()
    label = {r.id: r.label for r in connected_components(cold.union(simhash._ball_links(hot, bits))).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = _components(signed, fps, bits)
    assert [label.get(f, f) for f in signed] == want


# --- op6 -----------------------------------------------------------------

def test_mixing(spark, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import mixing
    got = mixing.mix(edge_docs, rows_per_range=9).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in edge_rows)
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    by_size = {v: s for s, v in sizes.items()}
    taken = defaultdict(int)
    for r in got:
        s = by_size[r.source_size]
        assert math.isclose(r.target, target[s]) and r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[s] += r.taken
    largest = {s: max(len(words(r[1])) for r in edge_rows if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
        epochs = math.floor(target[s] / sizes[s])
        copies = {r.copies for r in got if by_size[r.source_size] == s and r.size}
        assert copies <= {epochs, epochs + 1}
    assert multiset(got) == multiset(mixing.mix(edge_docs.repartition(5), rows_per_range=9).collect())
    assert multiset(got) == multiset(mixing.mix(edge_docs, rows_per_range=10_000).collect())
    assert mixing.mix(no_docs).collect() == []


def test_mixing_prefers_quality(spark):
    from gapmeter.llm import mixing
    docs = spark.createDataFrame([(i, "a b c d e", "s" if i % 2 else "t") for i in range(4000)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 1.0 if i % 4 < 2 else 0.1) for i in range(4000)], "doc_id long, weight double")
    got = mixing.mix(docs, weights=(1,), share=0.3, quality=quality).toPandas()
    got["good"] = got.doc_id % 4 < 2
    assert got[got.good].copies.mean() > 3 * got[~got.good].copies.mean()


# --- op7 -----------------------------------------------------------------

def test_chat_collapse(spark):
    from gapmeter.llm import chat
    talk = {1: [("u", "a"), ("b", "c")], 2: [("u", "a"), ("b", "c"), ("u", "d")], 3: [("u", "a"), ("b", "c"), ("u", "d")], 4: [("u", "ab"), ("b", "c")],
            5: [("ua", ""), ("b", "c")], 6: [("u", None)], 7: [("u", "")], 8: [(None, "a")], 9: [("u", "a")], None: [("u", "a")], 10: [("u", "x"), ("u", "x")], 11: [("u", "x")]}
    rows = [(c, i, r, t, "clash") for c, ts in talk.items() for i, (r, t) in enumerate(ts)] + [(12, None, "s", "first", ""), (12, 0, "u", "x", ""), (13, 0, "s", "first", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chain string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.collapse_and_render(df).collect()}
    full = {c: [(r or "", t or "") for r, t in ts] for c, ts in talk.items()} | {12: [("s", "first"), ("u", "x")], 13: [("s", "first")]}
    want = {}
    for c, ts in full.items():
        longer = any(len(o) > len(ts) and o[:len(ts)] == ts for o in full.values())
        same = [k for k, o in full.items() if o == ts and k is not None]
        if not longer and c == (min(same) if same else None):
            want[c] = (len(ts), "\n".join(f"<|{r}|>\n{t}<|end|>" for r, t in ts))
    assert got == want
    assert chat.collapse_and_render(df.limit(0)).collect() == []


# --- op8 -----------------------------------------------------------------

def test_toxicity(spark, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import toxicity
    clean = ["good day to all of you", "the weather is fine", "we like the green tree", "read the long book now"]
    bad = ["you are scum and trash", "what a stupid moron", "pathetic worthless scum", "such trash and stupid talk"]
    rows = [(i, f"{(bad if i % 4 == 0 else clean)[i % 7 % 4]} number {i * 7919 % 101} and more", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True), steps=10)
    got = toxicity.score(docs, model, [F.col("doc_id")]).collect()
    held = [r for r in got if r.doc_id >= 300]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    many = toxicity.score(edge_docs, model, [F.col("doc_id")]).collect()
    assert Counter(r.doc_id for r in many) == Counter(r[0] for r in edge_rows) and all(0 <= r.score <= 1 for r in many)
    assert {r.predicted for r in many if r.doc_id in (1, 2, 3)} == {0}
    one = toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, one, [F.col("doc_id")]).collect()} == {0}
    assert toxicity.score(no_docs, toxicity.learn(no_docs, labels.limit(0), F.lit(True)), [F.col("doc_id")]).collect() == []


def test_toxicity_slices_agree():
    from gapmeter.llm.toxicity import DIMENSIONS, Features
    text = "some words scum 日本 " * 9000
    whole, parts = Features(), Features()
    parts.SLICE = 1000
    w = np.random.default_rng(1).normal(size=DIMENSIONS).astype(np.float32)
    assert math.isclose(whole.mean_weight(text, w), parts.mean_weight(text, w), rel_tol=1e-9)
    places, values = parts.counted(text)
    assert math.isclose(float(w[places] @ values), whole.mean_weight(text, w), rel_tol=1e-6)


# --- op9 -----------------------------------------------------------------

def test_quality_counts_and_verdict(spark, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import divergence
    got = divergence.judge(edge_docs).collect()
    want = []
    for i, t, *_ in edge_rows:
        w = words(t)
        triples = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n, cover = Counter(triples), set()
        for k, x in enumerate(triples):
            if n[x] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover),
                     len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert multiset(r[:7] for r in got) == Counter(want)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert divergence.judge(no_docs).collect() == []
    assert all(r.word_distance is None and r.kept == (not r.base_failed) for r in divergence.judge(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_quality_plan_is_native(spark, edge_docs):
    from gapmeter.llm import divergence
    out = divergence.judge(edge_docs)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


# --- op10 ----------------------------------------------------------------

def _tiktoken():
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), P.PATTERN


def test_bpe(spark, edge_docs, edge_rows, no_docs):
    from gapmeter.llm import bpe
    raw, enc, pattern = _tiktoken()
    got = bpe.encode_documents(edge_docs, raw, pattern, with_ids=True).collect()
    want = []
    for i, t, *_ in edge_rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""), tuple(ids)))
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in got) == Counter(want)
    assert bpe.encode_documents(no_docs, raw, pattern).collect() == []


def test_bpe_fuzz_and_small_tables():
    import random

    from gapmeter.llm import bpe
    raw, enc, pattern = _tiktoken()
    tok = bpe.Tokenizer(bpe.read_ranks(raw), pattern, cache_pieces=50)
    tok.machine.max_states = 300
    r = random.Random(1)
    alpha = ["a", "b", "  ", "\n", "\t", " ", "é", "ß", "中文", "1", "٣", "!", "#", "\x1c", " ", "\xa0", "'s", "'", "the", " and", "xxxxx", "\U0001f600", "́", "Ⅷ", "²"]
    for _ in range(600):
        s = "".join(r.choice(alpha) for _ in range(r.randint(0, 60)))
        assert [i for b, _ in tok.blocks(s) for i in b] == enc.encode_ordinary(s)
    for s in (" " * 9000, "a" * 9001, "ab" * 7000, "é" * 5000, "=-" * 6000):
        assert [i for b, _ in tok.blocks(s) for i in b] == enc.encode_ordinary(s)


def test_utf8_machine():
    from gapmeter.llm.bpe import Utf8Machine
    text = "aé日\U0001f600z" * 20
    for step in (1, 2, 3, 5):
        m, out, data = Utf8Machine(), "", text.encode()
        for i in range(0, len(data), step):
            out += m.feed(data[i:i + step])
            assert len(m.held) <= 3
        assert out + m.feed(b"", final=True) == text
    m = Utf8Machine()
    assert m.feed(b"\xff\xe6") + m.feed(b"A", final=True) == "��A"
