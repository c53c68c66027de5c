"""The pipeline, stage by stage, against plain versions of its operators, each fed with what the one before it kept."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import pytest
import regex

sys.path.insert(0, os.path.dirname(__file__))
from test_llm_operators import _components, _simhash, _tiktoken, sha, words  # noqa: E402

LETTERS = regex.compile(r"\p{L}+")


# --- plain language ID ---------------------------------------------------

def _learn(rows):
    """(langs, words, grams) from all training rows."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 5):
            counts[lang].update(LETTERS.findall(text.lower()))
    langs = sorted(counts)

    def table(by_lang, top, least):
        total = {g: sum(c.values()) for g, c in by_lang.items()}
        whole = Counter()
        for c in by_lang.values():
            whole.update(c)
        chosen = sorted((w for w, n in whole.items() if n >= least), key=lambda w: (-whole[w], w.encode()))[:top]
        return {w: [math.log((by_lang[g][w] + 0.5) / (total[g] + 0.5 * (len(chosen) + 1))) for g in langs] for w in chosen}
    grams = {}
    for k in (5, 4, 3, 2, 1):
        by = {g: Counter() for g in langs}
        for g in langs:
            for w, n in counts[g].items():
                m = f"_{w}_"
                for at in range(len(m) - k + 1):
                    if m[at:at + k] != "_":
                        by[g][m[at:at + k]] += n
        grams[k] = table(by, 10_000, 1)
    return langs, table(counts, 20_000, 2), grams


def _judge(model, text):
    langs, known, grams = model
    found = Counter(LETTERS.findall((text or "").lower()))
    if not langs or not found:
        return "und", 0.0, 0.0
    score, share = [0.0] * len(langs), [0.0] * len(langs)
    for w, n in found.items():
        row = known.get(w)
        for k in (5, 4, 3, 2, 1):
            if row is not None:
                break
            m = f"_{w}_"
            hits = [grams[k][m[at:at + k]] for at in range(len(m) - k + 1) if m[at:at + k] in grams[k]]
            if hits:
                row = [sum(x) / len(hits) for x in zip(*hits)]
        for j in range(len(langs)):
            score[j] += n * (row[j] if row else 0.0)
            share[j] += n * sum(grams[1].get(c, [-99.0] * len(langs))[j] >= math.log(1e-4) for c in w)
    best = max(range(len(langs)), key=lambda j: (round(score[j], 9), -j))
    return langs[best], 1 / sum(math.exp(s - score[best]) for s in score), share[best] / sum(len(w) * n for w, n in found.items())


# --- plain stages over rows (doc_id, text, lang, source) ------------------

def _language(rows):
    model = _learn([r[:3] for r in rows])
    out = []
    for r in rows:
        lang, score, known = _judge(model, r[1])
        if lang != "und" and score >= 0.5 and (known >= 0.5 or not regex.search(r"\p{L}\P{L}+\p{L}", r[1])):
            out.append(r)
    return out


def _near(rows):
    ids = [r[0] for r in rows]
    comp = _components(ids, [_simhash(r[1]) for r in rows], 2)
    return [r for r, c in zip(rows, comp) if r[0] == c]


def _substring(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *rest in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        if not any(gone):
            out.append((i, t, *rest))
        elif not all(gone):
            out.append((i, " ".join(x for x, g in zip(w, gone) if not g), *rest))
    return out


def _mixture(rows, quality):
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(2.0 * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        key = lambda r: -math.log((int(hashlib.md5(f"{r[0]}:6".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13) / quality.get(r[0], 0.6)
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (key(r), r[0])):
            n = len(words(r[1]))
            upto += n
            over = upto - rest
            out += [r] * (epochs + (over <= 0 or (over < n and over < n - over))) if n else []
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(11)
    alpha = {"aa": "abcdeéfgh", "bb": "klmnopqrß", "cc": "stuvwxyzö"}
    lexicon = {g: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(120)] for g, a in alpha.items()}
    say = lambda g, n: " ".join(rng.choice(lexicon[g]) for _ in range(n))
    passage = {g: say(g, 40) for g in alpha}
    rows = []
    for i in range(160):
        g = rng.choice(list(alpha))
        t = say(g, rng.randrange(5, 90))
        if i % 5 == 0:
            t = f"{t} {passage[g]} {say(g, 6)}"
        rows.append([i * 3, t, g if i % 11 else None, rng.choice(["web", "book", None, "wiki"])])
    for k in range(12):  # exact copies, and near copies
        rows.append([1000 + k, rows[k][1], rows[k][2], "web"])
        w = rows[20 + k][1].split()
        rows.append([2000 + k, " ".join([*w, w[-1]]), rows[20 + k][2], "book"])
    rows += [[3000, None, "aa", "web"], [3001, "", None, "web"], [3002, "123 !!", "bb", None], [3003, "жук " * 30, "aa", "web"], [3004, passage["aa"], "aa", "wiki"],
             [3005, "one", "aa", "web"], [3006, "\n".join([passage["bb"]] * 3), "bb", "book"]]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], rng.randrange(2), 0) for r in rows[::2]] + [(rows[0][0], 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    marks = defaultdict(list)
    for i, q, _ in labels:
        marks[i].append(q)
    return path, [tuple(r) for r in rows], {i: 0.2 + 0.8 * sum(q) / len(q) for i, q in marks.items() if i is not None}


def test_language_against_a_plain_scorer(spark, table):
    from gapmeter.llm import langid, queries
    path, rows, _ = table
    got = {r.doc_id: r for r in queries.op4_language_id(spark, path).collect()}
    model = _learn([r[:3] for r in rows])
    for i, text, *_ in rows:
        lang, score, _ = _judge(model, text)
        assert got[i].lang_pred == lang and math.isclose(got[i].score, score, abs_tol=1e-9) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert langid.learn(spark.read.parquet(f"{path}/documents.parquet"), queries.F.lit(False))["langs"] == []


def test_stages_against_plain_ones(spark, table, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline
    path, rows, quality = table
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), rows
    plain = [_language, _near, _substring, lambda x: _mixture(x, quality)]
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        stage(spark, docs, path).write.parquet(f"file://{tmp_path}/{name}")
        docs, kept = spark.read.parquet(f"file://{tmp_path}/{name}"), brute(kept)
        assert Counter(tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()) == Counter(kept), name
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] != sizes[4]  # every stage decides something
    _, enc, _ = _tiktoken()
    want = Counter((i, len(ids := enc.encode_ordinary(t)), sha(" ".join(map(str, ids)))) for i, t, *_ in kept)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect()) == want
