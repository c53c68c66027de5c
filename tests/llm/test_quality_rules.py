"""Each half of the divergence rule decides on its own, for any language, and languages come from the documents."""

import random

import pytest

VOWELS, REST = "aeiou", "bcdfghklmnprstvz"


def _language(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(REST) + rng.choice(VOWELS) for _ in range(n))
    return [word(1) + str(seed)[-1].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)], [word(rng.randrange(2, 5)) for _ in range(3000)]


def _text(rng, lang, n, common=0.35):
    return " ".join(rng.choice(lang[0]) if rng.random() < common else rng.choice(lang[1]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def judged(spark):
    from gapmeter.llm import divergence
    rng = random.Random(1)
    langs = {"xx": _language(10), "yy": _language(21), "zz": _language(32)}
    rows = [(i, _text(rng, langs[g], rng.randrange(100, 300)), g) for i, g in enumerate(["xx", "yy"] * 60 + ["zz"] * 5)]
    x = langs["xx"]
    rows += [(1000, _text(rng, x, 150, 0.0), "xx"),  # no common word, but the usual characters
             (1001, " ".join(w.upper() + "%%%" if k % 2 else w for k, w in enumerate(_text(rng, x, 150).split())), "xx"),
             (1002, _text(rng, x, 150), None), (1003, _text(rng, langs["yy"], 150), "xx"), (1004, _text(rng, x, 60, 0.0), "xx"),
             (1005, "A " * 90, "xx"), (1006, None, "xx"), (1007, "", None), (1008, _text(rng, x, 150), "rare")]
    # the class rule alone: common words as they are, the others in capitals
    common = set(x[0])
    rows.append((1009, " ".join(w if w in common else w.upper() * 2 for w in _text(rng, x, 200).split()), "xx"))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, ref string, common string")
    return {r.doc_id: r for r in divergence.judge(df).collect()}, rows, langs, df, divergence.judge(df, word_factor=1e6), divergence.judge(df, class_factor=1e6)


def test_words_alone_reject(judged):
    got = judged[0]
    assert not got[1000].kept and not got[1000].base_failed
    kept = {r.doc_id: r.kept for r in judged[4].collect()}  # without the word rule
    assert kept[1000] and not kept[1009]


def test_classes_alone_reject(judged):
    got = judged[0]
    assert not got[1009].kept and not got[1009].base_failed
    kept = {r.doc_id: r.kept for r in judged[5].collect()}  # without the class rule
    assert kept[1009] and not kept[1000]


def test_clean_documents_of_any_language_stay(judged):
    got = judged[0]
    assert sum(got[i].kept for i in range(120)) == 120
    assert got[1002].kept and got[1003].kept and got[1008].kept  # judged by the nearest reference, whatever their own lang


def test_short_and_empty_texts(judged):
    got = judged[0]
    assert got[1004].kept  # too short to be judged by words
    assert got[1005].base_failed and got[1006].base_failed and got[1007].base_failed and not got[1006].kept
    assert not got[1001].kept


def test_vocabulary_is_learned_per_language(judged):
    from gapmeter.llm import divergence
    _, rows, langs, df, _, _ = judged
    words = divergence.common_words(df, 10, 20, 50, "text", "lang")
    for g in ("xx", "yy"):
        best = {}
        for _, t, lang in rows:
            if lang == g and len((t or "").split()) >= 50:
                for w in set(t.split()):
                    best[w] = best.get(w, 0) + 1
        assert set(sorted(best, key=lambda w: (-best[w], w))[:10]) <= set(words)
    assert len(words) <= 20 and not set(langs["zz"][0]) & set(words)  # five documents make no reference
    assert divergence.common_words(df.limit(0), 10, 20, 50, "text", "lang") == []
