"""The transducer's bounds, and a decoder whose output is what counts."""

import random

import numpy as np
import public_tokenizers as P
import pytest


@pytest.fixture(scope="module")
def raw():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_pairs_are_judged_as_merges_go(raw):
    """Two tokens may stand side by side exactly if BPE of their bytes is these two."""
    from gapmeter.llm.bpe import Transducer, read_ranks
    m = Transducer(read_ranks(raw))
    r, ids = random.Random(1), [*m.ranks.values()]
    for t in r.sample(ids, 1500):
        assert m.follows(-1, t)
        for after in r.sample(ids, 25):
            assert m.follows(t, after) == (m.merge(m.token[t] + m.token[after]) == [m.token[t], m.token[after]])


def test_memory_is_bounded_over_distinct_words(raw):
    """However many words are met: states, cached pieces and sightings stay within their bounds."""
    from gapmeter.llm import bpe
    tok = bpe.Tokenizer(bpe.read_ranks(raw), P.PATTERN, cache_pieces=2000)
    tok.machine.max_states = 9000
    r, most = random.Random(2), [0, 0, 0]
    for _ in range(300):
        text = " ".join("".join(r.choice("abcdefghiklmnoprstuvwé") for _ in range(r.randrange(3, 14))) for _ in range(200))
        for _ in range(2):
            for ids, _ in tok.blocks(text + " " + "x" * 300):
                pass
        most = [max(a, b) for a, b in zip(most, (len(tok.machine.nodes) + len(tok.machine.pairs), len(tok.cache) + len(tok.before), max(map(len, tok.cache), default=0)))]
    assert most[0] <= 9000 + 600 and most[1] <= 2000 and most[2] <= tok.LONG_PIECE
    assert len(tok.seen) == tok.SEEN


def test_decoded_digest_comes_from_the_machine(spark, raw, monkeypatch):
    from gapmeter.llm import bpe
    df = spark.createDataFrame([(1, "plain é and 日本\U0001f600 ́ end")], "doc_id long, text string")
    good = bpe.encode_documents(df, raw, P.PATTERN).collect()[0].decoded_sha256
    step = bytearray(bpe.Utf8Machine.STEP)
    step[2 * 16 + 2] = 8  # two bytes before a character ends
    monkeypatch.setattr(bpe.Utf8Machine, "STEP", bytes(step))
    assert bpe.encode_documents(df, raw, P.PATTERN).collect()[0].decoded_sha256 != good


def test_machine_agrees_with_utf8_on_any_bytes(raw):
    from gapmeter.llm import bpe
    tok, r = bpe.Tokenizer(bpe.read_ranks(raw), P.PATTERN), random.Random(3)
    single = [tok.machine.ranks[bytes([b])] for b in range(256)]
    for _ in range(3000):
        data = b"".join(r.choice([b"a", "é".encode(), "日".encode(), "\U0001f600".encode(), bytes([r.randrange(128, 256)])]) for _ in range(r.randrange(9)))
        cut = r.randrange(len(data) + 1)
        m, two = bpe.Utf8Machine(), bpe.Utf8Machine()
        assert m.feed(data[:cut]) + m.feed(data[cut:], final=True) == data.decode("utf-8", "replace") and len(m.held) <= 3
        ids = np.array([single[b] for b in data], np.uint32)
        assert tok.decode(ids[:cut], two) + tok.decode(ids[cut:], two, final=True) == data.decode("utf-8", "replace").encode()
