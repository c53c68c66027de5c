"""Long conversations and rows without an id: same results, spread over tasks, rendered in parts."""

from collections import Counter

from pyspark.sql import functions as F


def _want(talk, part):
    out = Counter()
    for c, ts in talk.items():
        longer = any(len(o) > len(ts) and o[:len(ts)] == ts for o in talk.values())
        same = [k for k, o in talk.items() if o == ts and k is not None] or [None]
        if not longer and c == min(same, key=lambda k: (k is None, k)):
            for p in range(0, len(ts), part):
                out[c, p // part, len(ts), "\n".join(f"<|{r}|>\n{t}<|end|>" for r, t in ts[p:p + part])] += 1
    return out


def _talk():
    talk = {c: [("u", f"{c % 40} {i}") for i in range(1 + c % 5)] for c in range(1000, 1300)}
    long = [("b" if i % 2 else "u", f"long {i % 700}") for i in range(1500)]
    return talk | {7: long, 8: long[:600], 9: long[:256], 10: long[:257] + [("u", "else")], None: [("u", f"nobody {i}") for i in range(900)]}


def _rows(spark, talk):
    rows = [(c, i, r, t, "clash", "clash") for c, ts in talk.items() for i, (r, t) in enumerate(ts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string, part string").repartition(5)


def test_long_conversations_and_rows_without_id(spark):
    from gapmeter.llm import chat
    talk = _talk()
    got = chat.collapse_and_render(_rows(spark, talk)).collect()
    assert Counter((r.conv_id, r.part, r.n_turns, r.rendered) for r in got) == _want(talk, chat.PART)
    assert {r.conv_id for r in got if r.conv_id is None or r.conv_id < 1000} == {7, 10, None}
    assert max(r.rendered.count("<|end|>") for r in got) == chat.PART


def test_work_is_spread_over_tasks(spark):
    """The largest conversation has two thirds of all turns; no task numbers, and no row holds, more than its share."""
    from gapmeter.llm import chat, trie
    talk = {7: [("u", f"long {i}") for i in range(4000)]} | {c: [("u", f"{c} {i}") for i in range(4)] for c in range(10, 510)}
    df = _rows(spark, talk)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = trie.numbered(df, "conv_id", "turn", "role", "text").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2600
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = chat.collapse_and_render(df).where("conv_id = 7").orderBy("part").collect()
    assert [r.part for r in parts] == list(range(16)) and {r.n_turns for r in parts} == {4000}
    assert "\n".join(r.rendered for r in parts) == "\n".join(f"<|u|>\nlong {i}<|end|>" for i in range(4000))


def test_hash_of_a_prefix_is_that_of_the_shorter_conversation(spark):
    from gapmeter.llm import chat, trie
    long = [("u", f"t{i}") for i in range(600)]
    talk = {1: long, 2: long[:255], 3: long[:256], 4: long[:257], 5: [long[1], long[0]]}
    h = {(r.conv_id, r.pos): (r.ha, r.hb) for r in chat.prefix_hashes(trie.numbered(_rows(spark, talk), "conv_id", "turn", "role", "text")).collect()}
    for c in (2, 3, 4):
        assert all(h[c, p] == h[1, p] for p in range(1, len(talk[c]) + 1))
    assert len({h[1, p] for p in range(1, 601)}) == 600 and h[5, 2] != h[1, 2]


def test_whole_conversations_with_their_chain(spark):
    """A row per conversation, however long: the whole text and the SHA-256 chain over its turns."""
    import hashlib

    from gapmeter.llm import chat
    talk = _talk()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for c, _, n, _ in _want(talk, 10**6):
        chain = ""
        for r, t in talk[c]:
            chain = sha(chain + sha(f"{len(r)}:{r}{t}"))
        want[c, n, "\n".join(f"<|{r}|>\n{t}<|end|>" for r, t in talk[c]), chain] += 1
    assert Counter(tuple(r) for r in chat.collapse_whole(_rows(spark, talk)).select("conv_id", "n_turns", "rendered", "chain_sha256").collect()) == want
    assert chat.collapse_whole(_rows(spark, talk).limit(0)).collect() == []


def test_query_gives_whole_conversations(spark, tmp_path):
    from gapmeter.llm import queries
    talk = _talk()
    _rows(spark, talk).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op7_chat(spark, f"file://{tmp_path}")
    assert got.columns == ["conv_id", "n_turns", "rendered", "chain_sha256"]
    assert [r.rendered.count("<|end|>") for r in got.where("conv_id = 7").collect()] == [1500]
