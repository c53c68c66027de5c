"""Large buckets by stored pivot coordinates: same links as brute force, and as the way by shared neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _cluster(n, seed, bits=6):
    """Distinct fingerprints around one centre that agree in half of their bits."""
    r = np.random.default_rng(seed)
    out = {0x1234567890ABCDEF}
    while len(out) < n:
        x = 0x1234567890ABCDEF
        for b in r.choice(32, r.integers(1, bits), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def _roots(u, bits):
    root = np.arange(len(u))
    for i in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u ^ u[i]) <= bits)
        least = root[near].min()
        hit = np.isin(root, root[near])
        root[hit] = least
    return root


def _same_groups(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 40, 1500])
def test_bucket_roots(n, bits):
    from gapmeter.llm import simhash as m
    r = np.random.default_rng(n)
    u = np.unique(np.concatenate((_cluster(n, 1, 12), r.integers(0, 1 << 63, n, dtype=np.uint64))))
    co = m._coordinates(u.view(np.int64), m._table(32))
    o = np.lexsort((u, co[:, 0]))
    assert _same_groups(m._bucket_roots(u[o], co[o], bits), _roots(u[o], bits))


def test_coordinates_are_distances_and_stored_once(spark):
    from gapmeter.llm import simhash as m
    u = _cluster(50, 3)
    df = spark.createDataFrame([(int(x), 1) for x in u], "fp long, rep long")
    got = m.with_coordinates(df, 8).collect()
    table = m._table(8)
    assert all(list(np.frombuffer(r.co, np.int8)) == [(r.fp ^ int(t)).bit_count() for t in table] for r in got) and len(got) == 50
    keyed = m._keyed(m.with_coordinates(df, 8), 2)
    assert keyed.columns == ["fp", "co", "part", "bits"] and keyed.count() == 6 * 50


def test_a_bucket_of_ten_thousand(spark):
    """One bucket holds them all; pivots and neighbours give the same components, and links stay one per fingerprint."""
    from gapmeter.llm import simhash as m
    from gapmeter.llm.components import connected_components
    u = _cluster(10_000, 5)
    df = spark.createDataFrame([(int(x), 1) for x in u], "fp long, rep long").repartition(4)
    keyed = m._keyed(m.with_coordinates(df, m.PIVOTS), 2)
    sizes = keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert sizes == 10_000
    buckets = keyed.groupBy("part", "bits").agg(F.collect_list(F.struct("fp", "co")).alias("x")).select("x.fp", "x.co")
    links = buckets.mapInArrow(m._verify(2, m.PIVOTS), "a long, b long")
    assert links.count() < 6 * 10_000
    label = {r.id: r.label for r in connected_components(links).collect()}
    other = {r.id: r.label for r in connected_components(m._ball_links(df.select("fp"), 2)).collect()}
    ids = [int(x) for x in u]
    assert [label.get(i, i) for i in ids] == [other.get(i, i) for i in ids] and len(set(label.values())) >= 1


def test_whole_query_agrees_at_any_bucket_size(spark):
    from gapmeter.llm import simhash as m
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(600):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            w[k] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, m.near_duplicates(df, bucket_rows=b).collect())) for b in (16_384, 4))
    assert one == two and len({r[2] for r in one}) < 600
