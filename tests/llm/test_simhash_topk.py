import itertools
import random

import numpy as np
import pytest
import xxhash

from redlight.llm import simhash, topk


def reference_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ("", "one", "One two", "a b c d a b c", "É x\xa0y\tz\x0bq " * 50, "ÀB " * 4):
        assert simhash.fingerprint(t.encode()) == reference_fingerprint(t)


def flip(x, *bits):
    for b in bits:
        x ^= 1 << b
    return x


@pytest.mark.parametrize(("k", "limit"), [(2, 4096), (2, 3), (1, 2), (3, 5)])
def test_links_join_what_is_near(spark, k, limit):
    rnd = random.Random(k)
    fps = set()
    for _ in range(8):
        base = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(flip(base, *rnd.sample(range(64), rnd.randrange(4))))
    base = rnd.getrandbits(64)
    fps |= {flip(base, *c) for c in itertools.combinations(range(40, 50), 2)}  # many share a segment
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= k:
            root[find(a)] = find(b)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, k, limit)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(signed(x))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1), (3, text, 1), (3, text, 2), (9, None, 0), (8, "", 0), (None, text, 0), (7, "other words here entirely", 0), (2, "x y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (2, 2)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi in sorted({i for i, _ in ok if i % 50 == 0}):
        q = min((tuple(v) for i, v in ok if i == qi))
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi)[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("n", "dim", "scale"), [(400, 16, 1.0), (300, 3, 0.01), (60, 8, 1e4)])
def test_top_k(spark, n, dim, scale):
    rnd = random.Random(n)
    rows = [(i, [rnd.gauss(0, scale) for _ in range(dim)]) for i in range(n)] + [(n + i, [0.5] * dim) for i in range(150)]
    rows += [(1000, None), (1050, [float("nan")] * dim), (1100, [None] * dim), (1150, [float("inf")] * dim), (None, [1.0] * dim), (1200, []), (1, [0.5] * dim)]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score long")
    v = topk.whole_numbers(df)
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0"), shard_rows=97, query_rows=3, block=16).collect()))
    assert got == brute_top(rows)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_of_many_queries_is_the_top_of_each():
    """op6: a block is bounded and scored for all queries at once."""
    import numpy as np

    from redlight.llm.topk import Shard

    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (700, 16)).astype(float)
    x[300:600] *= 0.0
    ids, shard = np.arange(700) * 3, Shard(np.arange(700) * 3, x, 64)
    reached = np.where(np.arange(40) % 3, -np.inf, 300.0)
    many = shard.top_many(x[:40], ids[:40], 5, reached)
    assert shard.touched < shard.postings
    for j in range(40):
        s, i = shard.top(x[j], int(ids[j]), 5, reached[j])
        assert many[j][0].tolist() == s.tolist() and many[j][1].tolist() == i.tolist()
