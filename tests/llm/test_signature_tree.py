"""The signature-tree join against all pairs, its trees alone, and its cases."""

import random

import duckdb
import numpy as np
import pytest

from redlight.llm import queries, signature_tree as st

SF = "/root/testdata/sf0.001"


def plain(rows, shingle=5, percent=80):
    def members(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [members(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rnd, words, share):
    return " ".join(rnd.choice("xyzuvw") + str(rnd.randrange(99)) if rnd.random() < share else w for w in words)


def corpus(seed, n=120):
    """Near copies of several closeness, chains of links, shared passages, and short texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(60))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rnd.choice([3, 5, 9, 40, 120, 300]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        b = rnd.choice(bases)
        kind = rnd.randrange(4)
        if kind == 0:
            texts.append(" ".join(word() for _ in range(rnd.randrange(1, 60))))
        elif kind == 1:
            texts.append(" ".join(passage + [word() for _ in range(rnd.choice([0, 2, 5, 10, 60]))]))
        else:
            texts.append(edited(rnd, b, rnd.choice([0, 0.005, 0.02, 0.03, 0.05])))
    drift = bases[-1][:]
    for _ in range(15):  # each alike the one before only
        drift[rnd.randrange(len(drift))] = word()
        texts.append(" ".join(drift))
    return [(i + 1, t) for i, t in enumerate(texts)]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # many small trees, blocks and steps
        monkeypatch.setattr(st, "WITH_TEXT", 3)
        monkeypatch.setattr(st, "HELD", 2)
        monkeypatch.setattr(st.traverse, "__defaults__", (7,))
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(st.similar_sets(docs)) == plain(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    q = con.sql(st.ORACLE_SQL)
    assert got(queries.op12_jaccard_join(spark, SF)) == sorted(q.project("doc_id, n_shingles, component_id").fetchall(), key=repr)


def test_traversal_finds_what_bounds_allow():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, rnd.integers(1, 90))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.93)], rnd.choice(pool, 1)])) for s in sets[:80]]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    tree = st.Tree(np.stack([st.bitmap(s) for s in sets]), n, n, np.arange(len(sets)))
    assert len(tree.levels) >= 3
    found = {(min(x, y), max(x, y)) for i, j, _ in st.traverse(tree, tree, 80, 50) for x, y in zip(i.tolist(), j.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if st.alike(sets[i], sets[j], 80)}
    assert true and true <= found and len(found) < len(sets) ** 2 / 20
    half = len(sets) // 2
    a, b = (st.Tree(np.stack([st.bitmap(s) for s in sets[x]]), n[x], n[x], np.arange(len(sets))[x]) for x in (slice(0, half + 9), slice(half, None)))
    across = {(i, j + half) for x, y, _ in st.traverse(a, b, 80) for i, j in zip(x.tolist(), y.tolist())}
    assert {(i, j) for i, j in true if i < half <= j} <= across


def test_trees_skip_what_is_joined():
    s = np.arange(50, dtype=np.uint64)
    bits, n = np.stack([st.bitmap(s)] * 100), np.full(100, 50)
    tree = st.Tree(bits, n, n, np.zeros(100, np.int64))
    assert list(st.traverse(tree, tree, 80)) == []


def test_cases(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(5, None), (4, ""), (4, " \t\n"), (3, "One Two"), (2, "one  two"), (None, "one two"), (None, "alone here"), (9, long), (8, long + " and more"), (9, long), (7, "a b c d e"), (7, "a b c d f"), (6, "ÄB cd"), (1, "äb cd")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, id string, n int, root int")
    assert got(st.similar_sets(docs)) == plain(rows)
    assert st.similar_sets(docs.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "same words"), ("a", "Same words"), ("c", None)], "doc_id string, text string")
    assert got(st.similar_sets(names)) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
