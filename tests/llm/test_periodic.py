"""Periodic runs against a search for every period, and their cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from redlight.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain(w, least=12):
    """Every maximal stretch of every period, if that is its smallest."""
    out, n = [], len(w)
    w = np.array(w, object)
    for q in range(1, n // 2 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(np.int8)))
        for s, e in zip(same[::2], same[1::2]):
            length = int(e - s) + q
            part = w[s : s + length]
            if length >= max(least, 2 * q) and not any((part[:-r] == part[r:]).all() for r in range(1, q) if q % r == 0):
                out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rnd = random.Random(least)
    for _ in range(300):
        k = rnd.choice([1, 2, 3, 6])
        w = [rnd.randrange(k) for _ in range(rnd.randrange(1, 60))]
        block = w[: rnd.randrange(1, 15)]
        w = w[: rnd.randrange(len(w) + 1)] + block * rnd.randrange(6) + w[:4]
        assert [tuple(map(int, r)) for r in periodic.runs(np.array(w, np.int64), least)] == plain(w, least)


def test_screen_loses_no_run():
    rnd = random.Random(8)
    texts = []
    for _ in range(200):
        w = [rnd.choice("abcdefghijk") for _ in range(rnd.randrange(40))]
        block = [rnd.choice("abcdxyz") for _ in range(rnd.randrange(1, 14))]
        texts.append(w[:20] + block * rnd.randrange(5) + block[: rnd.randrange(14)] + w[20:] + w[:9])
    told = list(periodic._of_texts([" ".join(w).encode() for w in texts]))
    for w, (n, found, kept) in zip(texts, told):
        found = [tuple(map(int, r)) for r in found]
        assert n == len(w) and found == plain(w) and kept.decode() == collapsed(w, found)
    assert sum(len(f) > 0 for _, f, _ in told) > 50


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    w = [x.decode() for x in w]
    found = plain(w)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), s, length, q, 1000 * length // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(w, found)))


def test_query_equals_the_definition(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = [d for d in docs if len(d["text"] or "") < 40_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert [got[d["doc_id"]] for d in docs] == [expected(d["doc_id"], d["text"]) for d in docs]
    assert sum(g[1] > 0 for g in got.values()) >= len(docs) // 20


def test_cases(spark):
    long = "der Satz kommt immer wieder vor " * 4000
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b " * 9, "x"), (3, "one", "x"), (4, long, "x"), (5, " ß  ß\t" * 12, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = sorted(map(tuple, periodic.periodic_runs(docs, group=50).collect()), key=repr)
    assert [(r[0], r[1], [tuple(x) for x in r[2]], bytes(r[3]).decode()) for r in out] == [
        (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (3, 1, [], "one"), (4, 24000, [(0, 24000, 6)], "der Satz kommt immer wieder vor"),
        (5, 24, [(0, 24, 1)], " ß"), (None, 18, [(0, 18, 2)], "a b"),
    ]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    assert periodic.with_loops(docs).count() == len(rows)
    names = spark.createDataFrame([("a", "x y z " * 8)], "doc_id string, text string")
    assert periodic.periodic_runs(names).first()["runs"][0]["period"] == 3
