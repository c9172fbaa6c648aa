"""Masked-place joins lose no pair and meet few others."""

import random
from itertools import product

import pytest

from redlight.operators import masked, reads


@pytest.mark.parametrize(("m", "d"), [(1, 0), (1, 1), (3, 1), (6, 2), (8, 3), (12, 2), (20, 8), (33, 13)])
def test_some_mask_hides_every_difference(m, d):
    rnd = random.Random(m)
    kept = masked.masks(m, d)
    assert len(kept) <= max(masked.MOST, d + 1)
    for _ in range(300):
        differ = set(rnd.sample(range(1, m + 1), d))
        assert any(not differ & set(k) for k in kept)


def like(a, b):
    n = min(len(a), len(b))
    return n and sum(x == y for x, y in zip(a, b)) / n + (0.1 if len(a) == len(b) else 0.0)


def test_candidates_hold_all_alike_pairs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("AB01") for _ in range(rnd.randrange(1, 10)))
    a, b = sorted({word() for _ in range(150)} | {"A" * 40}), sorted({word() for _ in range(60)})
    x, y = spark.createDataFrame([(t,) for t in a], "_t string"), spark.createDataFrame([(t,) for t in b], "_v string")
    for least in (0.65, 0.70):
        got = {(r["_t"], r["_v"]) for r in reads.fuzzy_candidates(x, y, least).collect()}
        want = {(s, t) for s, t in product(a, b) if like(s, t) >= least}
        assert want <= got and len(got) <= len(want) + 3 * len(a)
    got = {(r["_t"], r["_k"]) for r in reads.version_candidates(x, y.toDF("_k")).collect()}
    assert got == {(s, t) for s, t in product(a, b) if len(s) == len(t) and sum(p != q for p, q in zip(s, t)) <= 2}


def test_candidates_grow_with_the_pairs_sought(spark):
    """Random plates are hardly ever alike, so hardly any meet."""
    rnd = random.Random(1)
    plate = lambda: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + f"{rnd.randrange(10000):04d}"
    for n in (500, 2000):
        t = spark.createDataFrame([(x,) for x in sorted({plate() for _ in range(n)})], "_t string")
        assert reads.fuzzy_candidates(t, t.toDF("_v"), 0.7).count() < 20 * n and reads.version_candidates(t, t.toDF("_k")).count() < 20 * n
