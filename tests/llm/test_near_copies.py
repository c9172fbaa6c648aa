import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from redlight.llm import near_copies, stages


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """Smallest id reached, by comparing all pairs."""
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in s}


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10**6)}"
    return words


def planted():
    rnd, rows = random.Random(5), []
    word = lambda: f"w{rnd.randrange(3000)}"
    footer = [f"foot{i}" for i in range(40)]
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([30, 120, 300, 700]))]
        rows.append(base)
        rows += [edited(rnd, base, max(1, len(base) // k)) for k in (150, 60, 45, 40, 20)]
    rows += [[*(word() for _ in range(rnd.choice([8, 15, 60, 200]))), *footer] for _ in range(80)]
    chain = [word() for _ in range(200)]
    for _ in range(12):  # each is near the one before, the ends are not near each other
        chain = chain[8:] + [word() for _ in range(8)]
        rows.append(chain)
    rnd.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "two one"), (905, rows[3] and " ".join(rows[3]))]


@pytest.mark.parametrize("common", [True, False])
def test_components_equal_brute_force(spark, monkeypatch, common):
    if not common:  # the order of shingles decides the cost only
        monkeypatch.setattr(near_copies, "common_shingles", lambda *a: near_copies.np.zeros(0, near_copies.np.uint64))
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1))
    want = brute(rows)
    key = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    got = {r["text_key"]: r["first"]["doc_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {key(t): want[i] for i, t in rows}


def test_the_stage_drops_copies_with_edited_words(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), *((i, " ".join(edited(rnd, base, 6))) for i in range(2, 12)), (12, " ".join(edited(rnd, base, 60))), (None, " ".join(base)), (13, " ".join(base)), (None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r[0] or 0 for r in stages.drop_near_duplicates(spark, df, "").collect()) == [0, 1, 12]
    assert stages.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "first text of its own", "x"), (1, "another text altogether", "y"), (1, "another text altogether", "y"), (1, "another text altogether", "z"), (2, None, "a"), (3, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string")
    got = [tuple(r) for r in stages.drop_near_duplicates(spark, df, "").collect()]
    assert len(got) == 3 and {r[:2] for r in got} == {(1, "first text of its own"), (1, "another text altogether"), (2, None)}
