"""Importance resampling against a plain version, and its cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from redlight.llm import resampling
from redlight.llm.common import materialize

SCHEMA = "doc_id long, text string, rank string, score int, key string, uid int, x int, row int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, percent, runs, buckets, least, seed):
    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = found(x)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = n + 1
    return rows


def some(n=400, seed=5):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Alpha", "beta", "GAMMA9", "délta", "ÉPS", "zeta"]) + rnd.choice(["", "-x", "7", " ", "\t"]) + str(rnd.randrange(30))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, " ".join(word() for _ in range(30))), (n + 2, "w" * 5000 + " tail " * 30), (n + 3, "ß" * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "k", 2, 3, 4) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_the_plain_version(spark, monkeypatch):
    rows, target = some(), [x for _, x in some(30, 9)]
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string")
    for runs, part in ((1, 1 << 22), (3, 1 << 22), (3, 200)):
        monkeypatch.setattr(resampling.weights, "__defaults__", (part,))
        monkeypatch.setattr(resampling.bucket_counts, "__defaults__", (part,))
        out = resampling.resample(frame(spark, rows), aim, percent=37, runs=runs, buckets=211, least_words=10)
        assert got(out) == sorted(map(tuple, plain(rows, target, 37, runs, 211, 10, 2024)), key=repr)


def test_ties_repeats_and_empty_tables(spark):
    rows = some(60)
    same = rows[7]
    again = [*rows, same, same, (same[0], "another text of the same id " * 8)]
    none = spark.createDataFrame([], "text string")
    out = resampling.resample(frame(spark, again), none, percent=50)
    r = out.collect()
    assert len(r) == len(again)
    ranked = sorted((x for x in r if x["rank"]), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, 1 + sum(x["n_words"] >= 20 for x in r) // 2))
    assert all((-a["score"], a["doc_id"] is None, a["doc_id"] or 0) <= (-b["score"], b["doc_id"] is None, b["doc_id"] or 0) for a, b in zip(ranked, ranked[1:]))
    assert resampling.resample(frame(spark, []), none).count() == 0
    assert all(x["rank"] is None for x in resampling.resample(frame(spark, rows), none, percent=0).collect())


def test_kth_key_of_any_number(spark):
    n = 3000
    rows = materialize(spark.range(n).select(F.struct((F.col("id") * 7919 % n).alias("v"), F.lit(None).cast("string").alias("s")).alias("key"), F.col("id").alias("uid")), "keys")
    for k in (1, 2, 1500, n - 1, n):
        lit = resampling.kth_key(rows, "key", "uid", k, n, pivots=5)
        assert spark.range(1).select(lit["v"]).first()[0] == k - 1


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two " * 15), ("a", "one two " * 15), (None, "three " * 40)], "doc_id string, text string")
    out = resampling.resample(docs, docs, percent=100).collect()
    assert sorted(x["rank"] for x in out) == [1, 2, 3]
