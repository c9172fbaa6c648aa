import random
from collections import Counter

import pytest

from redlight.llm import packing, tokens
from redlight.llm.bpe import PieceEncoder
from redlight.llm.packing import best_fit, plan, reduce_by_dominance, token_pieces
from redlight.llm.queries import tokenizer_path
from redlight.llm.tokens import token_counts

PARTS = ["a", "B", "é", "é", "Σ", "ΑΣ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "12", "٣", "!", "?!", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "日本", "🙂", "́", "​", "\x00", "don't", "ﬀ", "가"]


def texts(n=400, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(12))) for _ in range(n)] + ["", "word " * 3000, "x" * 5000, " \n" * 50]


def test_counts_are_the_library_s(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "a b", 1), (3, None, 2), (5, "again", 3), (5, "again", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    library = PieceEncoder(path).tokenizer
    want = Counter()
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    for options in ({}, {"table_rows": 3, "cache_rows": 2, "sample_rows": 5}):
        assert Counter(tuple(r) for r in token_counts(df, path, **options).collect()) == want
    assert token_counts(df.limit(0), path).count() == 0


def test_pieces_are_the_library_s(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts(seed=1))] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in sorted(token_pieces(df, path, cache_rows=50).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["length"] * 4 == len(r["ids"]) <= 4 * 2048 and r["start"] * 4 == len(got.get(r["doc_id"], b""))
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    library = PieceEncoder(path).tokenizer
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == b"".join(x.to_bytes(4, "little") for x in ids)


def least_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 17, 30])
    sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
    fixed, left = reduce_by_dominance(Counter(sizes), capacity)
    seen = Counter(left)
    for pattern, n in fixed:
        assert sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            seen[s] += k * n
    assert +seen == Counter(sizes)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert sum(n for _, n in fixed) + least_bins(rest, capacity) == least_bins(sizes, capacity)


def test_best_fit_places_all():
    rnd = random.Random(4)
    counts = Counter(rnd.randint(1, 100) for _ in range(5000))
    out = best_fit(counts, 100)
    placed = Counter()
    for pattern, n in out:
        assert sum(s * k for s, k in pattern) <= 100
        for s, k in pattern:
            placed[s] += k * n
    assert placed == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(n for _, n in out) <= 1.02 * total / 100 + 1
    assert len(plan(dict(counts), 100)) < 5000


def test_pack_is_gapless(spark):
    rnd = random.Random(6)
    rows = [(i, 0, rnd.choice([3, 50, 50, 50, 77, 100])) for i in range(500)] + [(1, 0, 50)] * 3 + [(None, 0, 20), (2, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    out = packing.pack(df, ["doc_id", "piece"], 100).collect()
    assert len(out) == len(rows) - 1
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert packing.pack(df.limit(0), ["doc_id", "piece"], 100).count() == 0


def test_frequent_chunks_come_from_all_rows(spark, monkeypatch):
    seen, find = [], tokens.frequent_chunks
    monkeypatch.setattr(tokens, "frequent_chunks", lambda *a, **k: seen.append(find(*a, **k)) or seen[-1])
    rows = [(i, "early words") for i in range(1500)] + [(i, "x" * 9000 + " later words" * 3) for i in range(1500, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    assert tokens.token_counts(df, tokenizer_path("byte_bpe_50k.json"), table_rows=2).count() == 3000
    assert sorted(seen[0]) == [" later", " words"]


def test_summaries_merge_by_task(spark):
    """Counts of frequent words survive the merging of bounded summaries; one row is left."""
    rows = [(i, "the cat sat on the mat " * 3 + f"word{i} and\nmore the") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    left = tokens.merged(tokens.summaries(docs, "text", 50), 50, fan=3)
    assert left.count() == 1 and len(left.first()["chunks"]) <= 50
    found = dict(zip(left.first()["chunks"], left.first()["n"]))
    assert found[" the"] == 300 * 7 and found[" cat"] == 300 * 3
    assert tokens.frequent_chunks(docs, "text", 50, 3)[0] == " the"
    assert tokens.frequent_chunks(docs.limit(0), "text", 50, 3) == []
