import random

import pytest

from redlight.llm.suffix import cut_repeats


def brute(rows, window):
    """(doc_id, text) -> removed byte flags, by the definition."""
    seen, out = set(), {}
    for doc_id, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = text.encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[doc_id, text] = gone
    return out


def check(spark, rows, window, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_note string")
    got = cut_repeats(df, window=window, **options).collect()
    assert len(got) == len(rows)
    want = brute([(r[0], r[1]) for r in rows], window)
    for r in got:
        b = (r["text"] or "").encode()
        gone = want.get((r["doc_id"], r["text"]), [])
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        assert len(r["removed"]) == runs and sum(x["length"] for x in r["removed"]) == sum(gone)


def corpus(seed, n, words=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(25)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(words)))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randrange(2), rnd.choice(passages))
        texts.append(rnd.choice(texts) if texts and rnd.random() < 0.2 else " ".join(parts))
    return texts


@pytest.mark.parametrize(("seed", "window", "options"), [(1, 100, {}), (2, 30, {"k": 9}), (3, 30, {"k": 9, "hot": 3, "chunk_rows": 50, "shard_rows": 20}), (4, 31, {"k": 31}), (5, 40, {"k": 5, "chunk_rows": 300, "shard_rows": 64})])
def test_against_definition(spark, seed, window, options):
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(corpus(seed, 90))]
    check(spark, rows, window, **options)


def test_edges(spark):
    long = "ab" * 300 + "the quick brown fox jumps over the lazy dog " * 3
    rows = [(5, None, None), (6, "", "a"), (None, long, "b"), (1, long, "c"), (1, long, "c"), (2, "aaaa" * 200, "d"), (3, "x" + "aaaa" * 200, "e"), (4, "短い文" * 80, "f")]
    check(spark, rows, 100)
    check(spark, rows[:0] or [(1, "short", "z")], 100)


def test_tiles(spark, monkeypatch):
    import redlight.llm.suffix as s

    monkeypatch.setattr(s, "TILE", 200)
    check(spark, [(i, t, "") for i, t in enumerate(corpus(7, 12, 400))], 50, k=20)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert cut_repeats(df).count() == 0


def test_ids_of_any_type_and_an_empty_table(spark):
    """Ids are put in their own order: as texts "10" comes before "9"."""
    passage = "a passage that is long enough to be found again, as it has more than one hundred bytes in all its words. "
    rows = [("9", "nine " + passage), ("10", passage + "ten"), (None, "short"), ("a1", passage + passage)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, removed string")
    cut = {r["doc_id"]: bytes(r["kept"]).decode() for r in cut_repeats(docs).collect()}
    assert cut["10"] == passage + "ten" and cut[None] == "short" and passage not in cut["9"] and passage not in cut["a1"]
    assert cut_repeats(docs.limit(0)).count() == 0
