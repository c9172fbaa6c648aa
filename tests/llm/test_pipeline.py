"""The whole pipeline against a plain version of each stage."""

import random
from collections import Counter

import duckdb
import pandas as pd
from test_cases import DOCS, plain_toxicity
from test_near_copies import brute, edited
from test_suffix import brute as repeated

import corpus_pipeline
from redlight.llm import mixing
from redlight.llm.bpe import PieceEncoder
from redlight.llm.common import fold
from redlight.llm.queries import tokenizer_path


def corpus():
    rnd = random.Random(21)
    word = lambda: f"word{rnd.randrange(400)}"
    rows, labels = [], []
    for i in range(150):
        toxic = i % 6 == 0
        words = [word() for _ in range(rnd.randrange(5, 60))]
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["vile", "foul", "nasty"]))
        rows.append([i, " ".join(words), "en", rnd.choice(["a", "a", "b", None]), 1])
        labels.append((i, int(toxic), 1))
    passage = " ".join(word() for _ in range(25)) + " naïve"
    base = [word() for _ in range(70)]
    for i in range(150, 170):
        rows.append([i, " ".join(edited(rnd, base, 1)), "en", "b", 1])
    for i in range(170, 190):
        rows.append([i, " ".join(word() for _ in range(40)) + " é" + passage + "ü " + " ".join(word() for _ in range(9)), "en", "a", 1])
    rows += [[200, rows[1][1], "en", "a", 1], [201, None, "en", "b", 0], [202, "", "en", "b", 0], [203, passage, "en", "a", 1], [204, " ".join(word() for _ in range(3000)), "en", None, 1]]
    return [tuple(r) for r in rows], labels


def test_the_run_is_the_plain_one(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    held = {r["doc_id"] for r in docs.where(fold("doc_id", 4) == 2).collect()}
    text = {r[0]: r[1] for r in rows}
    scores = plain_toxicity([(text[i], y) for i, y, _ in labels if i not in held], [r[1] or "" for r in rows])
    kept = [r for r, s in zip(rows, scores) if s < 0.3]
    assert 160 <= len(kept) < len(rows) - 15
    first = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if first[r[0]] == r[0]]
    assert len(kept) < 165
    gone = repeated([(r[0], r[1]) for r in kept], 100)
    cut = []
    for r in kept:
        flags, b = gone.get((r[0], r[1]), []), (r[1] or "").encode()
        flags = list(flags)
        at = 0
        for c in r[1] or "":  # a character that a cut runs through goes whole
            n = len(c.encode())
            if any(flags[at : at + n]):
                flags[at : at + n] = [True] * n
            at += n
        new = bytes(x for x, g in zip(b, flags) if not g).decode() if any(flags) else r[1]
        if not any(flags) or new:
            cut.append((r[0], new, r[3]))
    assert sum(len(t or "") for _, t, _ in cut) < sum(len(r[1] or "") for r in kept) - 1500
    documents = pd.DataFrame(cut, columns=["doc_id", "text", "source"])  # noqa: F841
    assert documents["source"].isna().any()
    mixed = duckdb.sql(mixing.oracle_sql().replace("::BIGINT * size AS taken", "::BIGINT AS copies")).df()
    copies = dict(zip(mixed["doc_id"], mixed["copies"]))
    library = PieceEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for i, t, _ in cut:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            want[i, at, b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048])] += copies[i]
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in out) == +want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert sum(n for _, n in p) <= 2048 and all(at == sum(n for o, n in p if o < at) for at, _ in p)
    total = sum(r["length"] for r in out)
    assert len(places) <= 1.1 * total / 2048 + 1
