"""Importance resampling towards a target distribution, drawn by distributed quickselect.

Hashed word features are counted over the whole corpus and the whole target; an array with
one gain for each bucket scores every document. A Gumbel term made from the document's id
turns the best scores into a draw without replacement, and who is drawn is found without a
sort of all rows: random pivot keys, exact counts of the rows before, at and after each, and
on with the stretch that holds the k-th key. Only the winners are sorted and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.identity import numbered
from ..storage import discard, new_path, write_table
from .common import enter, materialize, utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words once A-Z are lower: digits, a-z, and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, length: np.ndarray, long: int = 96) -> np.ndarray:
    """CRC-32 of many slices of ``data`` at once, one byte of each a step; slices of more than
    ``long`` bytes one by one."""
    order = np.argsort(-np.minimum(length, long + 1).astype(np.int16), kind="stable")
    s, n = start[order], length[order]
    tail = int(np.searchsorted(-n, -long, "left"))
    c = np.full(len(s), 0xFFFFFFFF, np.uint32)
    ends = np.searchsorted(-n[tail:], -np.arange(int(n[tail]) if tail < len(n) else 0), "left") + tail
    for k, m in enumerate(ends):
        at = c[tail:m]
        c[tail:m] = _CRC[(at ^ data[s[tail:m] + k]) & 0xFF] ^ (at >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    c[:tail] = [crc32(data[a : a + b].tobytes()) for a, b in zip(s[:tail], n[:tail])]
    out = np.empty_like(c)
    out[order] = c
    return out


def features(data: np.ndarray, begin: np.ndarray, runs: int, buckets: int, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, bucket`` of every run of 1 to ``runs`` words, and the owners of the words.

    ``data`` is text with A-Z lowered, ``begin`` where each document starts in it (after a byte
    that is in no word). Of the first ``known`` words only runs that go on beyond them count.
    """
    w = _WORD[data]
    edge = np.diff(np.concatenate([[False], w, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, start, "right") - 1
    if runs > 1:  # words joined by one space
        word = np.repeat(np.arange(len(start)), end - start)
        packed = np.full(len(word) + len(start), 32, np.uint8)
        packed[np.arange(len(word)) + word] = data[w]
        length = end - start
        start = np.cumsum(length + 1) - length - 1
        data, end = packed, start + length
    owners, found = [], []
    for k in range(1, runs + 1):
        n = max(0, len(start) - k + 1)
        ok = owner[:n] == owner[k - 1 : k - 1 + n]
        ok[: max(0, known - k + 1)] = False
        a = start[:n][ok]
        owners.append(owner[:n][ok])
        found.append(crc32s(data, a, end[k - 1 : k - 1 + n][ok] - a) % np.uint32(buckets))
    return np.concatenate(owners), np.concatenate(found), owner[known:]


def _parts(texts: Iterator[bytes], runs: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, starts, first document, known words) of about ``most`` bytes: several short
    texts, or a part of a long one, cut between words; it starts with words already told."""
    held, size, first, i = [], 0, 0, -1

    def joined():
        begin = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        return _LOWER[np.frombuffer(b" ".join(held), np.uint8)], begin, first, 0

    for i, t in enumerate(texts):
        if size + len(t) > most and held:
            yield joined()
            held, size, first = [], 0, i
        if len(t) <= most:
            held.append(t)
            size += len(t)
            continue
        d, at, known = _LOWER[np.frombuffer(t, np.uint8)], 0, 0
        while at < len(d):
            cut = at + most
            while cut < len(d) and _WORD[d[cut]]:
                cut += 1
            cut, back = min(cut, len(d)), at
            for _ in range(runs - 1):  # back over one word more
                while back > 0 and not _WORD[d[back - 1]]:
                    back -= 1
                while back > 0 and _WORD[d[back - 1]]:
                    back -= 1
            known = int((np.diff(np.concatenate([[False], _WORD[d[back:at]]]).astype(np.int8)) == 1).sum())
            yield d[back:cut], np.zeros(1, np.int64), i, known
            at = cut
        first = i + 1
    if held:
        yield joined()


def bucket_counts(texts: DataFrame, runs: int, buckets: int, part: int = 1 << 22) -> np.ndarray:
    """Features in each bucket over all texts ``t``: each task sends one row for a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for data, begin, _, known in _parts((t.as_py() for t in b.column(0)), runs, part):
                n += np.bincount(features(data, begin, runs, buckets, known)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("t").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of frequencies, for every bucket."""
    s, t, n = docs.astype(float), target.astype(float), len(docs)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int, part: int = 1 << 22) -> DataFrame:
    """``doc_id, n_words, n_features, weight``, and ``x``, a hash of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        for b in batches:
            size = b.num_rows
            n_words, n, total = (np.zeros(size, np.int64) for _ in range(3))
            for data, begin, first, known in _parts((t.as_py() for t in b.column(2)), runs, part):
                owner, bucket, words = features(data, begin, runs, len(gain), known)
                here = slice(first, first + len(begin))
                n_words[here] += np.bincount(words, minlength=len(begin))
                n[here] += np.bincount(owner, minlength=len(begin))
                total[here] += np.bincount(owner, weights=gain[bucket], minlength=len(begin)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words), pa.array(n), pa.array(total)], names=["doc_id", "x", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("x"), utf8("text").alias("t"))
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, key: str, uid: str, k: int, n: int, pivots: int = 24) -> Column:
    """The ``k``-th smallest ``key`` (a struct, all different) of ``n`` rows, as a literal.

    Each round draws about ``pivots`` random keys, counts exactly how many rows lie between and
    at them, and goes on with the stretch that holds the k-th, written as a table of its own.
    What reaches the driver are the pivots and their counts, whatever ``n``.
    """
    spark, kind, scratch, turn = rows.sparkSession, rows.schema[key].dataType, None, 0
    literal = lambda row: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, row)))
    try:
        while True:
            turn += 1
            drawn = rows if n <= pivots else rows.where(F.xxhash64(uid, F.lit(turn)) < int(-(2**63) + 2**64 * pivots / n))
            found = [literal(r[key]) for r in drawn.select(key).orderBy(key).collect()]
            if not found:
                continue
            # Even slots lie between pivots, odd ones are pivots.
            slot = sum(((F.col(key) >= p).cast("int") + (F.col(key) > p).cast("int") for p in found), F.lit(0))
            count = {r["slot"]: r["n"] for r in rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
            for s in range(2 * len(found) + 1):
                if k <= count.get(s, 0):
                    break
                k -= count.get(s, 0)
            if s % 2:
                return found[s // 2]
            n = count[s]
            inside = F.lit(True)
            if s:
                inside = inside & (F.col(key) > found[s // 2 - 1])
            if s // 2 < len(found):
                inside = inside & (F.col(key) < found[s // 2])
            before, scratch = scratch, new_path(spark, "select")
            rows = write_table(rows.where(inside), scratch)
            if before:
                discard(spark, before)
    finally:
        if scratch:
            discard(spark, scratch)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lowered) and all other non-ASCII characters;
    features are all runs of 1 to ``runs`` words. Of the rows with ``least_words`` words the
    ``percent`` per cent with the highest scores are drawn and ranked from 1 on, the others
    have no rank. Ties go to the smaller doc_id, null last; of rows with equal id and score to
    the smaller hash of the text, and equal rows are interchangeable.

    Null and empty texts have no features: weight 0, never drawn. Long texts count whole, in
    parts of 4 MB. A null doc_id draws as an empty one. An empty ``docs`` gives no rows, and an
    empty target only smoothing. Only ``doc_id`` and ``text`` are read, so no name can clash.
    """
    gain = gains(bucket_counts(docs.select(utf8("text").alias("t")), runs, buckets), bucket_counts(target.select(utf8("text").alias("t")), runs, buckets))
    scored = weights(docs, gain, runs).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    order = {"back": -F.col("score"), "none": F.col("doc_id").isNull(), "id": F.col("doc_id"), "x": F.col("x"), "uid": F.col("uid")}
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    fit = scored.where(F.col("n_words") >= least_words).select("uid", F.struct(*(v.alias(c) for c, v in order.items())).alias("key"))
    n = fit.count()
    k = percent * n // 100
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(fit, "key", "uid", k, n)
    won = (F.col("n_words") >= least_words) & (F.struct(*(v.alias(c) for c, v in order.items())) <= last)
    winners = scored.where(won).withColumns({c: v for c, v in order.items() if c not in ("x", "uid")})
    ranked = numbered(winners, list(order), "rank").select(*out, F.col("rank").cast("long").alias("rank"))
    return scored.where(~won).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


#: CRC-32 from its polynomial, byte by byte over the hexadecimal digits of each distinct word.
ORACLE_SQL = r"""
WITH bit0 AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c FROM range(256) t(i)),
b1 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM bit0),
b2 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b1),
b3 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b2),
b4 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b3),
b5 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b4),
b6 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b5),
b7 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b6),
b8 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END AS c FROM b7),
crc AS (SELECT list(c ORDER BY i) AS t FROM b8),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
gw AS (SELECT unnest(w) AS w FROM g),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
buckets AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::UBIGINT)), lambda a, y: xor(t[(xor(a, y) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 10000)::BIGINT AS b FROM words, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM gw JOIN buckets USING (w) GROUP BY b),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b),
wt AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN gain USING (b) GROUP BY r),
h AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE AS h FROM d),
z AS (SELECT doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))))::BIGINT AS score FROM h LEFT JOIN wt USING (r)),
q AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM q WHERE n_features >= 20) // 100 THEN place END::BIGINT AS rank FROM q"""
