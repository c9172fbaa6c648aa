"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints link at ``k`` or fewer differing bits. They are cut into ``k // 2 + 1``
segments: were every segment to differ by two bits, more than ``k`` would, so one segment
differs by one bit at most. Each segment is indexed as it is and once with each of its bits
masked out; equal keys meet in one sort, and every candidate is verified on whole
fingerprints. Only distinct fingerprints are indexed, copies join afterwards.

A key that more than ``run_limit`` fingerprints share is not worked on in one task: its
members are indexed again, with variants of the other bits added to the key, until no key
is shared by more (each step fixes more bits, so this ends).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import enter, materialize, partitions, utf8

BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one text: ASCII lower case, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65_536):
        part = h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long. Null text counts as empty: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _cuts(width: int, k: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of ``width`` bits for up to ``k`` differences."""
    s = min(k // 2 + 1, width)
    edges = [round(i * width / s) for i in range(s + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def variant_keys(fp: Column, shift: int, width: int, k: int) -> list[tuple[Column, Column]]:
    """(place, value) of every key of a fingerprint: segments whole and with one bit out."""
    out = []
    for at, w in _cuts(width, k):
        seg = F.shiftrightunsigned(fp, shift + at).bitwiseAND(F.lit(_signed((1 << w) - 1)))
        base = (shift + at) * 128
        out.append((F.lit(base + 127), seg))
        out += [(F.lit(base + p), seg.bitwiseAND(F.lit(_signed(((1 << w) - 1) & ~(1 << p))))) for p in range(w)] if k else []
    return out


def _star(f: np.ndarray, k: int, bit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within one key; with ``bit``, across that bit."""
    n = len(f)
    label = np.arange(n)
    rows = max(1, 4_000_000 // n)
    near = []
    for i in range(0, n, rows):
        x = f[i : i + rows, None] ^ f[None, :]
        ok = np.bitwise_count(x) <= k
        if bit is not None:
            ok &= (x >> np.uint64(bit)) & np.uint64(1) == 1
        r, c = np.nonzero(ok)
        keep = r + i < c
        near.append((r[keep] + i, c[keep]))
    a, b = (np.concatenate(x) for x in zip(*near))
    if not len(a):
        return f[:0], f[:0]
    while True:  # smallest label along the links, with short cuts
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (old == label).all():
            break
    other = np.flatnonzero(label != np.arange(n))
    return f[other], f[label[other]]


def _match(index: DataFrame, k: int, run_limit: int) -> DataFrame:
    """``a, b`` to be joined; rows with ``more`` carry (key, fp) of keys with too many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, place, more):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)), pa.array(np.full(len(a), place, np.int32)), pa.array(np.full(len(a), more, bool))], names=["a", "b", "place", "more"])

        def runs(place, key, fp, last: bool):
            """Work on all runs (but the last unless it is complete); return the rest."""
            new = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(key)]])
            many = ends - starts >= 2
            if not last:
                many[-1] = False
            found = []
            for s, e in zip(starts[many], ends[many]):
                p = int(place[s])
                if e - s > run_limit:
                    found.append((key[s:e].view(np.uint64), fp[s:e], p, True))
                    continue
                bit = p % 128
                a, b = _star(fp[s:e], k, None if bit == 127 else p // 128 + bit)
                if len(a):
                    found.append((a, b, p, False))
            return found, starts[-1]

        held, over = None, None
        for b in batches:
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            part[2] = part[2].view(np.uint64)
            if over is not None:  # the rest of a key that is known to have too many
                more = (part[0] == over[0]) & (part[1] == over[1])
                if more.any():
                    yield out(part[1][more].view(np.uint64), part[2][more], over[0], True)
                    part = [x[~more] for x in part]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            held = None
            if not len(part[0]):
                continue
            over = None
            found, rest = runs(*part, last=False)
            for x in found:
                yield out(*x)
            held = [x[rest:] for x in part]
            if len(held[0]) > run_limit:
                over = (int(held[0][0]), int(held[1][0]))
                yield out(held[1].view(np.uint64), held[2], over[0], True)
                held = None
        if held is not None:
            for x in runs(*held, last=True)[0]:
                yield out(*x)

    return index.mapInArrow(work, "a long, b long, place int, more boolean")


def _index(df: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    n = partitions(df.sparkSession)
    every = F.array(*(F.struct(p.cast("int").alias("place"), v.alias("key")) for p, v in keys))
    # Fingerprints are short, their variants many: the small table is spread out before.
    return (
        df.select("fp").repartition(n).select("fp", F.explode(every).alias("v")).select("v.place", "v.key", "fp")
        .repartition(n, "place", "key").sortWithinPartitions("place", "key", "fp")
    )


def links(distinct: DataFrame, k: int = 2, run_limit: int = 4096) -> DataFrame:
    """Edges ``a, b`` over distinct ``fp`` whose components are those of all links."""
    found = materialize(_match(_index(distinct, variant_keys(F.col("fp"), 0, BITS, k)), k, run_limit), "links")
    edges = found.where(~F.col("more")).select("a", "b")
    for width in (16, 8, 4):
        # A key with too many members: split it by variants of the bits it leaves open.
        rest = found.where("more").select(F.col("b").alias("fp"), "place", F.col("a").alias("key")).distinct()
        if rest.isEmpty():
            break
        sub = rest.withColumn("v", F.explode(F.transform(F.lit(_open_masks(width, k)), lambda m, i: F.struct(i.alias("p"), F.col("fp").bitwiseAND(m).alias("v")))))
        sub = sub.select(F.xxhash64("place", "key", "v.p", "v.v").alias("key"), "fp").withColumn("place", F.lit(127))
        n = partitions(distinct.sparkSession)
        last = width == 4
        sub = sub.select("place", "key", "fp").repartition(n, "key").sortWithinPartitions("place", "key", "fp")
        found = materialize(_match(sub, k, 1 << 30 if last else run_limit), "links")
        edges = edges.unionByName(found.where(~F.col("more")).select("a", "b"))
    return edges


def _open_masks(width: int, k: int) -> list[int]:
    """All 64 bits but ``width`` of them, in blocks of that width; any ``k`` differences lie
    within ``k`` blocks, so the masks leave out every choice of ``k`` blocks."""
    n = BITS // width
    block = lambda b: ((1 << width) - 1) << (b * width)
    return [_signed(sum(block(b) for b in range(n) if b not in gone)) for gone in combinations(range(n), min(k, n))]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2, run_limit: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, fp (long), component_id``.

    ``component_id`` is the smallest id that links reach, the own one included. A null or
    empty text has fingerprint 0 and is linked like any other; long texts are read whole, in
    parts of 65,536 shingles. Null ids are passed on and never name a component unless it has
    no other id. Repeated rows each get their row. Other columns are not read, so no name can
    clash; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps-distinct")
    roots = components(links(distinct.select("fp"), k, run_limit)).withColumnRenamed("node", "fp")
    mine = distinct.join(roots, "fp")
    least = mine.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = mine.join(least, "root").select("fp", F.col("least_id"))
    # A table of its own, so that Spark can split a fingerprint with very many documents below.
    named = materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
