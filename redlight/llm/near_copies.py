"""Near copies by exact Jaccard similarity of word shingles: the wide end of :mod:`.simhash`.

Fingerprints and their deletion variants find what differs in a few bits. Those links are
checked on the texts and make the first edges. A similarity of 0.8, though, means about ten
of 64 bits, which no index of segments with one bit out can carry: the rest is found by
prefix filtering. Two sets of similarity ``least`` or more share one of their first
``n - ceil(least n) + 1`` members in any order that is the same for all sets. Rows of those
prefixes meet under the shingle, so no pair is missed (but for equal 64-bit hashes, which
can only add candidates and move a similarity by one shingle). The order puts common
shingles last, by a bounded summary of their counts: a line that very many documents share
then stands in no prefix of a document with enough words of its own. The summary decides
the cost, never the result.

Only components are asked for, so under each shingle everyone is first compared with the
earliest, if no link joins them yet. Pairs that this leaves in different components are
compared in a second step, first as sketches. Equal texts are folded before and are never compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, joined
from ..storage import new_path, scratch, write_table
from . import simhash
from .common import enter, materialize, partitions, utf8
from .shingling import shingle_sets

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: Iterable[bytes], shingle: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of ``shingle`` words of each text (ASCII lower case,
    split at ASCII white space). A shorter text is one run, also one without words."""
    none = np.zeros(1, np.uint64)
    for s in shingle_sets(texts, shingle):
        yield s if len(s) else none


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _fold_counts(h: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal hashes; of those above one the ``most`` largest."""
    h, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, weights=n).astype(np.int64)
    h, n = h[n > 1], n[n > 1]
    if len(h) > most:
        top = np.argpartition(n, len(n) - most)[-most:]
        h, n = h[top], n[top]
    return h, n


def common_shingles(texts: DataFrame, shingle: int, most: int = 65_536, from_count: int = 16) -> np.ndarray:
    """Common shingles, rarest first: each task sends a bounded summary of its counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_copies")
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, size = [], 0
        for b in batches:
            for s in shingles((t.as_py() for t in b.column(0)), shingle):
                held.append(s)
                size += len(held[-1])
                if size >= 1_000_000:
                    h, n = _fold_counts(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]), most)
                    held, size = [], 0
        h, n = _fold_counts(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]), most)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = texts.select("t").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= from_count)
    found = counts.orderBy(F.desc("n"), "h").limit(most).toPandas()
    return found["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def prefixes(texts: DataFrame, shingle: int, least: float, common: np.ndarray) -> DataFrame:
    """``h, id, n, pos``: the shingles of each text's prefix, its size and their places."""
    order = np.argsort(common)
    known = common[order]
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_copies")
        for b in batches:
            row, h, n, pos = [], [], [], []
            for i, s in enumerate(shingles((t.as_py() for t in b.column(1)), shingle)):
                p = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    s = np.concatenate([s[~hit], common[np.sort(order[at[hit]])]])
                row.append(np.full(p, i))
                h.append(s[:p])
                n.append(np.full(p, len(s), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if row:
                ids = b.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), ids, pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["h", "id", "n", "pos"])

    return texts.select("id", "t").mapInArrow(work, f"h long, id {kind}, n int, pos int")


def _possible(a: str, b: str, least: float):
    """Whether sizes and places let this be the first common shingle of two alike sets."""
    need = (F.col(f"{a}n") + F.col(f"{b}n")) * (least / (1 + least)) - 1e-6
    return F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos")) >= need


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs ``a, b`` those that are alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_copies")
        last, seen = None, None
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                if (y := y.as_py()) != last:
                    last, seen = y, next(shingles([y], shingle))
                ok.append(_similar(next(shingles([x.as_py()], shingle)), seen, least))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    kind = texts.schema["id"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(work, f"a {kind}, b {kind}"), "alike")


def candidates(index: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows that share their shingle, with its earliest row as ``lead``; pairs with it."""
    rows = index.repartition(partitions(index.sparkSession), "h")
    lead = rows.groupBy("h").agg(F.min(F.struct("id", "n", "pos")).alias("lead"), F.count("*").alias("many")).where("many > 1")
    shared = materialize(rows.join(lead, "h").select("h", "id", "n", "pos", F.col("lead.id").alias("l_id"), F.col("lead.n").alias("l_n"), F.col("lead.pos").alias("l_pos"), "many"), "shared")
    stars = shared.where("id <> l_id").where(_possible("", "l_", least)).select(F.col("id").alias("a"), F.col("l_id").alias("b")).distinct()
    return shared, stars


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's members by 10 bits of their hash: two sketches differ in at most as
    many bits as the sets do in members."""
    return np.packbits(np.bincount(((s * _MIX) >> np.uint64(54)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).tobytes()


#: Rows of one shingle that a task holds at once.
HELD = 4096


def _near(least: float, best: bool):
    """Over rows ``h, part, kind, id, n, pos, root, main, s``, sorted by the first three: pairs
    of a row of kind 0 with one of kind 1 that may be alike, by size, place and sketch; with
    ``best`` only the nearest for each component of kind 0."""

    def meet(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
        ia, na, pa_, ra, _, sa = a
        ib, nb, pb, rb, mb, sb = b
        found = []
        step = max(1, 2_000_000 // max(len(ib), 1) // 16)
        for i in range(0, len(ia), step):
            j = slice(i, i + step)
            both = na[j, None] + nb[None]
            ok = (ra[j, None] != rb[None]) & (mb[None] | (ia[j, None] < ib[None]))
            ok &= np.minimum((na - pa_)[j, None], (nb - pb)[None]) >= both * (least / (1 + least)) - 1e-6
            r, c = np.nonzero(ok)
            for k in range(0, len(r), 500_000):
                x, y = r[k : k + 500_000], c[k : k + 500_000]
                apart = np.bitwise_count(sa[j][x] ^ sb[y]).sum(1)
                apart = apart / both[x, y]
                near = apart <= (1 - least) / (1 + least) + 1e-9
                found.append((ia[j][x[near]], ib[y[near]], ra[j][x[near]], apart[near]))
        if not found:
            return ia[:0], ia[:0]
        x, y, root, apart = (np.concatenate(v) for v in zip(*found))
        if best:
            order = np.lexsort((y, x, apart, root))
            first = order[np.concatenate([[True], root[order][1:] != root[order][:-1]])] if len(order) else order
            x, y = x[first], y[first]
        return x, y

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_copies")
        last, held = None, None
        for b in batches:
            h, part, kind = (b.column(i).to_numpy() for i in range(3))
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8)]
            cols.append(np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(-1, 16))
            edges = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, e in zip([0, *edges], [*edges, len(h)]):
                if i == e:
                    continue
                now, mine = (h[i], part[i]), [c[i:e] for c in cols]
                if kind[i] == 0:
                    held = [np.concatenate(x) for x in zip(held, mine)] if now == last and held is not None else mine
                    last = now
                elif now == last:
                    x, y = meet(held, mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return work


def _drawn(shared: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``id, s``: sketches of the texts that may have a pair left."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_copies")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(s) for s in shingles((t.as_py() for t in b.column(1)), shingle)], pa.binary())], names=["id", "s"])

    return materialize(texts.join(shared.where("many > 2").select("id").distinct(), "id").select("id", "t").mapInArrow(draw, "id long, s binary"), "sketches")


def _left_over(shared: DataFrame, drawn: DataFrame, roots: DataFrame, least: float, best: bool) -> DataFrame:
    """Pairs under one shingle in different components that may be alike, but for those with
    its earliest. Only shingles with a row outside the earliest one's component have any. All
    such pairs are looked at, as sketches in a task; of a shingle with very many rows, part of
    those outside in each of several tasks. Rows come out for the few that sketches let pass,
    with ``best`` for the nearest of them only."""
    named = roots.select(F.col("node").alias("id"), "root")
    rows = shared.where("many > 2").join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lead = named.select(F.col("id").alias("l_id"), F.col("root").alias("l_root"))
    rows = rows.join(lead, "l_id", "left").withColumn("l_root", F.coalesce("l_root", "l_id"))
    rows = materialize(rows.where("id <> l_id").select("h", "id", "n", "pos", "root", (F.col("root") == F.col("l_root")).alias("main")), "rooted")
    parts = rows.groupBy("h").agg(F.count_if(~F.col("main")).alias("outside"), F.count("*").alias("all")).where("outside > 0 and all > 1").select("h", F.ceil(F.col("outside") / HELD).cast("int").alias("parts"))
    rows = materialize(rows.join(parts, "h"), "outside")
    own = F.array(F.when(~F.col("main"), F.struct(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"))))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), F.lit(1).alias("kind")))
    dealt = rows.withColumn("at", F.explode(F.concat(F.array_compact(own), every))).join(drawn, "id")
    dealt = dealt.select("h", "at.part", "at.kind", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "root", "main", "s")
    dealt = dealt.repartition(partitions(shared.sparkSession), "h", "part").sortWithinPartitions("h", "part", "kind")
    return dealt.mapInArrow(_near(least, best), "a long, b long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``text_key, first``: for each distinct text (``text_key``: the MD5 of its UTF-8) the
    first document that links of similarity ``least`` reach, as ``doc_id, text_key``: that
    with the smallest id, of equal ids with the smallest key; null ids come last.

    A null text counts as empty, and empty texts are equal. Long texts are compared whole.
    Only ``doc_id`` and ``text`` are read, so no name can clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    at = new_path(spark, "near-copies")
    with scratch(spark):
        return write_table(_near_copies(docs, shingle, least), at)


def _near_copies(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    text = utf8("text")
    rows = docs.select(F.md5(text).alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")).alias("f"), text.alias("t"))
    # Own numbers, as ids may be null or repeat.
    texts = materialize(rows.groupBy("k").agg(F.min("f").alias("f"), F.any_value("t").alias("t")).withColumn("id", F.monotonically_increasing_id()), "texts")
    close = simhash.near_duplicates(texts.select("id", F.col("t").cast("string").alias("text")), "id", "text", shingle)
    checked = _verified(close.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), texts, shingle, least)
    shared, stars = candidates(prefixes(texts, shingle, least, common_shingles(texts, shingle)), least)
    of = lambda c: checked.select(F.col("a").alias(c), F.col("b").alias(f"{c}_root"))
    far = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    edges = checked.unionByName(_verified(far, texts, shingle, least))
    roots, drawn = components(edges), _drawn(shared, texts, shingle)
    # Components join their nearest ones first, as these are many in a large group; what then
    # is left is looked at in full.
    for best in (True, True, False):
        at = new_path(docs.sparkSession, "roots")
        with scratch(docs.sparkSession):
            more = _verified(_left_over(shared, drawn, roots, least, best), texts, shingle, least)
            if not more.isEmpty():
                roots = write_table(joined(roots, more), at)
    names = texts.select("k", "id", F.struct("f.none", "f.doc_id", "k").alias("f")).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # A table of its own, so that Spark can split a component with very many texts below.
    firsts = materialize(names.groupBy("root").agg(F.min("f").alias("f")), "firsts")
    return names.drop("f").join(firsts, "root").select(F.col("k").alias("text_key"), F.struct("f.doc_id", F.col("f.k").alias("text_key")).alias("first"))
