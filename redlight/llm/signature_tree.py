"""N-gram Jaccard join by signature trees.

Sets of word shingles carry a bitmap of their members. A tree node holds the OR of the bitmaps
below it, the range of their sizes, and by how much members may outnumber bits. Two nodes can
hold a pair alike only if the bits they share, and those members, reach the least overlap that
the sizes ask for: a dual traversal goes down only where they do, and not where all below both
nodes lies in one component already.

One tree over a whole corpus would have upper nodes with every bit set, and one task to build
it. So trees are a forest: alike sets share one of their first ``n - ceil(least n) + 1``
members in any common order (common shingles last), hence there is a tree for each such
shingle, and no pair is missed.

1. Every set goes to the tree of its rarest shared shingle, with its text. Traversal and exact
   check run in the task; sets that are joined are not compared again.
2. Trees of all shared shingles whose sets lie in several components, over bitmaps alone. They
   first give the nearest pair of each component, then every pair that is left, and pairs are
   checked on the texts. Very large trees are dealt out by blocks of what lies
   outside their largest component.

Equal sets are folded before. Shingles are known by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components, joined
from ..storage import discard, new_path, scratch, write_table
from .common import enter, materialize, partitions, utf8
from .near_copies import common_shingles
from .shingling import shingle_set, shingle_sets

BITS = 1024
FAN = 8
#: Sets of one tree that a task holds at once: with texts, and as bitmaps.
WITH_TEXT = 512
HELD = 4096
#: Rows up to which a side is broadcast (two longs each).
SMALL = 1_000_000


def bitmap(s: np.ndarray) -> np.ndarray:
    """The bits of a set, as 64-bit words; hashes are mixed, as sets are sorted by them."""
    on = np.zeros(BITS, np.uint8)
    on[((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(on).view(np.uint64)


class Tree:
    """A signature tree over sets in the given order: levels from the sets to at most ``FAN`` nodes.

    ``room`` bounds the members that a set can share with another (those from its place in the
    tree's shingle on); ``root`` is the component.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, room: np.ndarray, root: np.ndarray):
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1).astype(np.int64), room, root)]
        while len(self.levels[-1][1]) > FAN:
            b, lo, hi, extra, room, root = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            one = np.minimum.reduceat(root, at)
            one = np.where(one == np.maximum.reduceat(root, at), one, -1)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at), np.maximum.reduceat(room, at), one))


def traverse(a: Tree, b: Tree, percent: int, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets, one of each tree (each once if they are the same), that may be alike, with
    their number of shared bits. Goes down both trees at once, at most ``most`` node pairs a step."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[la][1])), np.arange(len(b.levels[lb][1])), indexing="ij"))
    stack = [(la, lb, i, j)]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > most:
            stack.append((la, lb, i[most:], j[most:]))
            i, j = i[:most], j[:most]
        (ab, alo, ahi, ax, ar, ac), (bb, blo, bhi, bx, br, bc) = a.levels[la], b.levels[lb]
        if a is b:
            ok = i < j if la == 0 else i <= j
            i, j = i[ok], j[ok]
        need = percent * (alo[i] + blo[j])
        ok = (100 * ahi[i] >= percent * blo[j]) & (100 * bhi[j] >= percent * alo[i]) & ((100 + percent) * np.minimum(ar[i], br[j]) >= need)
        ok &= (ac[i] != bc[j]) | (ac[i] < 0)
        i, j, need = i[ok], j[ok], need[ok]
        shared = np.bitwise_count(ab[i] & bb[j]).sum(1).astype(np.int64)
        ok = (100 + percent) * (shared + np.minimum(ax[i], bx[j])) >= need
        i, j, shared = i[ok], j[ok], shared[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j, shared
            continue
        for x, level, tree in ((0, la, a), (1, lb, b)):
            if level and (level >= (lb if x == 0 else la)):
                kids = np.arange(FAN)
                v, o = (i, j) if x == 0 else (j, i)
                v, o = (v[:, None] * FAN + kids).ravel(), np.repeat(o, FAN)
                ok = v < len(tree.levels[level - 1][1])
                i, j = (v[ok], o[ok]) if x == 0 else (o[ok], v[ok])
                if x == 0:
                    la -= 1
                else:
                    lb -= 1
        stack.append((la, lb, i, j))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that join all alike sets, by a tree over them and an exact check."""
    n = np.array([len(s) for s in sets], np.int64)
    tree = Tree(np.stack([bitmap(s) for s in sets]), n, n, np.arange(len(sets)))
    top, found = list(range(len(sets))), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, j, _ in traverse(tree, tree, percent):
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = root(x), root(y)
            if p != q and alike(sets[x], sets[y], percent):
                top[max(p, q)] = min(p, q)
                found.append((x, y))
    return found


def named_sets(docs: DataFrame, shingle: int, percent: int, common: np.ndarray) -> DataFrame:
    """``doc_id, m, k1, k2, n, rare, prefix``: a hash of the text, the name and size of its set,
    and the members of its prefix, rarest first; the first ``rare`` are not ``common``."""
    order = np.argsort(common)
    known = common[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("signature_tree")
        for b in batches:
            names, n, rare, prefix = [], [], [], []
            for s in shingle_sets((t.as_py() for t in b.column(2)), shingle):
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                hit = np.zeros(len(s), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    s = np.concatenate([s[~hit], common[np.sort(order[at[hit]])]])
                n.append(len(s))
                rare.append(min(p, len(s) - int(hit.sum())))
                prefix.append(s[:p].view(np.int64))
            k = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(n, pa.int32()), pa.array(rare, pa.int32()), lists], names=["doc_id", "m", "k1", "k2", "n", "rare", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("t").alias("m"), "t").mapInArrow(work, f"doc_id {kind}, m long, k1 long, k2 long, n int, rare int, prefix array<long>")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """``h, id, n, room`` of prefix members that may stand in another prefix too: common ones as
    they are, of the others those that do. Only the latter meet in a task by their shingle; how
    often they occur is bounded by what the summary of common ones leaves out."""
    rows = sets.select("id", "n", "rare", F.posexplode("prefix").alias("pos", "h")).withColumn("room", F.col("n") - F.col("pos"))
    many = F.count("*").over(Window.partitionBy("h"))
    rare = rows.where("pos < rare").select("h", "id", "n", "room").withColumn("many", many).where("many > 1").drop("many")
    return materialize(rare.unionByName(rows.where("pos >= rare").select("h", "id", "n", "room")), "shared")


def with_texts(docs: DataFrame, sets: DataFrame, shared: DataFrame) -> DataFrame:
    """``id, g, part, n, t``: the sets that share a shingle, the rarest of these, and a text of
    theirs, a few times for a set with many copies."""
    first = shared.groupBy("id").agg(F.min_by("h", -F.col("room")).alias("g"))
    wanted = materialize(sets.select("id", "m", "n").join(first, "id"), "wanted")
    parts = wanted.groupBy("g").agg(F.ceil(F.count("*") / (8 * WITH_TEXT)).cast("int").alias("parts")).where("parts > 1")
    wanted = wanted.join(parts, "g", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    few = wanted.limit(SMALL + 1).count() <= SMALL
    found = docs.select(F.xxhash64("t").alias("m"), "t").join(F.broadcast(wanted) if few else wanted, "m").select("id", "g", "part", "n", "t")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal texts the first of each task: copies never meet in numbers."""
        enter("signature_tree")
        seen: set[int] = set()
        for b in batches:
            new = []
            for k, i in enumerate(b.column(0).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    new.append(k)
            if len(seen) > SMALL:
                seen.clear()
            yield b.take(pa.array(new, pa.int64()))

    return materialize(found.mapInArrow(once, found.schema), "set-texts")


def _tasks(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b``: links within the trees of rarest shared shingles; ``a, s``: every set's bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("signature_tree")
        now, ids, sets, size, pairs = None, [], [], 0, []

        def close() -> list[tuple[int, int]]:
            found = link(sets, percent) if len(ids) > 1 else []
            return [(max(ids[x], ids[y]), min(ids[x], ids[y])) for x, y in found]

        for b in batches:
            own, bits = [], []
            for g, part, i, s in zip(*(b.column(k).to_pylist() for k in range(3)), shingle_sets((t.as_py() for t in b.column(3)), shingle)):
                if ids and i == ids[-1]:  # another copy
                    continue
                if (g, part) != now or len(ids) >= WITH_TEXT or size > 1 << 22:
                    pairs += close()
                    now, ids, sets, size = (g, part), [], [], 0
                ids.append(i)
                sets.append(s)
                size += len(s)
                own.append(i)
                bits.append(bitmap(s).tobytes())
            yield told(pairs, own, bits)
            pairs = []
        yield told(pairs + close(), [], [])

    def told(pairs: list, ids: list, bits: list) -> pa.RecordBatch:
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array([*a, *ids], pa.int64()), pa.array([*b, *[None] * len(ids)], pa.int64()), pa.array([*[None] * len(a), *bits], pa.binary())], names=["a", "b", "s"])

    dealt = texts.select("g", "part", "n", "id", "t").repartition(partitions(texts.sparkSession), "g", "part").sortWithinPartitions("g", "part", "n", "id")
    return materialize(dealt.select("g", "part", "id", "t").mapInArrow(work, "a long, b long, s binary"), "linked")


def _small(cols: list[np.ndarray], at: np.ndarray, percent: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """What :func:`traverse` tells of many trees of so few sets that they have one level: rows
    ``from, to`` of kind 0, then of kind 1, for each in ``at``. Yields the pairs' rows, shared
    bits and tree; about ``most`` pairs a step."""
    ids, n, room, root, bits = cols
    extra = n - np.bitwise_count(bits).sum(1).astype(np.int64)
    size = (at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2])
    step = np.cumsum(size) // most
    for first, last in zip(np.searchsorted(step, np.unique(step)), np.searchsorted(step, np.unique(step), "right")):
        a, c = at[first:last], size[first:last]
        tree = np.repeat(np.arange(first, last), c)
        k = np.arange(len(tree)) - np.repeat(np.cumsum(c) - c, c)
        wide = np.repeat(a[:, 3] - a[:, 2], c)
        i, j = np.repeat(a[:, 0], c) + k // wide, np.repeat(a[:, 2], c) + k % wide
        need = percent * (n[i] + n[j])
        ok = (root[i] != root[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i]) & ((100 + percent) * np.minimum(room[i], room[j]) >= need)
        i, j, need, tree = i[ok], j[ok], need[ok], tree[ok]
        shared = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
        ok = (100 + percent) * (shared + np.minimum(extra[i], extra[j])) >= need
        yield i[ok], j[ok], shared[ok], tree[ok]


def _side_by_side(h: np.ndarray, part: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From and to of each stretch of rows of one tree and kind, and the stretches of kind 0 with
    that of kind 1 behind them that are few rows, and whole in this batch."""
    edges = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
    start, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(h)]])
    pair = (kind[start[:-1]] == 0) & (kind[start[1:]] == 1) & (h[start[:-1]] == h[start[1:]]) & (part[start[:-1]] == part[start[1:]])
    few = pair & ((end - start)[:-1] * (end - start)[1:] <= 4 * FAN * FAN) & (start[:-1] > 0) & (end[1:] < len(h))
    return np.flatnonzero(few), start, end


def _meet(percent: int, best: bool):
    """Over rows ``h, part, kind, id, n, room, root, s``, sorted by the first three and root and
    size: pairs of a set of kind 0 with one of kind 1 that may be alike, with ``best`` only the
    nearest for each component of kind 0. Kind 0 is held, kind 1 streams by."""

    def nearest(tree, x, y, near, of) -> tuple[np.ndarray, ...]:
        order = np.lexsort((y, x, -near, of, tree))
        new = (of[order][1:] != of[order][:-1]) | (tree[order][1:] != tree[order][:-1])
        first = order[np.concatenate([np.ones(min(1, len(order)), bool), new])]
        return tuple(v[first] for v in (tree, x, y, near, of))

    def large(held: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        found = []
        for i, j, shared in traverse(Tree(held[4], held[1], held[2], held[3]), Tree(b[4], b[1], b[2], b[3]), percent):
            found.append((np.zeros(len(i), np.int64), held[0][i], b[0][j], shared / (held[1][i] + b[1][j]), held[3][i]))
            if best and len(found) > 1:
                found = [nearest(*(np.concatenate(v) for v in zip(*found)))]
        return tuple(np.concatenate(v) for v in zip(*found)) if found else ()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("signature_tree")
        last, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            h, part, kind = (b.column(i).to_numpy() for i in range(3))
            cols = [b.column(i).to_numpy() for i in range(3, 7)]
            cols.append(np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            at, start, end = _side_by_side(h, part, kind)
            out = []
            for i, j, shared, tree in _small(cols, np.stack([start[at], end[at], start[at + 1], end[at + 1]], 1), percent):
                found = (tree, cols[0][i], cols[0][j], shared / (cols[1][i] + cols[1][j]), cols[3][i])
                out.append(nearest(*found) if best else found)
            done = np.zeros(len(start), bool)
            done[at] = done[at + 1] = True
            for k in np.flatnonzero(~done):
                i, e = start[k], end[k]
                now, mine = (h[i], part[i]), [c[i:e] for c in cols]
                if kind[i] == 0:
                    held = [np.concatenate(x) for x in zip(held, mine)] if now == last and held is not None else mine
                    last = now
                elif now == last and (found := large(held, mine)):
                    out.append(nearest(*found) if best else found)
            if out:
                x, y = (np.concatenate([o[k] for o in out]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return work


def _unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``h, id, n, room`` the rows of trees whose sets lie in several components, with their
    ``root``, the tree's largest (``main``), and by how many tasks the others are dealt out."""
    rows = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = rows.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("roots"), F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", "c").alias("main"))
    trees = size.where("roots > 1").select("h", "main", F.ceil((F.col("all") - F.col("most")) / HELD).cast("int").alias("parts"))
    return materialize(rows.join(trees, "h").select("h", "id", "n", "room", "root", "main", "parts"), "unsettled")


def _possible(percent: int):
    """Over rows as in :func:`_meet`, but without bitmaps: those that some row of the other kind
    could be alike by size and room alone. Larger trees pass as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("signature_tree")
        for b in batches:
            if not b.num_rows:
                continue
            h, part, kind = (b.column(i).to_numpy() for i in range(3))
            at, start, end = _side_by_side(h, part, kind)
            keep = np.ones(len(h), bool)
            for k in at:
                keep[start[k] : end[k + 1]] = False
            none = np.zeros((len(h), 1), np.uint64)
            cols = [b.column(i).to_numpy() for i in range(3, 7)]
            for i, j, _, _ in _small([*cols, none], np.stack([start[at], end[at], start[at + 1], end[at + 1]], 1), percent):
                keep[i] = keep[j] = True
            yield b.filter(pa.array(keep))

    return work


def _between(rows: DataFrame, bitmaps: DataFrame, percent: int, best: bool) -> DataFrame:
    """``a, b`` in different components that may be alike, by the trees of unsettled rows."""
    n = partitions(rows.sparkSession)
    own = F.array(F.when(F.col("root") != F.col("main"), F.struct(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"))))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), F.lit(1).alias("kind")))
    dealt = rows.withColumn("at", F.explode(F.concat(F.array_compact(own), every)))
    dealt = dealt.select("h", "at.part", "at.kind", "id", F.col("n").cast("long").alias("n"), F.col("room").cast("long").alias("room"), "root")
    dealt = dealt.repartition(n, "h", "part").sortWithinPartitions("h", "part", "kind", "root", "n")
    # Few rows are left, so few bitmaps are sent.
    left = materialize(dealt.mapInArrow(_possible(percent), dealt.schema), "possible")
    met = left.join(bitmaps, "id").select(*dealt.columns, "s").repartition(n, "h", "part").sortWithinPartitions("h", "part", "kind", "root", "n")
    return met.mapInArrow(_meet(percent, best), "a long, b long").distinct()


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs ``a, b`` those that are alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("signature_tree")
        last, seen = None, None
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                if (y := y.as_py()) != last:
                    last, seen = y, shingle_set(y, shingle)
                ok.append(alike(shingle_set(x.as_py(), shingle), seen, percent))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    pairs = materialize(pairs, "candidates")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    few = ids.limit(SMALL + 1).count() <= SMALL
    found = texts.select("id", "t").join(F.broadcast(ids) if few else ids, "id").groupBy("id").agg(F.first("t").alias("t"))
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(found.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long"), "alike")


def _components(docs: DataFrame, sets: DataFrame, wide: str, shingle: int, percent: int) -> DataFrame:
    """``node, root``. The table of ``sets`` at ``wide`` goes once their prefixes are not needed."""
    spark = docs.sparkSession
    shared = shared_shingles(sets)
    slim = materialize(sets.select("id", "m", "n"), "set-sizes")
    discard(spark, wide)
    texts = with_texts(docs, slim, shared)
    linked = _tasks(texts, shingle, percent)
    bitmaps = linked.where("s is not null").select(F.col("a").alias("id"), "s").dropDuplicates(["id"])
    roots = materialize(components(linked.where("b is not null").select("a", "b")), "roots")
    rows = shared
    for best in (True, False):
        kept, left = new_path(spark, "roots"), new_path(spark, "left")
        with scratch(spark):
            rows = write_table(_unsettled(rows.select("h", "id", "n", "room"), roots), left)
            more = _checked(_between(rows, bitmaps, percent, best), texts, shingle, percent)
            if not more.isEmpty():
                roots = write_table(joined(roots, more), kept)
    return roots


def similar_sets(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    A document's set are its distinct runs of ``shingle`` words (A-Z lowered, split at ASCII
    white space); with fewer words the whole sequence is one. Sets link when 100 x intersection
    is at least ``percent`` x union; ``component_id`` is the smallest doc_id that links reach,
    the own one included.

    Null and empty texts and those of white space have no set and no links. Long texts are
    compared whole. Equal sets always link, so copies and repeated rows share a component. Null
    ids are passed on and name no component unless it has no other id. An empty table gives no
    rows. Only ``doc_id`` and ``text`` are read, so no name can clash.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", utf8("text").alias("t"))
    wide, distinct, slim, kept = (new_path(spark, n) for n in ("sets", "distinct-sets", "set-names", "set-components"))
    with scratch(spark):
        found = write_table(named_sets(texts, shingle, percent, common_shingles(texts, shingle)), wide)
        one = found.where("n > 0").groupBy("k1", "k2").agg(F.first(F.struct("m", "n", "rare", "prefix")).alias("x"))
        sets = write_table(one.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "x.*"), distinct)
        ids = materialize(sets.select("k1", "k2", "id"), "set-ids")
        every = write_table(found.select("doc_id", "k1", "k2", "n"), slim)
        discard(spark, wide)
        roots = _components(texts.select("t"), sets, distinct, shingle, percent)
        names = ids.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        names = write_table(names.select("k1", "k2", F.coalesce("root", "id").alias("root")), kept)
    own = every.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first")).join(names, ["k1", "k2"])
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    # A table of its own, so that Spark can split a set with very many documents below.
    named = materialize(own.join(least, "root").select("k1", "k2", "component_id"), "named")
    linked = every.where("n > 0").join(named, ["k1", "k2"])
    out: list[Column] = [F.col("doc_id"), F.col("n").cast("long").alias("n_shingles")]
    return linked.select(*out, "component_id").unionByName(every.where("n = 0").select(*out, F.col("doc_id").alias("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id"""
