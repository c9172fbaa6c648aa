"""Exact removal of repeated passages by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document. Documents are ordered by
(id, hash of the text); rows with the same id and text count as one document, and each gets
its result. A null id comes before all others.

1. Every window takes the place of its smallest k-gram hash (the leftmost, on ties) as its
   anchor. Windows in a row with one anchor form a super-window, so equal windows lie in
   super-windows with equal anchor hashes, and each window lies in exactly one. Two equal
   windows never lie in the same one.
2. Super-windows are dealt out by anchor hash. Copies of one are folded, first within a
   task: the earliest stays, the others are repeats as a whole. An anchor hash with a single
   text left has no other repeat.
3. The texts of the others are cut into shards. Each shard's transform is built one
   depth after the other, and the transforms are merged by refining their interleave
   (Holt and McMillan): each pass moves every row, in the order of the pass before, behind
   its preceding characters, and a block of rows ends where those differ. Passes read only
   the rows that still lead to a window start. After ``window`` characters the blocks are
   the intervals whose common prefix is a whole window: repeats, of which the earliest stays.
4. An anchor hash with more than ``hot`` different super-windows (the edge of a passage that
   very many documents share) is cut into single windows, dealt out by a hash of their own
   bytes. Equal ones are folded in each task before they are sent, and in sorted order, row
   by row, where they arrive, so that no window, however frequent, fills a task.

Copies in step 2 are told by two 64-bit hashes (anchor and text); steps 3 and 4 compare bytes.
Texts are never shuffled but twice by document, to fetch what step 3 needs and to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.identity import numbered
from .common import enter, materialize, partitions, unwrapped, utf8, worker_state, wrapped

KGRAM = 37
_BASE = 0x9E3779B97F4A7C15
#: Bytes that one step of the anchor search holds; longer texts are searched in tiles.
TILE = 1 << 20
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make():
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, U)
            x[0] = 1
            out.append(np.cumprod(x))
        return tuple(out)

    return worker_state(f"powers {n}", make)


class Rolling:
    """Polynomial hashes of all substrings of ``text``, modulo 2^64."""

    def __init__(self, text: np.ndarray, most: int):
        up, self.down = _powers(most + 1)
        self.sums = np.zeros(len(text) + 1, U)
        np.cumsum((text.astype(U) + U(1)) * up[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        s = self.sums
        return _mix((s[length:] - s[:-length]) * self.down[: len(s) - length])


def super_windows(text: np.ndarray, ends: np.ndarray, most: int, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text hash, start and length of the super-windows of texts that lie one
    after the other and end at ``ends``."""
    none = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(text) < window:
        return none
    roll = Rolling(text, most)
    h = roll.all(k)
    # Smallest upper half of a hash in each window, the leftmost place on ties.
    low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    n, done = window - k + 1, 1
    while done < n:
        step = min(done, n - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(len(at) + 1, bool)
    ok[-1] = False
    for s, e in zip([0, *ends[:-1]], ends):
        ok[max(s, e - window + 1) : e] = False
    new = np.ones(len(ok), bool)
    new[1:-1] = at[1:] != at[:-1]
    new[1:] |= ok[1:] != ok[:-1]
    edge = np.flatnonzero(new)
    first = edge[:-1][ok[edge[:-1]]]
    if not len(first):
        return none
    length = edge[1:][ok[edge[:-1]]] - first + window - 1
    return h[at[first]], roll.of(first, length) ^ _mix(length.astype(U)), first, length


def _runs(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge spans (sorted by doc, start) that touch or overlap."""
    if not len(start):
        return start, end, doc
    big = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * big)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + doc[1:] * big > reach[:-1]
    i = np.flatnonzero(new)
    last = np.concatenate([i[1:], [len(start)]]) - 1
    return start[i], reach[last] - doc[i] * big, doc[i]


_SLIM = "h long, c long, len int, d long, dh long, start int, span boolean"


def _find(window: int, k: int):
    most = TILE + window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        for b in batches:
            d, dh, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found, i = [], 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(at, at[i] + TILE, side="right")) - 1)
                for t in range(at[i], at[j], TILE) if j == i + 1 else [at[i]]:
                    end = min(at[j], t + TILE + window - 1) if j == i + 1 else at[j]
                    ends = at[i + 1 : j + 1] - t if j > i + 1 else np.array([end - t])
                    h, c, first, length = super_windows(data[t:end], ends, most, window, k)
                    row = i + np.searchsorted(ends, first, side="right")
                    found.append((h, c, length, row, first + t - at[row]))
                i = j
            if not found:
                continue
            h, c, length, row, start = (np.concatenate(x) for x in zip(*found))
            if not len(h):
                continue
            # Fold copies within the batch.
            rank = np.empty(len(d), np.int64)
            docs = np.lexsort((dh, d))
            rank[docs] = np.concatenate([[0], np.cumsum((d[docs][1:] != d[docs][:-1]) | (dh[docs][1:] != dh[docs][:-1]))])
            order = np.lexsort((start, rank[row], c, h))
            h_, c_, r_, s_ = h[order], c[order], rank[row][order], start[order]
            new = np.concatenate([[True], (h_[1:] != h_[:-1]) | (c_[1:] != c_[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & ((r_ != r_[head]) | (s_ != s_[head]))
            one = order[new]
            again = order[later]
            again = again[np.lexsort((start[again], row[again]))]
            s, e, r = _runs(start[again], start[again] + length[again], row[again])
            n, m = len(one), len(s)
            fill = _mix(np.arange(m, dtype=U) + U(int(h[0])))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h[one], fill]).view(np.int64)),
                pa.array(np.concatenate([c[one], np.zeros(m, U)]).view(np.int64)),
                pa.array(np.concatenate([length[one], e - s]).astype(np.int32)),
                pa.array(np.concatenate([d[row[one]], d[r]])),
                pa.array(np.concatenate([dh[row[one]], dh[r]])),
                pa.array(np.concatenate([start[one], s]).astype(np.int32)),
                pa.array(np.arange(n + m) >= n),
            ], names=["h", "c", "len", "d", "dh", "start", "span"])

    return work


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h, c, d, dh, start): repeats as spans, and the first of each
    text where an anchor hash has several (``span`` false)."""
    names = ["h", "c", "len", "d", "dh", "start", "span"]
    # The last text group: its first row, whether it was told, and the last h.
    head, told = None, False
    for b in batches:
        span = b.column(6).to_numpy(zero_copy_only=False)
        cols = [b.column(i).to_numpy() for i in range(6)]
        out = [x[span] for x in cols]
        cols = [x[~span] for x in cols]
        n = len(cols[0])
        first = [x[:0] for x in cols]
        if n:
            old = 0
            if head is not None:
                cols, old = [np.concatenate([[x], y]) for x, y in zip(head, cols)], 1
            h, c, _, d, dh, start = cols
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            lead = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))
            later = ~new_c & ((d != d[lead]) | (dh != dh[lead]) | (start != start[lead]))
            out = [np.concatenate([x, y[later]]) for x, y in zip(out, cols)]
            tops = np.flatnonzero(new_c)
            group = np.cumsum(new_h)[tops]
            size = np.bincount(group)[group]
            tell = size >= 2
            if old and told:
                tell[group == group[0]] = True
                tell[0] = False
            first = [x[tops[tell]] for x in cols]
            # What is carried on: the last group's first row; told if its h has been.
            last_told = bool(size[-1] >= 2 or (old and told and group[-1] == group[0]))
            head, told = [x[tops[-1]] for x in cols], last_told
        m, k = len(out[0]), len(first[0])
        if m + k:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(out, first)] + [pa.array(np.arange(m + k) < m)], names=names)


#: Kinds of the rows that :func:`_fetch` sends: super-windows, single windows, repeats.
TEXT, WINDOW, SPAN = 0, 1, 2
_FETCHED = "kind int, h long, d long, dh long, start int, len int, t binary"
#: Single windows that a task holds to fold equal ones before they are sent.
HELD_WINDOWS = 200_000


def _fetch(window: int):
    """Texts of the wanted super-windows; those of hot anchors (``n`` given) as single windows."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [c.split(" ")[0] for c in _FETCHED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            hot = []
            for d, dh, t, want in zip(*(b.column(i) for i in range(4))):
                text, d, dh = t.as_py(), d.as_py(), dh.as_py()
                for w in want.as_py():
                    s, n = w["start"], w["len"]
                    if w["n"] is None:
                        out.append((TEXT, w["h"], d, dh, s, n, text[s : s + n]))
                    else:
                        hot.append((d, dh, s, text[s : s + n]))
                if len(out) >= 50_000:
                    yield batch()
                    out = []
            # From the earliest on, so that what is met again is a repeat.
            seen: set[bytes] = set()
            for d, dh, s, part in sorted(hot):
                keys = Rolling(np.frombuffer(part, np.uint8), 2 * window).all(window).view(np.int64).tolist()
                gone = -1
                for i, key in enumerate(keys):
                    one = part[i : i + window]
                    if one in seen:
                        gone = i if gone < 0 else gone
                        continue
                    seen.add(one)
                    out.append((WINDOW, key, d, dh, s + i, window, one))
                    if gone >= 0:
                        out.append((SPAN, keys[gone], d, dh, s + gone, i - gone + window - 1, None))
                        gone = -1
                if gone >= 0:
                    out.append((SPAN, keys[gone], d, dh, s + gone, len(keys) - gone + window - 1, None))
                if len(seen) >= HELD_WINDOWS:
                    seen.clear()
                if len(out) >= 50_000:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return work


class ShardTransform:
    """Burrows-Wheeler columns of one shard: for each depth, the characters (two at a time)
    before the suffixes that lead to a window start, in the order of the suffixes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, window: int):
        pair = (text[:-1].astype(np.uint16) << 8) | text[1:]
        order = np.arange(len(starts))
        self.columns = []
        for depth in range(0, window, 2):
            at = starts[order] + window - depth
            before = pair[at - 2] if depth + 2 <= window else text[at - 1].astype(np.uint16)
            self.columns.append(before)
            order = order[np.argsort(before, kind="stable")]
        self.order = order


def merge(shards: list[ShardTransform]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbered shard after shard) in the order of their windows, and the number of
    each row's block: rows of one block have a window in common."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    block = np.zeros(len(z), np.int32)
    for depth in range(len(shards[0].columns)):
        char = np.empty(len(z), np.uint16)
        char[np.argsort(z, kind="stable")] = np.concatenate([s.columns[depth] for s in shards])
        step = np.argsort(char, kind="stable")
        char, z, block = char[step], z[step], block[step]
        ends = (char[1:] != char[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(ends, out=block[1:])
    rows = np.empty(len(z), np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows[np.argsort(z, kind="stable")] = np.concatenate([s.order + x for s, x in zip(shards, base)])
    return rows, block


def _resolve(h, d, dh, start, texts: list[bytes], window: int, shard_rows: int):
    """Spans of the windows that are not the earliest of their block."""
    size = np.array([len(t) for t in texts])
    n = size - window + 1
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.frombuffer(b"".join(texts), np.uint8)
    place = (np.cumsum(size) - size)[owner] + within
    cuts = [0]
    for stop in np.cumsum(n):
        if stop - cuts[-1] >= shard_rows:
            cuts.append(int(stop))
    if cuts[-1] != len(owner):
        cuts.append(len(owner))
    shards = []
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = place[a], place[b - 1] + window
        shards.append(ShardTransform(text[lo:hi], place[a:b] - lo, window))
    rows, block = merge(shards)
    # Windows by (document, place): super-windows of a document do not interleave.
    by = np.lexsort((start, dh, d))
    base = np.empty(len(texts), np.int64)
    base[by] = np.cumsum(n[by]) - n[by]
    rank = (base[owner] + within)[rows]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.minimum.reduceat(rank, first)
    gone = np.zeros(len(owner), bool)
    gone[rows[rank != least[block]]] = True
    i = np.flatnonzero(gone)
    s, e, o = _runs(within[i], within[i] + window, owner[i])
    return d[o], dh[o], start[o] + s, e - s


def _repeats(window: int, chunk_rows: int, shard_rows: int):
    """Over rows of :func:`_fetch`, sorted by kind, h, t, d, dh and start: spans of repeats."""

    def spans(d, dh, start, n):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(dh), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "dh", "start", "len"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count = 0
        last: bytes | None = None  # the window before, where windows go on in the next batch

        def solve(parts):
            cols = [np.concatenate([p[i] for p in parts]) for i in range(4)]
            return spans(*_resolve(*cols, [t for p in parts for t in p[4]], window, shard_rows))

        for whole in batches:
            kind = whole.column(0).to_numpy()
            edge = np.searchsorted(kind, [WINDOW, SPAN])
            if edge[1] < len(kind):
                b = whole.slice(edge[1])
                yield spans(*(b.column(i).to_numpy() for i in (2, 3, 4, 5)))
            if edge[0] < edge[1]:
                b = whole.slice(edge[0], edge[1] - edge[0])
                own = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, window)
                again = np.concatenate([[last is not None and own[0].tobytes() == last], (own[1:] == own[:-1]).all(1)])
                last = own[-1].tobytes()
                if again.any():
                    d, dh, start = (b.column(i).to_numpy()[again] for i in (2, 3, 4))
                    yield spans(d, dh, start, np.full(len(d), window))
            if not edge[0]:
                continue
            b = whole.slice(0, edge[0])
            cols = [b.column(i).to_numpy() for i in range(1, 5)]
            h, texts = cols[0], b.column(6).to_pylist()
            at = 0
            edges = [*(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)]
            if held and held[-1][0][-1] != h[0] and count >= chunk_rows:
                yield solve(held)
                held, count = [], 0
            n = np.cumsum([len(t) - window + 1 for t in texts])
            done = 0
            for e in edges:
                if e < len(h) and count + n[e - 1] - done >= chunk_rows:
                    held.append([x[at:e] for x in cols] + [texts[at:e]])
                    yield solve(held)
                    held, count, at, done = [], 0, e, n[e - 1]
            if at < len(h):
                held.append([x[at:] for x in cols] + [texts[at:]])
                count += int(n[-1] - done)
        if held:
            yield solve(held)

    return work


def _document(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Order and identity of a document: its id (null first) and a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, k: int = KGRAM, hot: int = 500, chunk_rows: int = 200_000, shard_rows: int = 40_000) -> DataFrame:
    """``d, dh, start, len``: spans, may overlap, of what starts earlier elsewhere."""
    if not 0 < k <= window or window < 2:
        raise ValueError("1 <= k <= window and window >= 2")
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    d, dh = _document(docs, id_col, text_col)
    texts = docs.select(d.alias("d"), dh.alias("dh"), utf8(text_col).alias("t"))
    folded = materialize(
        texts.mapInArrow(_find(window, k), _SLIM)
        .repartition(n, "h").sortWithinPartitions("h", "c", "d", "dh", "start")
        .mapInArrow(_fold, _SLIM).drop("c"),
        "folded",
    )
    whole = folded.where("span").select("d", "dh", "start", "len")
    several = folded.where("not span").select("h", "d", "dh", "start", "len")
    many = materialize(several.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot")
    wanted = (
        several.join(many, "h", "left")
        .groupBy("d", "dh").agg(F.collect_list(F.struct("h", "start", "len", "n")).alias("want"))
    )
    found = (
        texts.join(wanted, ["d", "dh"]).select("d", "dh", "t", "want").dropDuplicates(["d", "dh"])
        .mapInArrow(_fetch(window), _FETCHED)
        .repartition(n, "h").sortWithinPartitions("kind", "h", "t", "d", "dh", "start")
        .mapInArrow(_repeats(window, chunk_rows, shard_rows), "d long, dh long, start int, len int")
    )
    return whole.unionByName(found)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, characters: bool = False, **options) -> DataFrame:
    """All columns of ``docs`` and ``removed`` (array of ``start, length`` in bytes: the
    maximal removed runs) and ``kept`` (binary: the other bytes).

    With ``characters`` the runs grow to whole characters, so that ``kept`` is the text
    without them. A null or empty text has neither. Long texts are searched whole, in tiles.
    Rows with the same id and text are one document and get the same result. Of documents with
    equal ids that with the smaller hash of its text counts as earlier. Ids may be of any type
    that has an order; null ids come first. An empty table gives no rows. Columns of ``docs``
    named ``removed`` or ``kept`` give way to the new ones.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        # By their ranks.
        ids = docs.select(F.col(id_col).alias("i")).where("i is not null").distinct()
        ranks = materialize(numbered(ids, ["i"], "r").select("i", F.col("r").cast("long").alias("r")), "ranks")
        rows = wrapped(docs, i=F.col(id_col)).join(ranks, "i", "left").select("row", F.col("r").alias("doc_id"), F.col("row")[text_col].alias("text"))
        return unwrapped(cut_repeats(rows, "doc_id", "text", window, characters, **options), docs, removed=F.col("removed"), kept=F.col("kept"))
    d, dh = _document(docs, id_col, text_col)
    spans = materialize(
        repeated_spans(docs, id_col, text_col, window, **options)
        .groupBy("d", "dh").agg(F.collect_list(F.struct("start", "len")).alias("spans")),
        "spans",
    )
    kind = "array<struct<start:int,length:int>>"

    @F.pandas_udf(f"removed {kind}, kept binary")
    def cut(texts, spans):
        import pandas as pd

        removed, kept = [], []
        for t, got in zip(texts, spans):
            at, runs, parts = 0, [], []
            for s, n in sorted((x["start"], x["len"]) for x in got):
                e = s + n
                if characters:
                    while t[s] & 0xC0 == 0x80:
                        s -= 1
                    while e < len(t) and t[e] & 0xC0 == 0x80:
                        e += 1
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            for s, e in runs:
                parts.append(t[at:s])
                at = e
            removed.append([{"start": s, "length": e - s} for s, e in runs])
            kept.append(b"".join([*parts, t[at:]]))
        return pd.DataFrame({"removed": removed, "kept": kept})

    rows = wrapped(docs, d=d, dh=dh).join(spans, ["d", "dh"], "left").withColumn("bytes", utf8(F.col("row")[text_col]))
    rows = rows.withColumn("cut", F.when(F.col("spans").isNotNull(), cut("bytes", F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")))))
    return unwrapped(rows, docs, removed=F.coalesce("cut.removed", F.array().cast(kind)), kept=F.coalesce("cut.kept", "bytes"))
