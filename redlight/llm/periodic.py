"""Periodic runs of words: every maximal repetition of a text, and the text without them.

A run is a stretch with smallest period ``q`` of two periods or more that no neighbouring word
extends. By the runs theorem each run has a Lyndon root that is the longest Lyndon word at its
place in one of two orders of the alphabet, so those words are the only candidates (Bannai et
al.). How far a candidate's period reaches to the right and to the left are longest common
extensions, told in constant time by lowest common ancestors in the suffix trees (Ukkonen) of
the text and of its reversal.

Trees are built over those stretches only that can hold a run. A run of at least 12 words and
two periods is covered by windows of 6 words that each come again within it, so whatever no
such window covers is in no run, and no run crosses it. This screen decides nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, utf8, SPACES

#: Shortest run that is told, and windows of the screen (half of it, so that they cover a run).
LEAST = 12
WINDOW = 6
_MIX = 0x9E3779B97F4A7C15


def suffix_tree(w: list[int], wide: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's tree of ``w``, whose last symbol occurs once; symbols are below ``wide``.

    ``child[node * wide + symbol]``, where each node's edge starts in ``w`` and ends, and the
    suffix of each leaf (-1 for inner nodes). Node 0 is the root.
    """
    n = len(w)
    start, end, link, suffix, child = [0], [0], [0], [-1], {}
    node = edge = length = left = 0
    for i, c in enumerate(w):
        left += 1
        last = 0
        while left:
            if not length:
                edge = i
            key = node * wide + w[edge]
            at = child.get(key)
            if at is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - left + 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                a = start[at]
                e = end[at]
                size = (e if e <= i else i + 1) - a
                if length >= size:
                    edge += size
                    length -= size
                    node = at
                    continue
                if w[a + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                child[key] = split
                start.append(a)
                end.append(a + length)
                link.append(0)
                suffix.append(-1)
                child[split * wide + c] = split + 1
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - left + 1)
                start[at] = a + length
                child[split * wide + w[a + length]] = at
                if last:
                    link[last] = split
                last = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return child, start, end, suffix


class Extensions:
    """Longest common extensions to the right of two places of ``w`` (symbols from 1 on).

    The Euler tour keeps, between each leaf and the next, the depth of the shallowest node it
    passes: that is their lowest common ancestor, so a table of minima over powers of two
    answers in constant time.
    """

    def __init__(self, w: np.ndarray, turned: bool = False):
        n, self.wide = len(w), int(w.max()) + 1
        child, start, end, suffix = suffix_tree([*w.tolist(), 0], self.wide)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        keys, heads = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        first = np.searchsorted(keys, np.arange(len(start) + 1) * self.wide)
        leaves, low = self._tour(heads.tolist(), first.tolist(), start, end, suffix)
        self.rank = np.empty(n + 1, np.int64)
        self.rank[leaves] = np.arange(n + 1)
        if turned:
            # The other order of the alphabet; the end still comes before all symbols.
            ends = keys % self.wide == 0
            parent = keys // self.wide
            heads = heads[np.lexsort((-(keys % self.wide), ~ends, parent))]
            self.other = np.empty(n + 1, np.int64)
            self.other[self._tour(heads.tolist(), first.tolist(), start, end, suffix)[0]] = np.arange(n + 1)
        self.table = [np.array(low, np.int32)]
        step = 1
        while 2 * step <= n + 1:
            t = self.table[-1]
            self.table.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    @staticmethod
    def _tour(heads: list[int], first: list[int], start: list[int], end: list[int], suffix: list[int]) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the leaves, and the common depth of each with the one before."""
        depth = [0] * len(start)
        leaves, low, passed = [], [], 0
        stack = [(x, 0) for x in reversed(heads[first[0] : first[1]])]
        newest = stack[-1][0]
        while stack:
            x, up = stack.pop()
            if x != newest:  # not the first child: the tour comes down from the parent
                passed = up
            s = suffix[x]
            if s >= 0:
                leaves.append(s)
                low.append(passed)
                newest = -1
            else:
                d = depth[x] = up + end[x] - start[x]
                kids = heads[first[x] : first[x + 1]]
                newest = kids[0]
                kids.reverse()
                stack += [(k, d) for k in kids]
        return leaves, low

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp(b - a)[1] - 1
        out = np.zeros(len(a), np.int64)
        for p in np.unique(k):
            t, m = self.table[p], k == p
            out[m] = np.minimum(t[a[m]], t[b[m] - (1 << p)])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """The next place whose suffix comes before; Lyndon words end there."""
    n = len(rank) - 1
    out = [n] * n
    for i in range(n - 1, -1, -1):
        r, j = rank[i], i + 1
        while rank[j] > r:
            j = out[j]
        out[i] = j
    return out


def runs(w: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` of all runs of ``w`` (whole numbers) of at least ``least``
    words and two periods, by start and period."""
    n = len(w)
    if n < least:
        return np.zeros((0, 3), np.int64)
    w = np.unique(w, return_inverse=True)[1] + 1
    right, back = Extensions(w, turned=True), Extensions(w[::-1])
    found = []
    for rank in (right.rank, right.other):
        i = np.arange(n)
        j = np.array(_next_smaller(rank.tolist()))
        p = j - i
        left = back(n - i, n - j)
        length = left + p + right(i, j)
        ok = length >= np.maximum(least, 2 * p)
        found.append(np.stack([(i - left)[ok], length[ok], p[ok]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(w: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
    """From and to of the parts of ``w`` that can hold a run; documents start at ``begin``."""
    at = np.arange(len(w))
    part = np.repeat(np.arange(len(begin)), np.diff([*begin, len(w)]))
    while len(at):
        n = len(at) - WINDOW + 1
        if n < 1:
            return []
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(_MIX) + w[at[k : k + n]].astype(np.uint64)
        whole = np.flatnonzero(part[:n] == part[WINDOW - 1 :])
        h = (h[whole] ^ (h[whole] >> np.uint64(31))) * np.uint64(_MIX) + part[whole].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        twice = whole[np.union1d(order[same], order[same + 1])] if len(same) else whole[:0]
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        # New parts: covered words that follow each other in the text.
        kept, old = at[covered], part[covered]
        new = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(old) != 0)]) if len(kept) else np.zeros(0, bool)
        ids = np.cumsum(new) - 1
        long = np.bincount(ids, minlength=1)[ids] >= LEAST if len(ids) else np.zeros(0, bool)
        if len(kept) == len(at) and long.all():
            break
        at, part = kept[long], ids[long]
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    return [(int(a), int(b) + 1) for a, b in zip(at[new], at[[*(new[1:] - 1), len(at) - 1]])]


def _of_texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Words, runs and what is kept of each of several texts."""
    split = [t.split() for t in texts]
    size = np.array([len(x) for x in split])
    begin = np.cumsum(size) - size
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for words in split for x in words), np.int64, int(size.sum()))
    by: dict[int, list[np.ndarray]] = {}
    for a, b in stretches(w, begin):
        d = int(np.searchsorted(begin, a, "right")) - 1
        found = runs(w[a:b])
        found[:, 0] += a - begin[d]
        if len(found):
            by.setdefault(d, []).append(found)
    none = np.zeros((0, 3), np.int64)
    for d, words in enumerate(split):
        found = np.concatenate(by[d]) if d in by else none
        if len(found):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        yield int(size[d]), found, b" ".join(words)


def periodic_runs(docs: DataFrame, group: int = 1 << 20) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, one row per row of ``docs``.

    Words are split at ASCII white space. ``runs`` has ``start, length, period`` of every run
    of 12 words and two periods at least, by start, then period. A word is dropped if it lies
    in a run behind its first period; ``collapsed`` is the UTF-8 of the other words, joined
    by one space.

    Null and empty texts have no words and collapse to nothing. Texts are worked on whole: a
    task holds about ``group`` bytes of short texts or one long text, and trees for the longest
    stretch of it that repeats (some 500 bytes a word). Equal rows and rows of equal ids each
    get their row, null ids are passed on; an empty table gives no rows. Only ``doc_id`` and
    ``text`` are read, so no name can clash.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("periodic")

        def told(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            sizes, found, kept = zip(*_of_texts(texts))
            rows, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
            structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            kind, ids, texts, size = b.column(0).type, [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= group:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield told(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the texts, chosen by the CRC-32 ``h`` of the id, end in a
    loop: from word ``a`` on, words come again every ``p`` words. A null id has none."""
    g = F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACES), lambda x: x != "")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    looped = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def longest(found: str | Column) -> Column:
    """The run with the greatest length; of equals the earliest, then the shortest period."""
    c = F.col(found) if isinstance(found, str) else found
    return F.array_max(F.transform(c, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
