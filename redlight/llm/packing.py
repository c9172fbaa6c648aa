"""Packing token pieces into sequences: dominance reduction, then best fit.

Only the histogram of piece lengths (at most ``capacity`` entries) is planned on; the plan
is a list of patterns, each a multiset of lengths with the number of sequences that have it.
Its size depends on the capacity, not on the corpus. Pieces find their place by their rank
among the pieces of equal length, which is counted in buckets, so that no length, however
frequent, meets in one task.

The reduction (after Martello and Toth) fixes a set of at most three pieces, the largest
among them given, where it provably dominates every set that the given piece could be in:

- no other piece fits beside it: it stands alone;
- a partner fills the sequence exactly, or no two others fit: the largest partner;
- no three others fit, and of the two others no pair beats (largest, then largest that
  still fits) in both places: these two.

The rest is packed by best fit, largest pieces first.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder, piece_encoder
from .common import enter, materialize, partitions, unwrapped, utf8, worker_state, wrapped

Pattern = tuple[tuple[int, int], ...]  # ((length, pieces), ...), longest first

#: Whitespace-free chunks longer than this are encoded each time and kept in no cache.
KEPT_BYTES = 48


class ChunkIds(dict):
    """UTF-8 chunk without ASCII white space -> its ids, little-endian unsigned 32 bits."""

    def __init__(self, encoder: PieceEncoder, most: int):
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.encoder.encode(chunk.decode("utf-8", "replace"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most and len(chunk) <= KEPT_BYTES:
            self[chunk] = out
        return out


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_rows: int = 400_000) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each text's ids and ``end_id``, cut into pieces
    of ``capacity`` ids, the last may be shorter. ``ids`` is little-endian unsigned 32 bits.

    For tokenizers that drop white space before they cut words. Null text counts as empty
    (one piece that holds ``end_id``); rows that repeat and null ids are passed on. A long
    text is encoded whole and gives as many pieces as it fills. An empty table gives no rows.
    Other columns are not read, so no name can clash.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        cache = worker_state(f"chunk-ids {tokenizer_path}", lambda: ChunkIds(piece_encoder(tokenizer_path), cache_rows))
        look, end, step = cache.__getitem__, np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            keep, piece, start, length, ids = [], [], [], [], []
            for row, t in enumerate(b.column(1)):
                whole = b"".join(map(look, t.as_py().split())) + end
                for i, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    keep.append(row), piece.append(i), start.append(at // 4), length.append(len(part) // 4), ids.append(part)
                if len(ids) >= 1024:
                    yield batch(b, keep, piece, start, length, ids)
                    keep, piece, start, length, ids = [], [], [], [], []
            if ids:
                yield batch(b, keep, piece, start, length, ids)

    def batch(b, keep, piece, start, length, ids):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids binary")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with how often, and the counts that remain.

    A proof holds for all copies of a set at once: it says that nothing fits beside it or
    that no other partners are better, and pieces that go only leave less that could. So
    each step uses up a length (but for an odd piece), and the number of patterns is bounded
    by that of lengths, whatever the counts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[Pattern, int]] = []
    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j, 0):
                found = _dominating(left, j, capacity)
                if found is None:
                    break
                need = Counter([j, *found])
                times = min(left[s] // n for s, n in need.items())
                for s, n in need.items():
                    left[s] -= n * times
                    if not left[s]:
                        del left[s]
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                again = True
    return fixed, left


def _dominating(left: dict[int, int], j: int, capacity: int) -> list[int] | None:
    """Partners of one piece of length ``j`` in a dominating set, None if none is proven."""
    sizes = sorted(s for s, n in left.items() if n - (s == j) > 0)
    room = capacity - j
    fit = sizes[: bisect_right(sizes, room)]
    if not fit:
        return []
    have = lambda s, used=(): left[s] - (s == j) - used.count(s)
    low: list[int] = []  # the three smallest pieces
    for s in fit:
        low += [s] * min(3 - len(low), have(s))
        if len(low) == 3:
            break
    k = fit[-1]
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return [k]
    if len(low) == 3 and sum(low) <= room:
        return None
    # At most two others: k, then the largest that still fits beside it.
    i = bisect_right(fit, room - k) - 1
    while i >= 0 and have(fit[i], (k,)) <= 0:
        i -= 1
    if i < 0:
        return None
    b = fit[i]
    above = fit[bisect_right(fit, b) :]
    two = [s for s in above[:2] for _ in range(min(2, have(s)))][:2]
    return [k, b] if len(two) < 2 or sum(two) > room else None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: groups of equal sequences are filled together."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if not groups[room]:
                rooms.insert(bisect_right(rooms, room), room)
            groups[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_right(rooms, s - 1)
            if i == len(rooms):
                each = capacity // s
                put(capacity - each * s, ((s, each),), n // each)
                if n % each:
                    put(capacity - n % each * s, ((s, n % each),), 1)
                break
            room = rooms[i]
            pattern, m = groups[room].pop()
            if not groups[room]:
                del rooms[i], groups[room]
            each = room // s
            full = min(m, n // each)
            put(room - each * s, pattern + ((s, each),), full)
            n, m = n - full * each, m - full
            if m and n and n < each:
                put(room - n * s, pattern + ((s, n),), 1)
                n, m = 0, m - 1
            put(room, pattern, m)
    return [x for at in groups.values() for x in at]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go, by rank: ``length, rank, first, each, at``.

    From ``rank`` on, ``each`` pieces at a time go to sequence ``first``, the next and so
    on, gapless from offset ``at``.
    """
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    fixed, left = reduce_by_dominance(counts, capacity)
    rank: Counter = Counter()
    rows, first = [], 0
    for pattern, n in fixed + best_fit(left, capacity):
        at = 0
        for s, each in pattern:
            rows.append((s, rank[s], first, each, at))
            rank[s] += n * each
            at += s * each
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "first", "each", "at"]).sort_values(["length", "rank"])


def pack(pieces: DataFrame, keys: list[str], capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each has a length of 1 to ``capacity``.

    ``keys`` order pieces of equal length, so that reruns agree; rows with equal keys are
    interchangeable. Pieces without a length are left out; an empty table gives none. Columns
    of ``pieces`` named ``sequence_id`` or ``offset`` give way to the new ones.
    """
    some = pieces.where(F.col(length_col).isNotNull())
    # A frequent length is spread over buckets; ranks run on from bucket to bucket.
    buckets = max(16, 4 * partitions(pieces.sparkSession))
    rows = wrapped(some, length=F.col(length_col).cast("long"), bucket=F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), by=F.struct(*keys))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-base")
    # At most ``capacity`` rows.
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}
    places = plan(counts, capacity)
    code = lambda s, r: s.astype(np.int64) * (1 << 44) + r
    table = pieces.sparkSession.sparkContext.broadcast({"code": code(places["length"].to_numpy(), places["rank"].to_numpy())} | {c: places[c].to_numpy() for c in ("rank", "first", "each", "at")})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, s, r = table.value, length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(t["code"], code(s, r), side="right") - 1
        q = r - t["rank"][i]
        return pd.DataFrame({"sequence_id": t["first"][i] + q // t["each"][i], "offset": t["at"][i] + q % t["each"][i] * s})

    mine = Window.partitionBy("length", "bucket").orderBy("by")
    out = rows.withColumn("rn", F.row_number().over(mine)).join(base.drop("n"), ["length", "bucket"]).withColumn("place", place("length", F.col("base") + F.col("rn") - 1))
    return unwrapped(out, pieces, sequence_id=F.col("place.sequence_id"), offset=F.col("place.offset"))
