"""Joins of short texts that may differ in a few places, by keys with places masked out.

Texts that differ in at most ``d`` of ``m`` places are equal once the right ``d`` are masked. So
each text is indexed under every choice of masked places, and equal keys meet: candidates are
the pairs sought, not pairs that happen to share a character. Where choices are many (long
texts), places are masked in groups of neighbours, which only adds candidates.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of one text for one number of compared places.
MOST = 64


def masks(m: int, d: int, most: int = MOST) -> list[list[int]]:
    """Lists of kept places (from 1) of ``m``, so that texts that differ in at most ``d`` agree
    on one of them."""
    if d >= m:
        return [[]]
    k = m
    while comb(k, d) > most and k > d + 1:
        k -= 1
    edges = [round(i * m / k) for i in range(k + 1)]
    groups = [range(a + 1, b + 1) for a, b in zip(edges, edges[1:])]
    return [[p for i, g in enumerate(groups) if i not in gone for p in g] for gone in combinations(range(k), d)]


def lengths(texts: DataFrame, col: str) -> list[int]:
    """The lengths that occur: few, as texts are short."""
    return sorted(r[0] for r in texts.select(F.length(col)).distinct().collect() if r[0])


def _keyed(texts: DataFrame, col: str, wanted: list[tuple[int, str, int, int]]) -> DataFrame:
    """``texts`` with ``_key`` for each (length, tag, compared places, differences) of its length."""
    rows = [(n, tag, m, i, keep) for n, tag, m, d in wanted for i, keep in enumerate(masks(m, d))]
    table = texts.sparkSession.createDataFrame(rows, "_n int, _tag string, _m int, _i int, _keep array<int>")
    both = texts.withColumn("_n", F.length(col)).join(table, "_n")
    kept = F.array_join(F.transform("_keep", lambda p: F.substring(F.col(col), p, F.lit(1))), "")
    return both.withColumn("_key", F.struct("_tag", "_m", "_i", kept.alias("c"))).drop("_n", "_tag", "_m", "_i", "_keep")


def equal_length(a: DataFrame, b: DataFrame, x: str, y: str, differ: int) -> DataFrame:
    """Candidate pairs of equal length that may differ in at most ``differ`` places; each once."""
    both = sorted(set(lengths(a, x)) & set(lengths(b, y)))
    wanted = [(n, "e", n, min(differ, n)) for n in both]
    return _keyed(a, x, wanted).join(_keyed(b, y, wanted), "_key").drop("_key").distinct()


def by_shared_places(a: DataFrame, b: DataFrame, x: str, y: str, least: float, bonus: float) -> DataFrame:
    """Candidate pairs for which shared places over the shorter length, and ``bonus`` more for
    equal lengths, may reach ``least``; each once."""
    def differ(m: int, more: float) -> int | None:
        need = [k for k in range(m + 1) if k / m + more >= least]
        return m - need[0] if need else None

    na, nb = lengths(a, x), lengths(b, y)
    sides: tuple[list, list] = ([], [])
    for n in sorted(set(na) & set(nb)):
        if (d := differ(n, bonus)) is not None:
            for side in sides:
                side.append((n, "e", n, d))
    for i, (short, long) in enumerate(((na, nb), (nb, na))):
        for m in short:
            if (d := differ(m, 0.0)) is not None and any(n > m for n in long):
                sides[i].append((m, f"s{i}", m, d))
                sides[1 - i].extend((n, f"s{i}", m, d) for n in long if n > m)
    return _keyed(a, x, sides[0]).join(_keyed(b, y, sides[1]), "_key").drop("_key").distinct()
