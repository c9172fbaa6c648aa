"""Exact top-k inner products by MaxScore.

Vectors of whole numbers are packed into shards; each query's terms are its components. In
every block of a shard a term's contribution has a lower and an upper bound. Terms whose
upper bounds together cannot lift a vector that has only the lower bounds elsewhere to the
k-th best score so far are non-essential: the essential terms' postings are traversed, the
others are probed, largest bounds first, only for vectors that can still compete. A task
hands the scores that its queries have reached from one shard on to the next. The best of
all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions


class Shard:
    """Vectors in blocks of ``block`` with the bounds of every component in each.

    ``postings`` and ``touched`` count components of vectors: all that the queries so far met,
    and those of them that were read.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = 256):
        order = np.argsort(ids, kind="stable")
        self.blocks, self.postings, self.touched = [], 0, 0
        for i in range(0, len(ids), block):
            part = np.ascontiguousarray(x[order[i : i + block]].T)  # postings by component
            self.blocks.append((ids[order[i : i + block]], part, part.min(1), part.max(1)))

    def top(self, q: np.ndarray, own: int, k: int, reached: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` best, ties to smaller ids; ``own`` takes no part. What
        scores under ``reached`` (a k-th best score known from elsewhere) may be left out."""
        best_s, best_i = np.zeros(0, q.dtype), np.zeros(0, np.int64)
        for ids, post, least, most in self.blocks:
            self.postings += post.size
            bar = max(reached, best_s[-1]) if len(best_s) == k else reached
            high, low = np.maximum(q * least, q * most), np.minimum(q * least, q * most)
            if high.sum() < bar:
                continue
            terms = np.argsort(low - high, kind="stable")  # widest bounds first
            rest = np.concatenate([np.cumsum(high[terms][::-1])[::-1], [0]])  # from term j on
            # Essential: without them the lower bounds plus the rest stay under the bar.
            under = np.concatenate([[0], np.cumsum(low[terms])]) + rest < bar
            n = int(np.argmax(under)) if under.any() else len(terms)
            e = terms[:n]
            score = q[e] @ post[e] if n < len(terms) else q @ post
            self.touched += n * len(ids)
            cand = np.flatnonzero(score + rest[n] >= bar)
            score = score[cand]
            while n < len(terms) and len(cand):
                probe = terms[n : n + 8]
                self.touched += len(probe) * len(cand)
                score = score + q[probe] @ post[np.ix_(probe, cand)]
                n += len(probe)
                ok = score + rest[min(n, len(terms))] >= bar
                cand, score = cand[ok], score[ok]
            other = ids[cand] != own
            s, i = np.concatenate([best_s, score[other]]), np.concatenate([best_i, ids[cand][other]])
            if len(s) > 64 * k:  # no need to sort what is under the k-th best
                ok = s >= np.partition(s, -k)[-k]
                s, i = s[ok], i[ok]
            order = np.lexsort((i, -s))[:k]
            best_s, best_i = s[order], i[order]
        return best_s, best_i


    def top_many(self, q: np.ndarray, own: np.ndarray, k: int, reached: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`top` of every row of ``q`` (doubles that hold whole numbers): a block is
        bounded, split into terms and scored for all queries that it can matter to at once."""
        row, s, i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        bars, d = reached.astype(float).copy(), q.shape[1]
        for ids, post, least, most in self.blocks:
            self.postings += post.size * len(q)
            x, y = q * least, q * most
            high, low = np.maximum(x, y), np.minimum(x, y)
            live = np.flatnonzero(high.sum(1) >= bars)
            if not len(live):
                continue
            ql, high, low, bar = q[live], high[live], low[live], bars[live]
            terms = np.argsort(low - high, axis=1, kind="stable")
            zero = np.zeros((len(live), 1))
            rest = np.hstack([np.cumsum(np.take_along_axis(high, terms, 1)[:, ::-1], 1)[:, ::-1], zero])
            under = np.hstack([zero, np.cumsum(np.take_along_axis(low, terms, 1), 1)]) + rest < bar[:, None]
            n = np.where(under.any(1), under.argmax(1), d)
            place = np.empty_like(terms)
            np.put_along_axis(place, terms, np.broadcast_to(np.arange(d), terms.shape), 1)
            scores = np.where(place < n[:, None], ql, 0.0) @ post
            self.touched += int(n.sum()) * len(ids)
            r, c = np.nonzero(scores + rest[np.arange(len(n)), n][:, None] >= bar[:, None])
            score, at = scores[r, c], n[r]
            while (at < d).any():
                probe = at[:, None] + np.arange(8)
                t = terms[r[:, None], np.minimum(probe, d - 1)]
                self.touched += int((probe < d).sum())
                score = score + np.where(probe < d, ql[r[:, None], t] * post[t, c[:, None]], 0.0).sum(1)
                at = np.minimum(at + 8, d)
                ok = score + rest[r, at] >= bar[r]
                r, c, score, at = r[ok], c[ok], score[ok], at[ok]
            other = ids[c] != own[live[r]]
            row, s, i = np.concatenate([row, live[r[other]]]), np.concatenate([s, score[other]]), np.concatenate([i, ids[c[other]]])
            order = np.lexsort((i, -s, row))
            row, s, i = row[order], s[order], i[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            bars[row[nth == k - 1]] = np.maximum(bars[row[nth == k - 1]], s[nth == k - 1])
            row, s, i = row[nth < k], s[nth < k], i[nth < k]
        ends = np.searchsorted(row, np.arange(len(q) + 1))
        return [(s[a:b], i[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, x``: floor(scale * component). Rows without an id, vectors that are null or
    hold null or non-finite components are left out."""
    sound = F.forall(col, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(col, lambda e: F.floor(scale * e.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of at most ``most`` vectors: ``ids, data, dim, turn``; short vectors end in zeros.
    Partitions and the rows they make take turns, so ``turn`` deals them out evenly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, most):
                ids, x = b.column(0)[i : i + most], b.column(1)[i : i + most]
                sizes = np.diff(x.offsets.to_numpy())
                dim = int(sizes.max(initial=0))
                data = np.zeros((len(ids), dim), np.int64)
                data[np.arange(dim) < sizes[:, None]] = x.flatten().to_numpy()
                yield pa.RecordBatch.from_pydict({"ids": [ids.to_numpy().tobytes()], "data": [data.tobytes()], "dim": pa.array([dim], pa.int32()), "turn": pa.array([turn], pa.int32())})
                turn += 1

    return rows.select("vec_id", "x").mapInArrow(work, "ids binary, data binary, dim int, turn int")


def _places(spark: SparkSession, n: int) -> list[int]:
    """Keys that hash partitioning into ``n`` sends to partitions 0, 1, ...: one for each."""
    keys = spark.range(64 * n).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    return [r["id"] for r in keys.orderBy("p").collect()]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4_096, query_rows: int = 2_048, block: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query (fewer if
    there are fewer), ties to smaller ids. Both inputs are ``vec_id, x``.

    Rows with the query's own id take no part. A query id that repeats counts once, with the
    smallest of its vectors; a candidate that repeats may appear as often. Vectors of any
    length are taken whole, shorter ones as if they ended in zeros. Empty tables give no rows.
    """
    spark, n = vectors.sparkSession, partitions(vectors.sparkSession)
    once = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    # Every shard meets every block of queries: blocks are copied to each of ``n`` places.
    at = F.array(*map(F.lit, _places(spark, n))).cast("array<int>")
    asked = _packed(once, query_rows).select(F.explode(at).alias("place"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"))
    shards = _packed(vectors, shard_rows).withColumn("place", F.get(at, F.pmod("turn", F.lit(n))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, reached = None, None  # the last block of queries, and what they have reached
        for b in batches:
            for ids, data, dim, q_ids, q_data, q_dim in zip(*(b.column(i).to_pylist() for i in range(6))):
                wide = max(dim, q_dim)
                if q_ids != before:
                    before, reached = q_ids, np.full(len(q_ids) // 8, -np.inf)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x = np.zeros((len(ids), wide), np.int64)
                x[:, :dim] = np.frombuffer(data, np.int64).reshape(len(ids), dim)
                q = np.zeros((len(q_ids), wide), np.int64)
                q[:, :q_dim] = np.frombuffer(q_data, np.int64).reshape(len(q_ids), q_dim)
                if wide == 0:
                    x, q = np.zeros((len(ids), 1), np.int64), np.zeros((len(q_ids), 1), np.int64)
                # Doubles hold these sums exactly where they stay under 2^53.
                exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(wide, 1) < 2**53
                if exact:
                    x, q = x.astype(float), q.astype(float)
                shard, out = Shard(ids, x, block), ([], [], [])
                best = shard.top_many(q, q_ids, k, reached) if exact else (shard.top(row, own, k) for own, row in zip(q_ids.tolist(), q))
                for j, (own, (s, i)) in enumerate(zip(q_ids.tolist(), best)):
                    if exact and len(s) == k:
                        reached[j] = max(reached[j], s[-1])
                    out[0].append(np.full(len(s), own, np.int64))
                    out[1].append(i)
                    out[2].append(s.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    # Queries are the streamed side, so that all shards of a place follow on one block of them.
    pairs = asked.repartition(n, "place").join(shards.repartition(n, "place").hint("merge"), "place").select("ids", "data", "dim", "q_ids", "q_data", "q_dim")
    found = pairs.mapInArrow(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
QUALIFY rank <= 5"""
