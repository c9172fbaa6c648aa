"""Token counts by a map-side two-tier lookup (no pre-token is ever shuffled).

Text is cut at every start of a run of white space. A byte-level BPE with the usual
pre-token pattern never joins characters across such a cut, so the counts of the chunks
add up to the count of the text; white space stays with the chunk that follows it.

Tier 1 is a table of the most frequent chunks with their lengths in tokens, of at most
``table_rows`` entries, broadcast to all workers. Tier 2 is a cache in each worker, of at
most ``cache_rows`` entries, filled by encoding what tier 1 lacks. Tier 1 is drawn
from bounded summaries that all tasks send of their chunks. Both change the speed only;
every text is counted whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceEncoder, piece_encoder
from .common import enter, materialize, partitions, utf8, worker_state

# White space in the sense of the tokenizer's pattern (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
CHUNK = f"[{_WS}]*[^{_WS}]+|[{_WS}]+"
#: Longer chunks are encoded each time and kept in no table.
KEPT_CHARS = 48


class Lengths(dict):
    """chunk -> number of tokens; a miss is encoded, and kept while there is room."""

    def __init__(self, encoder: PieceEncoder, frequent: dict[str, int], cache_rows: int):
        super().__init__(frequent)
        self.encoder, self.most = encoder, len(frequent) + cache_rows

    def __missing__(self, chunk: str) -> int:
        n = len(self.encoder.encode(chunk))
        if len(self) < self.most and len(chunk) <= KEPT_CHARS:
            self[chunk] = n
        return n


def _table(rows: list[tuple[int, Counter]], most: int) -> pa.RecordBatch:
    top = [(task, c.most_common(most)) for task, c in rows]
    return pa.RecordBatch.from_arrays([
        pa.array([t for t, _ in top], pa.int64()), pa.array([[c for c, _ in x] for _, x in top], pa.list_(pa.string())), pa.array([[n for _, n in x] for _, x in top], pa.list_(pa.int64())),
    ], names=["task", "chunks", "n"])


_SUMMARY = "task long, chunks array<string>, n array<long>"


def summaries(df: DataFrame, text: str, rows: int) -> DataFrame:
    """One row for each task: its ``rows`` most frequent chunks and how often they occur. Words
    are counted as bytes between spaces, and only the frequent ones are cut into chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        find, seen = re.compile(CHUNK).findall, Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(t.as_py().split(b" "))
                if len(seen) > 8 * rows:
                    seen = Counter(dict(seen.most_common(4 * rows)))
        found: Counter = Counter()
        for w, n in seen.most_common(2 * rows):
            if len(w) <= 4 * KEPT_CHARS:
                for c in find(" " + w.decode(errors="ignore")):
                    if len(c) <= KEPT_CHARS:
                        found[c] += n
        yield _table([(TaskContext.get().partitionId(), found)], rows)

    return df.select(utf8(text).alias("t")).mapInArrow(work, _SUMMARY)


def merged(found: DataFrame, most: int, fan: int = 16) -> DataFrame:
    """The summaries of ``fan`` tasks as one of at most ``most`` chunks, and these again, until
    one is left: rows are dealt by the number of their task, never by chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        task, held = None, Counter()
        for b in batches:
            for t, chunks, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t != task and task is not None:
                    yield _table([(task, held)], most)
                    held = Counter()
                task = t
                for c, k in zip(chunks, n):
                    held[c] += k
        if task is not None:
            yield _table([(task, held)], most)

    spark = found.sparkSession
    found = materialize(found, "summaries")
    while (found.agg(F.max("task")).first()[0] or 0) > 0:
        up = found.withColumn("task", F.floor(F.col("task") / fan)).repartition(partitions(spark), "task").sortWithinPartitions("task")
        found = materialize(up.mapInArrow(work, _SUMMARY), "summaries")
    return found


def frequent_chunks(df: DataFrame, text: str, sample_rows: int, table_rows: int) -> list[str]:
    """The most frequent chunks of all documents, at most ``table_rows``. What the table lacks,
    as summaries are bounded by ``sample_rows``, costs time only."""
    best: Counter = Counter()
    for r in merged(summaries(df, text, sample_rows), sample_rows).collect():
        best.update(dict(zip(r["chunks"], r["n"])))
    return [c for c, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:table_rows]]


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, sample_rows: int = 32_768, table_rows: int = 32_768, cache_rows: int = 600_000,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens. A long text is counted whole, chunk by
    chunk. Rows that repeat are each counted; a null id is passed on; an empty
    table gives no rows. ``sample_rows`` bounds every summary. Other columns are not read, so
    their names cannot clash.
    """
    spark = docs.sparkSession
    chunks = frequent_chunks(docs, text_col, sample_rows, table_rows)
    # Compact: the chunks in one string with their ends, and a short integer per length.
    encoder = piece_encoder(tokenizer_path)
    sizes = [len(encoder.encode(c)) for c in chunks]
    ends, at = [], 0
    for c in chunks:
        at += len(c)
        ends.append(at)
    key = uuid.uuid4().hex
    packed = spark.sparkContext.broadcast(("".join(chunks), pa.array(ends, pa.int32()), pa.array(sizes, pa.int16())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")

        def build() -> Lengths:
            text, ends, sizes = packed.value
            ends, sizes = ends.to_pylist(), sizes.to_pylist()
            return Lengths(piece_encoder(tokenizer_path), {text[a:b]: n for a, b, n in zip([0, *ends], ends, sizes)}, cache_rows)

        lengths = worker_state(f"lengths {key}", build)
        find, look = re.compile(CHUNK).findall, lengths.__getitem__
        for b in batches:
            n = [sum(map(look, find(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
