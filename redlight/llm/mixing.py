"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Sources share the words of all documents by weight; a target stops at ``most`` times its
source's words and the excess is shared anew. Every document of a source then expects
target / words copies. Their prefix sums run through the source in a fixed order; with one
random offset added, a document is emitted once for each whole number that its step crosses.

Within a source documents are ordered by size class, so that every stretch of the sums takes
its share of long and short ones, then by a hash of their id. Prefix sums run within ranges
of the hash (buckets) and over the buckets' totals, so no task needs a whole source; the
number of buckets follows that of partitions and has no part in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, partitions, unwrapped, wrapped


def n_words(text_col: str) -> Column:
    bare = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 17) -> DataFrame:
    """``source, words`` -> with ``target`` and ``offset`` (0 to 1). One row per source, so that
    its windows run in one task: sources are taken to be few (thousands, not billions).

    Weights repeat along the sources by code point, null last. A source without words has
    target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("_pos", F.row_number().over(order))
    rows = rows.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("_cap", F.col("words") * float(most))
    # In the order in which caps are met: what is left for this and all later sources.
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_pos")
    left = F.sum("words").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    rows = rows.withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.coalesce(level, F.lit(0.0))))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary"))
    rows = rows.withColumn("offset", F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / 4294967296.0)
    return rows.drop("_pos", "_w", "_cap", "_level")


def place(doc_id: Column, text: Column) -> Column:
    """32 bits of a hash of the id (null: of the text), as a long."""
    mark = F.coalesce(doc_id.cast("string"), F.concat(F.lit("n"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place``: what :func:`mix` needs of a document but its text."""
    return docs.select("doc_id", "source", n_words("text").alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, copies``; one row each.

    ``docs`` has ``doc_id, source, text``, or is a table made by :func:`sized`. Null text has
    size 0, long ones count whole; a null source is a source of its own. Rows that repeat are
    rows of their own; such rows with equal id, size and text are interchangeable. Columns of
    ``docs`` that are named like the new ones give way to them. An empty table gives no rows.
    """
    ready = {"size", "place"} <= set(docs.columns) and "text" not in docs.columns
    size, at = (F.col("size"), F.col("place")) if ready else (n_words("text"), place(F.col("doc_id"), F.col("text")))
    bits = max(6, (4 * partitions(docs.sparkSession) - 1).bit_length())
    rows = wrapped(
        docs, source=F.col("source"), key=F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), id=F.col("doc_id"), size=size, place=at,
    ).withColumns({"kind": F.length(F.bin("size")), "bucket": F.shiftright("place", 32 - bits)})
    keys = ["key", "kind", "bucket"]
    buckets = materialize(rows.groupBy("source", *keys).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "buckets")
    plan = targets(buckets.groupBy("source", "key").agg(F.sum("words").alias("words")), weights, most, seed)
    before = Window.partitionBy("key").orderBy("kind", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    base = materialize(base.join(plan.select("key", F.col("words").alias("source_size"), "target", "offset"), "key"), "mix-plan")
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*keys).orderBy("place", "id", "size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = rows.join(base, keys).withColumns({"rank": rank, "rate": rate})
    crossed = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    return unwrapped(out, docs, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=crossed.cast("long"))


def oracle_sql(weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 17) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n' || coalesce(text, ''))), 1, 8))::UBIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, {list(weights)}[((pos - 1) % {len(weights)}) + 1]::DOUBLE AS w, words * {float(most)}::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(words) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, w * coalesce(max(CASE WHEN cap > w * level THEN level END) OVER (), 0.0)) AS target,
  ('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS u FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), place, doc_id NULLS FIRST, size) AS q FROM d),
j AS (SELECT r.doc_id, r.size, t.words, t.target, t.u, r.q, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0 END AS e FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target, (floor(e * q + u) - floor(e * (q - 1) + u))::BIGINT * size AS taken FROM j"""
