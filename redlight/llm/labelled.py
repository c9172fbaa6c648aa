"""Bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample_rows: int, columns: list) -> tuple[DataFrame, float]:
    """``y`` (0.0 or 1.0) and the given columns of at most ``sample_rows`` labelled documents
    outside the held-out fold, and the logarithm of the odds that the draw took away.

    Labels that are null, other than 0 and 1, or contradict each other are left out. Each
    class may have half of the draw and what the other one leaves; within it rows are drawn
    by a hash of their id. A model fitted on the rows adds the second value to its log-odds.
    The drawn ids are few by construction, so they are broadcast and texts are not shuffled.
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
        .select(F.col("doc_id").alias("_id"), F.col("_y").cast("double").alias("y"))
    )
    have = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = have.get(0.0, 0), have.get(1.0, 0)
    half = sample_rows // 2
    take = {0.0: min(n0, max(half, sample_rows - n1)), 1.0: min(n1, max(sample_rows - half, sample_rows - n0))}
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(k) for y, k in take.items()]
    drawn = parts[0].unionByName(parts[1])
    odds = math.log(n1 / n0) - math.log(take[1.0] / take[0.0]) if n0 and n1 and take[0.0] and take[1.0] else 0.0
    return docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("y", *columns), odds


def once(rows: DataFrame, *also: str) -> DataFrame:
    """``y, text`` of each distinct text; texts with both labels are left out."""
    keys = ["text", *also]
    return rows.groupBy(*keys).agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").select("y", *keys)
