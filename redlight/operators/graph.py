"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, new_path, write_table


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: every node has one neighbour, which has none above it."""
    nodes = e.groupBy("u").agg(F.count("*").alias("n"))
    inner = nodes.select("u", "n").join(e.select(F.col("v").alias("u")).distinct().withColumn("up", F.lit(True)), "u", "left")
    return inner.where("n > 1 or up").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``: root is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al.) until the edges are stars;
    every step is written to the shared folder, and the one before it goes.
    """
    spark = edges.sparkSession
    at = new_path(spark, "components")
    e = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), at)
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, at = at, new_path(spark, "components")
        e = write_table(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), at)
        discard(spark, before)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, root`` after some more pairs ``a, b``: only components that these join are gone
    through. A node that ``roots`` lacks is a component of its own until then."""
    top = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    pairs = materialize(pairs.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct(), "joined")
    nodes = roots.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node")).withColumn("root", F.col("node"))).distinct()
    lifted = nodes.join(components(pairs).toDF("root", "higher"), "root", "left")
    return lifted.select("node", F.coalesce("higher", "root").alias("root"))
