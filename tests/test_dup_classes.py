"""Groups of reads without pictures are those that all pairs make, however near in time."""

import random

from redlight.operators import reads
from redlight.storage import materialize


def rows(rnd, n):
    plates = ["AB1234", "A81234", "XY1234", "XY234", "ZZ51234", "Q99912345678", "Q12345678", "ZZ999", "ZZ9Q", "2Z99", "Q7", "07", ""]
    return [(i, rnd.choice(plates), rnd.choice([None, rnd.randrange(40) / 2, rnd.randrange(8) / 4, rnd.randrange(8) / 4]) if i % 3 else rnd.randrange(8) / 4, i % 40) for i in range(n)]


def test_classes_are_the_groups_of_all_pairs(spark):
    """also where reads have no time, which were lost before."""
    df = materialize(spark.createDataFrame(rows(random.Random(5), 400), "read_id long, text string, t double, camera long"), "reads")
    pairs = materialize(reads.dup_pairs(df, ["camera"], 0.5), "pairs")
    for least in (0.8, 0.83):
        want = sorted(map(tuple, reads.dup_groups(pairs, least).select("node", "root").collect()))
        assert want and sorted(map(tuple, reads.dup_classes(df, ["camera"], least).select("node", "root").collect())) == want


def test_plates_of_one_run_cost_no_pairs(spark):
    """many spellings with the same digits are one node, not pairs."""
    df = spark.createDataFrame([(i, f"{chr(65 + i // 26)}{chr(65 + i % 26)}1234", float(i), 0) for i in range(400)], "read_id long, text string, t double, camera long")
    written = []
    keep, reads.materialize = reads.materialize, lambda d, name: written.append((name, materialize(d, name))) or written[-1][1]
    try:
        assert reads.dup_classes(df, ["camera"]).select("root").distinct().count() == 1
    finally:
        reads.materialize = keep
    assert max(d.count() for _, d in written) <= 400


def test_pairs_at_the_border_count(spark):
    """0.825 * 6/7 + 0.3/7 is 0.75, whatever the times' last bits."""
    for k in (0, 11, 77, 1003, 7001):
        df = spark.createDataFrame([(1, "AB1234", k / 10, 0), (2, "CD234", (k + 35) / 10, 0), (3, "CD234", (k - 35.1) / 10, 0)], "read_id long, text string, t double, camera long")
        assert reads.dup_pairs(df, ["camera"], 0.75).where("a = 1").select("b").collect() == [(2,)]


def test_pairs_are_made_within_tasks(spark, monkeypatch):
    """reads of a node travel as lists; what is sent does not grow with the pairs."""
    monkeypatch.setattr(reads, "BLOCK", 4)
    given = [(i, x, t, i % 2) for i, x, t, _ in rows(random.Random(3), 200)]
    df = materialize(spark.createDataFrame(given, "read_id long, text string, t double, camera long"), "reads")
    pairs = reads.dup_pairs(df, ["camera"], 0.75)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(_b") < plan.index("Exchange")
    from redlight.functions import plates as p

    every = df.selectExpr("camera", "read_id a", "text ta", "t da").join(df.selectExpr("camera", "read_id b", "text tb", "t db"), "camera").where("a < b and ta <> '' and tb <> ''")
    every = every.withColumn("s", p.fused_similarity(p.dup_text_similarity("ta", "tb"), reads.F.lit(0.0), p.time_similarity(reads.F.col("da") - reads.F.col("db")))).where("round(s, 9) >= 0.75")
    want = sorted((r["a"], r["b"], round(r["s"], 9)) for r in every.collect())
    assert want and sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in pairs.collect()) == want


def test_rounding_is_the_decimals(spark):
    """numbers are rounded without decimals wherever their last place is clear."""
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    values = [rnd.random() for _ in range(3000)] + [k / 20000 for k in range(20001)] + [0.0, 1.0, 0.74995, 0.75 - 5e-10, 0.75 - 6e-10]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where((reads.rounded(F.col("v"), 4) != F.round("v", 4)) | ((F.col("v") >= reads.border(0.75)) != (F.round("v", 9) >= 0.75))).count() == 0
