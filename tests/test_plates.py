import pytest
from pyspark.sql import functions as F

from redlight.functions import plates as p


def one(spark, col, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"{c} string" for c in "abc"[: len(texts)]))
    return df.select(col).first()[0]


@pytest.mark.parametrize(("text", "want"), [("1234BCD", "1234-0800"), ("AB1234", "AB-1234"), ("A-12", "A-0012"), ("ABC-12", "ABC-0012"), ("8V-5256", "BV-5256"), ("ABCDEFGHJ", ""), ("", "")])
def test_region_normalise(spark, text, want):
    # ABCDEFGHJ is longer than eight; letters of a current plate's suffix become digits.
    got = one(spark, p.region_normalise("a"), text)
    assert got == want


@pytest.mark.parametrize(("f", "text", "want"), [
    (p.clean_plate, " ab-1 2", "AB12"), (p.pattern_key, "AB-12*", "LL-NN"), (p.complies_7, "AB12CDE", True), (p.complies_7, "AB1ZCDE", False), (p.format_7, "0BO2CD5", "OB02CDS"),
    (p.valid_format, "ABC123", True), (p.valid_format, "AB1", False), (p.longest_digit_run, "A12B345C678", "345"), (p.fold_confusable, "ODQILJ", "000111"),
    (p.position_correct, "ABSO15", "AB501S"), (p.six_g, "6A6G66", "GA666G"), (p.split_correct, "A8C1O3", "ABC-103"), (p.format_break, "AB12", 2), (p.format_break, "ABCD", 2), (p.format_break, "", 0),
    (p.valid_plate, "AB1234", True), (p.valid_plate, "ABCDEF", False),
])
def test_texts(spark, f, text, want):
    assert one(spark, f("a"), text) == want


@pytest.mark.parametrize(("f", "a", "b", "want"), [
    (p.plate_similarity, "AB-123", "ab123", 1.0), (p.plate_similarity, "", "A", 0.0), (p.plate_similarity, "ABC123", "AB", 0.0), (p.plate_similarity, "ABO123", "AB0123", 1 - 1 / 6 + 0.1 / 6),
    (p.dup_text_similarity, "AB-1234", "AB1234", 1.0), (p.dup_text_similarity, "AB1234", "CD1234", 0.85), (p.dup_text_similarity, "AB91234", "CD1234", 0.6 + 0.8 * 0.3), (p.dup_text_similarity, "ABI2", "AB12", 0.85),
    (p.pattern_similarity, "LLNN", "LLNNN", 0.8), (p.hamming, "ABC", "ABD", 1), (p.hamming, "ABC", "AB", None), (p.text_similar, "AB123", "A8123", True), (p.text_similar, "ABCDEF", "123456", False),
])
def test_pairs(spark, f, a, b, want):
    got = one(spark, f("a", "b"), a, b)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_fused_similarity(spark):
    rows = [(0.85, 0.0, 0.0, 0.85), (0.85, 0.0, 1.0, (0.6 * 0.85 + 0.1) / 0.7), (0.0, 0.9, 0.9, 0.85), (0.5, 0.8, 0.0, (0.5 * 0.5 + 0.4 * 0.8) / 0.9)]
    df = spark.createDataFrame(rows, "s double, i double, t double, want double")
    for got, want in df.select(p.fused_similarity("s", "i", "t"), "want").collect():
        assert got == pytest.approx(want)


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "a string")
    row = df.select(p.clean_plate("a"), p.valid_format("a"), p.valid_plate("a"), p.plate_similarity("a", F.lit("x")), p.pattern_coherence("a")).first()
    assert tuple(row) == (None, False, False, 0.0, 0.0)


def test_context_correct_names_each_step_once(spark):
    """a step that is named in several places was evaluated in each of them."""
    done = spark.createDataFrame([("AB1234",)], "text string").select(p.context_correct("text", F.lit(0.005)).alias("c"))
    assert done._jdf.queryExecution().analyzed().toString().count("regexp_instr") <= 8
