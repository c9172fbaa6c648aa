"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, periodic, quality_fm, quality_rules, resampling, signature_tree, simhash, suffix, tokens, topk, toxicity, warc
from .common import fold, materialize, new_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: an exact round trip through files."""
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: needs the tokenizer."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    digests = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(digests, ["doc_id", "piece", "ids_crc32"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: XXH64 fingerprints."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: a learned score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once, for their sizes.
    mixed = mixing.mix(materialize(mixing.sized(table(spark, sf_dir, "documents")), "sized"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: a learned score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    params = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, params).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: every window of every text would be a row."""
    cut = suffix.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda x, y: x + y["length"]), F.lit(0).cast("long"))
    return cut.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: needs the tokenizer."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.similar_sets(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL: every repetition of every text."""
    found = periodic.periodic_runs(periodic.with_loops(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), periodic.longest("runs").alias("best"))
    length, period = F.col("best.length"), -F.col("best.less")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_pack, op3_simhash, op4_toxicity, op5_quality_rules, op6_top_k, op7_mix, op8_quality_fm, op9_suffix_dedup, op10_token_counts, op11_resample, op12_jaccard_join, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.oracle_sql(), "op6_top_k": topk.ORACLE_SQL, "op7_mix": mixing.oracle_sql(), "op11_resample": resampling.ORACLE_SQL, "op12_jaccard_join": signature_tree.ORACLE_SQL}
