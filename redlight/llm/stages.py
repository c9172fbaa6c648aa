"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Every stage takes the columns of documents and any others, of whatever name, and returns
them as they were, but for what it cuts from ``text`` (and then ``n_chars``). Operators see
the row as one struct beside what they read, so no name can clash. ``doc_id`` names a
document but need not be unique: rows are told apart by their texts as well. Empty tables give
no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_copies, packing, suffix, toxicity
from .common import materialize, table, utf8
from .queries import tokenizer_path


def _read(docs: DataFrame, *read: str) -> DataFrame:
    """The columns ``read``, and the others as one struct ``row``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in read), F.lit(None).alias("_")).alias("row"), *read)


def _back(rows: DataFrame, docs: DataFrame, *read: str, **new) -> DataFrame:
    """The columns of ``docs`` again, some of them with new values."""
    return rows.select(*(new.get(c, F.col(c) if c in read else F.col("row")[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; empty ones and all others stay."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    clean = toxicity.score(_read(docs, "text"), model).where("predicted = 0").select("row", "text")
    return _back(clean, docs, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more, through any number
    of links) one document stays: that with the smallest id, null last; of rows with this id
    that with the smallest hash of its text, then of its other columns."""
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    at = lambda doc_id, key: F.struct(doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), key)
    named = docs.select(F.struct("*").alias("row"), at(F.col("doc_id"), F.md5(utf8("text"))).alias("at"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).alias("other"))
    first = near_copies.near_copies(docs, shingle=5, least=0.8).select(at(F.col("first.doc_id"), F.col("first.text_key")).alias("at")).distinct()
    kept = named.select("at", "other").join(first, "at").groupBy("at").agg(F.min("other").alias("other"))
    return named.join(kept, ["at", "other"]).dropDuplicates(["at", "other"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that start earlier elsewhere go from the texts, together
    with the rest of a character that a cut runs through. A document of which nothing is left
    goes; ``n_chars`` is that of the new text."""
    done = suffix.cut_repeats(_read(docs, "doc_id", "text"), characters=True)
    cut = F.size("removed") > 0
    new = {"text": F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _back(done.where(~cut | (F.octet_length("kept") > 0)), docs, "doc_id", **new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    mixed = mixing.mix(_read(docs, "doc_id", "source", "text")).where("copies > 0").select("row", "doc_id", "source", "text", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _back(mixed, docs, "doc_id", "source", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of whole texts, with their tokens (``ids``, little-endian unsigned 32 bits) and
    their place in sequences of 2048."""
    # A smaller cache than the operator's own: the executors of a pipeline hold more.
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), cache_rows=150_000)
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])
