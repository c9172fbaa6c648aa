"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redlight.llm import stages
from redlight.llm.common import table
from redlight.storage import discard, new_path, scratch, write_table

#: Each stage reads what its predecessor has written; all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("suffix_dedup", stages.cut_repeats),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Learned scores, hash fingerprints and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage writes on its way goes when its result is written, and that
    goes when the next stage's is; the last table stays for the caller to read. If a stage
    raises, nothing stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_path(spark, f"stage-{name}")
        try:
            with scratch(spark):
                docs = write_table(stage(spark, docs, sf_dir), at)
        except BaseException:
            discard(spark, at)
            raise
        finally:
            if before:
                discard(spark, before)
        before = at
    return docs
