"""The corpus pipeline: documents that pass from stage to stage as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import stages
from loomwork.llm.shared import discard, scratch, stored, table

#: (name, function): each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("bpe_encode", stages.bpe_encode),
]

#: SQL can't express the learned and the hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again; what it no longer needs, its predecessor's rows too, is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = stored(stage(spark, before, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        discard(before)
    return docs
