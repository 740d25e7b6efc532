"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import stages
from fieldloom.llm.common import stage, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_lines),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("packing", stages.pack_rest),
]

#: Models, sketches and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage kept; each stage is written and read again.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and further
    columns: see ``fieldloom.llm.stages``.
    """
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
