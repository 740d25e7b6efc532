"""Operators as corpus stages: (spark, docs, sf_dir) -> DataFrame with the columns of ``docs``.

All read doc_id and text; other columns travel along unread, whatever their names. A
null text counts as empty; very long texts are treated whole; an empty table gives an
empty result. doc_id is the key: rows that repeat one share its fate. Rows without
doc_id are never dropped as copies or contaminated, and keep their lines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, linededup, neardup, packing, toxicity
from fieldloom.llm.common import stage, table

#: Rejected ids up to which they are broadcast (some 50 MB).
BROADCAST_IDS = 1_000_000
#: Similarity, in percent, from which the near-duplicate stage links documents.
STAGE_PERCENT = 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id); rows without doc_id stay."""
    ids = stage(ids.select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by models learned from the labels of ``docs``' own documents.

    Null and empty texts are toxic only if most labelled ones are. Of rows that repeat a
    doc_id all go if one is predicted toxic. Rows without doc_id stay. Without labels all
    stay.
    """
    return without(docs, toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; one that loses all its text goes.

    Null and empty texts, which lose nothing, stay. n_chars, if there is one, follows the
    text. Rows that repeat a doc_id lose lines at the same places.
    """
    out = linededup.drop_recurring_lines(docs)
    out = out.filter((F.col("n_dropped") == 0) | (F.trim(F.coalesce(F.col("text"), F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, once.

    Null and empty texts have no shingles and all stay. Of equal rows that repeat a
    doc_id one stays; with different texts they are one document, and all stay or go.
    """
    columns = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rest = without(docs, neardup.near_duplicates(docs, STAGE_PERCENT).filter("not kept"))
    if any("map" in t or "variant" in t for t in columns.values()):
        return rest  # rows of such columns cannot be compared
    # rows that repeat a doc_id are few: only they are compared
    again = stage(rest.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return rest
    twice = rest.join(again, "doc_id", "left_semi").select(*docs.columns).distinct()
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited ones included; see ``decontaminate.matches``.

    Null and empty texts hold none. Of rows that repeat a doc_id all go if one holds an
    item. Without benchmark items all stay.
    """
    return without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents; see ``packing.pack_documents``.

    Null and empty texts are one piece of the end id. Repeated rows are pieces each, rows
    without doc_id too.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
