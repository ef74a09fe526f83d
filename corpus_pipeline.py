"""Corpus pipeline: language ID, line dedup, near-duplicate join, benchmark decontamination, packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents.
All but the last return the columns of ``documents``. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.decontaminate import remove_leaks
from wheeltrace.llm.langid import keep_identified, train_on
from wheeltrace.llm.line_dedup import dedup_lines
from wheeltrace.llm.ngram_join import keep_first
from wheeltrace.llm.packing import pack_documents
from wheeltrace.session import materialize

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from these documents' own labels."""
    return keep_identified(docs, train_on(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; a document may become empty, it stays."""
    out = dedup_lines(docs).drop("removed_lines")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of copies and near copies."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
