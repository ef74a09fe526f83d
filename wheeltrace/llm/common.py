"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.operators.grouping import star_components
from wheeltrace.session import materialize

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Default vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def fold(col: str | Column, parts: int = 5) -> Column:
    """Fold of a row: the remainder of the CRC-32 of its id as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % parts


def slices(batch: pa.RecordBatch, text: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text; a longer row stays alone."""
    col = batch.column(batch.schema.get_field_index(text))
    at = 0
    while at < batch.num_rows:
        n, rows = 0, 0
        while at + rows < batch.num_rows and (rows == 0 or n < most):
            value = col[at + rows]
            n += value.as_buffer().size if value.is_valid else 0
            rows += 1
        yield batch.slice(at, rows)
        at += rows


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to one record batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (``a``, ``b``) between longs: one row (``node``, ``comp``) per node.

    ``comp`` is the smallest node. The rounds grow with the logarithm of the longest chain.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = star_components(ends)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return materialize(stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots), "label")
