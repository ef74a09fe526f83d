"""Writers: fixed-decimal text, result documents, split folders, incremental result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.sources.python_sources import new_version, published_files, register

VERSION = "_version"


def fixed_decimals(value: Column, decimals: int) -> Column:
    """Text with so many decimals, rounded from the exact value of the double as C and Python do.

    ``format_string`` rounds the shortest digits that name the double, so it takes 0.00015 up although the double is below it. Numbers
    without a fraction, NaN and infinity are written by ``format_string``, NULL as the word null.
    """
    plain = F.format_string(f"%.{decimals}f", value)
    exact = F.call_function("format_number", value, F.lit("0." + "0" * decimals if decimals else "0"))
    return F.when(F.abs(value) < 2.0**53, exact).when(value.isNull(), F.lit("null")).otherwise(plain)


def fixed_line(cols: dict[str, int | None]) -> Column:
    """One comma-separated line; a number gives the decimals, None leaves the value as it is."""
    parts = [F.col(c).cast("string") if d is None else fixed_decimals(F.col(c), d) for c, d in cols.items()]
    return F.concat_ws(", ", *parts)


def write_fixed_text(df: DataFrame, path: str, cols: dict[str, int | None], keys: Sequence[str], order: Sequence[str]) -> None:
    """Text files per key folder, rows ordered within each file."""
    lines = df.select(*keys, *order, fixed_line(cols).alias("value"))
    (lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "value")
     .write.partitionBy(*keys).mode("overwrite").text(path))


# Entry keys of the results document, by column.
DOC_KEYS = {"frechet": "min_frechet_m", "out_pct": "corridor_violation_pct", "mean_excess": "mean_excess_m", "mean_excess_out": "mean_excess_when_out_m"}


def results_doc(segments: DataFrame, quality: DataFrame, averages: DataFrame, jitter: DataFrame, jitter_averages: DataFrame,
                keys: Sequence[str]) -> DataFrame:
    """One nested document per scenario (``keys``); the sections hold one entry per run or method."""
    keys = list(keys)

    def section(df, name):
        value = lambda c: F.concat(F.lit("run"), F.col(c).cast("string")) if c == "min_frechet_vs" else F.col(c)
        entry = F.struct(*[value(c).alias(DOC_KEYS.get(c, c)) for c in df.columns if c not in keys])
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias(name))

    out = segments.select(*keys, F.struct("start_m", "end_m", "length_m").alias("segment"))
    sections = ((quality, "drive_quality"), (averages, "drive_quality_averages"), (jitter, "steering_jitter"), (jitter_averages, "steering_jitter_averages"))
    for df, name in sections:
        out = out.join(section(df, name), keys, "left").withColumn(name, F.coalesce(name, F.array()))
    return out.select(*keys, F.to_json(F.struct(
        "segment", "drive_quality", "drive_quality_averages", "steering_jitter", "steering_jitter_averages")).alias("value"))


def write_results_doc(doc: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """One document per line, in one folder per scenario where ``keys`` name one."""
    out = doc.select(*keys, "value").write.mode("overwrite")
    (out.partitionBy(*keys) if keys else out).text(path)


def write_splits(rows: DataFrame, path: str, keys: Sequence[str] = ("bag", "split")) -> None:
    """One folder per recording and split."""
    rows.write.partitionBy(*keys).mode("overwrite").parquet(path)


def incremental_results(frames: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str],
                        force: bool = False) -> DataFrame:
    """Compute results only for keys without a stored one; returns all stored results.

    ``force`` recomputes every key of ``frames`` and touches no other. A write is staged by its tasks and published by one
    manifest at the end; rows carry the version of their write, and of each key the newest version counts. So a killed writer
    leaves nothing, and two writers of the same keys leave each key once.
    """
    spark = frames.sparkSession
    stored = None if force else stored_results(spark, path, keys)
    todo = frames if stored is None else frames.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    write_results(compute(todo), path)
    return stored_results(spark, path, keys)


def write_results(results: DataFrame, path: str) -> str:
    """Publish one version of results; the version is returned."""
    register(results.sparkSession)
    version = new_version()
    rows = results.withColumn(VERSION, F.lit(version))
    rows.write.format("versioned_results").option("version", version).option("path", path).mode("append").save()
    return version


def stored_results(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The newest rows of every key among the published writes, None if nothing is stored."""
    files = published_files(path)
    if not files:
        return None
    rows = spark.read.parquet(*files)
    newest = rows.groupBy(*keys).agg(F.max(VERSION).alias(VERSION))
    return rows.join(newest, [*keys, VERSION], "left_semi").drop(VERSION)
