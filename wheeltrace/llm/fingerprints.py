"""Document fingerprints: bottom-k sketches of word-shingle hashes (operator 9, built-in functions only).

A sketch holds the k smallest distinct 63-bit hashes of a text's five-word shingles. Sketches of
parts merge into the sketch of the whole; two sketches estimate resemblance and containment, one
sketch the number of distinct shingles. A text with fewer than k shingles is held completely, and
all estimates about such texts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.registry import query
from wheeltrace.operators.ordered import dense_number
from wheeltrace.session import materialize

K = 128
SHINGLE = 5
ROWS = 512        # documents looked up together for the following document
BORDERS = 50_000  # buckets at most; with more rows the buckets grow
COPIES = 64       # equal rows that stay together


def add_sketch(df: DataFrame, text_col: str, name: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Add the bottom-k sketch of a text column as a sorted array of longs.

    Words are separated by white space. A text of fewer words than a shingle has one shingle of all
    its words; a text without words, or null, has an empty sketch. Equal texts have equal sketches.
    """
    w, h = f"_w_{name}", f"_h_{name}"
    split = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
    shingle = F.transform(starts, lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(F.col(w), i + j) for j in range(words)]), 1))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(h, F.when(F.size(w) > 0, shingle).otherwise(none))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(h)), 1, k)).drop(w, h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shares(a: Column, b: Column, of: Column | None, k: int) -> Column:
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    base = F.size(union) if of is None else F.size(F.array_intersect(union, of))
    return F.when(base > 0, both / base)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; two empty sets are alike (1)."""
    return F.coalesce(_shares(a, b, None, k), F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; null where the sketch cannot tell."""
    return _shares(a, b, a, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, -1).cast("double") / float(1 << 63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def merge_parts(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Values are made distinct and limited to the k smallest of a key before and after the shuffle, so a key with very many parts is no burden.
    """
    values = df.select(*keys, F.explode(sketch_col).alias("_v")).distinct()
    first = Window.partitionBy(*keys).orderBy("_v")
    kept = values.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias(sketch_col))


def _hex_order(number: Column) -> Column:
    """A long as text of 16 digits in the same order."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def with_following(df: DataFrame, id_col: str, text_col: str, rows: int = ROWS, copies: int = COPIES) -> DataFrame:
    """Bring every row together with the text that follows it in descending id order.

    Returns the rows with ``_bucket``, ``_salt``, ``_own``, ``_turn`` and ``_key``, distributed by bucket and salt, such that a
    window over these two ordered by (``_turn``, ``_key`` descending) has the following row next; a row without
    one is followed by an equal row. The distinct pairs of id and text hash are numbered, and ``rows`` neighbours make a bucket
    whatever the ids are; the first row of the bucket below is copied in, and the first row of all behind the last. Equal
    ids follow each other by text hash; null ids come last. A row repeated more than ``copies`` times is dealt to several salts.
    """
    number = F.col(id_col).cast("long")
    key = F.concat(F.when(number.isNull(), "0").otherwise("1"), _hex_order(F.coalesce(number, F.lit(0))), _hex_order(F.bitwise_not(F.xxhash64(text_col))))
    pairs = materialize(df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    rows = max(rows, math.ceil(pairs.count() / BORDERS))
    numbered = dense_number(pairs.select("_key"), [], ["_key"], "_pos")
    last = numbered.agg(F.max("_pos")).first()[0] or 0
    ends = materialize(numbered.where((F.col("_pos") % rows).isin(0, rows - 1) | (F.col("_pos") == last)), "borders")
    starts = sorted(r[0] for r in ends.where(F.col("_pos") % rows == 0).select("_key").collect())  # a bounded number of short keys
    list_ = F.split(F.lit(",".join(starts)), ",")
    # the last start that is not above the key, by halving
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(starts)).bit_length()))])
    bucket = F.aggregate(halves, F.lit(0), lambda at, step: F.when(
        (at + step < len(starts)) & (F.get(list_, at + step) <= F.col("_key")), at + step).otherwise(at)).cast("long")
    below = ends.where(((F.col("_pos") + 1) % rows == 0) & (F.col("_pos") < last)).select(
        "_key", F.expr(f"(_pos + 1) div {rows}").cast("long").alias("_bucket"), F.lit(0).alias("_turn"))
    around = ends.where(F.col("_pos") == last).select("_key", F.lit(0).cast("long").alias("_bucket"), F.lit(1).alias("_turn"))
    often = pairs.where(F.col("_n") > copies).select("_key", F.ceil(F.col("_n") / copies).cast("long").alias("_salts"))
    rows_ = df.withColumn("_key", key)
    own = rows_.withColumn("_draw", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(often), "_key", "left")
    own = own.select(*df.columns, "_key", bucket.alias("_bucket"), F.lit(0).alias("_turn"), F.lit(True).alias("_own"),
                     F.coalesce(F.pmod("_draw", "_salts"), F.lit(0).cast("long")).alias("_salt"))
    # a further salt holds one repeated row alone
    own = own.withColumn("_bucket", F.when(F.col("_salt") == 0, F.col("_bucket")).otherwise(F.xxhash64("_key")))
    next_ = rows_.join(F.broadcast(below.unionByName(around)), "_key").dropDuplicates(["_bucket"])
    next_ = next_.withColumns({"_own": F.lit(False), "_salt": F.lit(0).cast("long")})
    return own.unionByName(next_).repartition("_bucket", "_salt")


def hexed(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every text and its edited text (see ``with_following`` for the following document).

    The edited text has the last third of the code points replaced by the first as many (or all) of
    the following document. Null text counts as empty; repeated rows give a row each; an empty table
    an empty result; other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near = add_sketch(with_following(docs, "doc_id", "text"), "text", "sketch", k)
    order = Window.partitionBy("_bucket", "_salt").orderBy("_turn", F.desc("_key"))
    near = near.select("*", *[F.coalesce(F.lead(c).over(order), F.col(c)).alias(name) for c, name in (("text", "_next"), ("sketch", "next_sketch"))])
    near = near.where("_own").withColumn("n_chars", F.length("text").cast("long"))
    edited = "concat(substring(text, 1, int(n_chars - n_chars div 3)), substring(_next, 1, int(n_chars div 3)))"
    near = near.withColumn("edited", F.expr(edited)).drop("_next", "text")
    near = add_sketch(near, "edited", "edited_sketch", k)
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch", "next_sketch")


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir) -> DataFrame:
    out = fingerprint_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed("sketch").alias("fingerprint"),
        hexed("edited_sketch").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"))
