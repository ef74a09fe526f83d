"""Line dedup by winnowing over line hashes (operator 10, built-in functions only).

Windows are measured in words: the window of a line holds the lines that start within the next
``min_words`` words. The smallest hash of each window is a fingerprint, so any two equal runs of
lines with ``min_words`` words or more share one at the same place. Around the fingerprints that occur
more than once, whole windows are compared: the shortest one of ``min_words`` words from each line on,
and the shortest one up to each line. Every line of a repeated run lies in such a window inside the
run, so a line is deleted exactly if it lies in a run of ``min_words`` words or more that equals one
run that begins earlier, line by line. The first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.registry import query
from wheeltrace.session import materialize

MIN_WORDS = 40
# fixed values: white space of all kinds
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# letters of scripts without blanks between words: each counts as a word
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
UNUSUAL = r"[\x{85}\xA0\x{E00}-\x{10FFFF}]"  # a line without these has only ASCII blanks and no such script


def word_count(line: Column) -> Column:
    """Words of a trimmed line that is not empty: pieces between white space; a letter of a script without blanks is a word."""
    any_script = F.regexp_count(F.regexp_replace(line, f"({UNSPACED})", " $1 "), F.lit(r"(?U)\S+"))
    return F.when(line.rlike(UNUSUAL), any_script).otherwise(F.regexp_count(line, F.lit(r"\S+"))).cast("long")


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """Non-blank lines of (doc, tag, text) with words, hash and whether winnowing selects them; texts of fewer words are left out.

    Lines are split, trimmed, counted and hashed where the texts are read; only those numbers travel.
    """
    lines = docs.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc", "tag", "line_no", F.trim(F.col("line"), F.lit(BLANKS)).alias("line")).where("line != ''")
    lines = lines.select("doc", "tag", "line_no", word_count(F.col("line")).alias("words"), F.xxhash64("line").alias("h"))
    # repeated rows are one document: none of them is a copy of the other
    lines = lines.repartition("doc", "tag").distinct()
    place = Window.partitionBy("doc", "tag").orderBy("line_no")
    lines = lines.select(
        "*", (F.sum("words").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"),
        F.sum("words").over(Window.partitionBy("doc", "tag")).alias("total")).where(F.col("total") >= min_words)
    by_word = Window.partitionBy("doc", "tag").orderBy("before")
    lines = lines.withColumn("least", F.when(
        F.col("total") - F.col("before") >= min_words, F.min("h").over(by_word.rangeBetween(0, min_words - 1))))
    lines = lines.withColumn("highest", F.max("least").over(by_word.rangeBetween(-(min_words - 1), 0)))
    return lines.select("doc", "tag", "line_no", "words", "h", (F.col("highest") == F.col("h")).alias("selected"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of ``min_words`` words from and up to each line that hold a ``seed``: (doc, tag, first_line, last_line, low, code).

    ``low`` and ``code`` are hashes of the lines of the run alone, wherever it lies.
    """
    place = Window.partitionBy("doc", "tag").orderBy("line_no")
    lines = lines.withColumn("after", F.sum("words").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("after") - F.col("words"))
    on = Window.partitionBy("doc", "tag").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc", "tag").orderBy("after").rangeBetween(-(min_words - 1), 0)

    def run(over):
        return F.when(F.max("seed").over(over), F.struct(
            F.min("line_no").over(over).alias("first_line"), F.max("line_no").over(over).alias("last_line"),
            F.sum("words").over(over).alias("n"), F.collect_list("h").over(over).alias("hs")))

    lines = lines.select("doc", "tag", "words", run(on).alias("on"), run(back).alias("back"))
    found = lines.select("doc", "tag", F.explode(F.array_compact(F.array(
        F.when(F.col("on.n") >= min_words, F.col("on")),
        # without its last line still long enough: not the run of its first line
        F.when(F.col("back.n") - F.col("words") >= min_words, F.col("back"))))).alias("w"))
    return found.select(
        "doc", "tag", "w.first_line", "w.last_line", F.array_min("w.hs").alias("low"), F.xxhash64("w.hs").alias("code"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of lines to delete: (doc, tag, first_line, last_line); runs of a text do not overlap."""
    lines = materialize(fingerprints(docs, min_words), "lines")
    chosen = lines.where("selected")
    twice = materialize(chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    seeds = materialize(chosen.join(twice, "h", "left_semi").select(
        F.col("doc").alias("_d"), F.col("tag").alias("_t"), F.col("line_no").alias("_l")), "seeds")
    on = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t"))
    near = lines.join(seeds.select("_d", "_t").distinct(), on, "left_semi")
    near = near.join(seeds, on & (F.col("line_no") == F.col("_l")), "left").select(
        "doc", "tag", "line_no", "words", "h", F.col("_l").isNotNull().alias("seed"))
    runs = materialize(windows(near, min_words), "windows")
    at = F.struct("doc", "tag", "first_line")
    first = runs.groupBy("low", "code").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.drop("n"), "first")
    late = runs.join(first, ["low", "code"]).where(F.col("first") < at)
    # overlapping runs become one
    order = Window.partitionBy("doc", "tag").orderBy("first_line", "last_line")
    reach = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    late = late.withColumn("cut", F.when(F.col("first_line") <= reach, 0).otherwise(1))
    late = late.withColumn("run", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return late.groupBy("doc", "tag", "run").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later repeated runs of lines; all columns are kept, ``removed_lines`` is added.

    A deleted run equals, line by line, one run that begins earlier, in another document or in the same one (there the
    two may overlap: of a line repeated many times in a row only the first ones stay, at least one).
    Documents are ordered by id (null first), lines by place. Lines are compared without outer white space
    of any kind; words are the pieces between white space, and single letters of scripts without blanks; blank lines do not interrupt a run and go with it. Null texts stay
    null, texts without a repeated run stay as they are, and a text whose lines all go becomes empty.
    Repeated rows (same id and text) count as one document and get the same result. A column named
    ``removed_lines`` is replaced; other names cannot clash.
    """
    kept = [c for c in df.columns if c != "removed_lines"]
    # the caller's columns travel in one struct, so that none can clash with those used here
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    held = held.withColumn("tag", F.xxhash64("text"))
    runs = repeated_runs(held.where("text is not null").select("doc", "tag", "text"), min_words)
    gone = runs.groupBy(F.col("doc").alias("_d"), F.col("tag").alias("_t")).agg(
        F.array_sort(F.collect_list(F.struct("first_line", "last_line"))).alias("gone"))
    out = held.join(gone, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    cut = F.aggregate("gone", F.lit(0), lambda n, run: n + run["last_line"] - run["first_line"] + 1)

    def left(lines):
        """What lies before, between and behind the runs, each part copied once."""
        def part(k):
            start = F.coalesce(F.get("gone", k - 1)["last_line"] + 1, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get("gone", k)["first_line"], F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), part)), "\n")

    # the lines are an element of a list, so that the text is split once
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), left)[0])
    return out.select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept],
        F.coalesce(cut, F.lit(0)).alias("removed_lines"))


# the rule itself: all shortest runs of enough words from and up to every line, compared as texts
_SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ON = f"(PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)"
_BACK = f"(PARTITION BY doc_id, text ORDER BY after RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)"
_SQL = f"""
WITH l AS (
  SELECT doc_id, text, line_no, regexp_replace(regexp_replace(line, '^{_SPACES}+', ''), '{_SPACES}+$', '') AS line FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
), a AS (
  SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(line, '([\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}])', ' \\1 ', 'g'),
    '{_SPACES}+'), lambda x: x <> '')) AS words FROM l WHERE line <> ''
), b AS (
  SELECT *, sum(words) OVER w - words AS before, sum(words) OVER w AS after
  FROM a WINDOW w AS (PARTITION BY doc_id, text ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), c AS (
  SELECT doc_id, text, min(line_no) OVER {_ON} AS first_line, max(line_no) OVER {_ON} AS last_line, sum(words) OVER {_ON} AS n, list(line) OVER {_ON} AS run FROM b
  UNION ALL
  SELECT doc_id, text, min(line_no) OVER {_BACK}, max(line_no) OVER {_BACK}, sum(words) OVER {_BACK}, list(line) OVER {_BACK} FROM b
), d AS (
  SELECT *,
    first_value(struct_pack(d := doc_id, t := text, l := first_line)) OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, first_line) AS prime FROM c WHERE n >= {MIN_WORDS}
), k AS (
  SELECT doc_id, text, list_distinct(flatten(list(range(first_line, last_line + 1)))) AS gone FROM d WHERE prime IS DISTINCT FROM struct_pack(d := doc_id, t := text, l := first_line) GROUP BY doc_id, text
)
"""
_LEFT = """array_to_string([x[2] FOR x IN list_zip(range(len(string_split(t.text, chr(10)))), string_split(t.text, chr(10)))
    IF NOT list_contains(k.gone, x[1])], chr(10))"""


@query("op10_line_dedup", _SQL + f"""
SELECT t.doc_id, CASE WHEN k.gone IS NULL THEN t.text ELSE {_LEFT} END AS text,
  CAST(coalesce(len(k.gone), 0) AS INT) AS removed_lines FROM documents t LEFT JOIN k ON t.doc_id = k.doc_id AND t.text = k.text
""")
def op10_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
