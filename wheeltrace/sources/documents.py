"""Writers of the documents that the readers take, one file per recording, map or split, and the stored scenario segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.sources.python_sources import write_files
from wheeltrace.sources.readers import file_key
from wheeltrace.sources.sinks import fixed_line

# fixed values: names of a car's fields in a document, header lines of the text files
CAR_FIELDS = ("id", "x", "y", "z", "length", "width", "height", "yaw", "count", "conf", "side", "orient")
CLUSTERS_HEAD = "# cluster_id, x, y, z, count, conf, orientation, side"
BOXES_HEAD = "# cluster_id, x, y, z, length, width, height, yaw, orientation, side"
POSITIONS_HEAD = "# FrameID, Timestamp_Sec, Odom_X, Odom_Y, Odom_Z, Qx, Qy, Qz, Qw, Odom_Yaw, ImageFile"


def _named(keys: Sequence[str], ending: str) -> Column:
    """File name of a row's keys: their values joined by ``_``, what a name should not hold replaced."""
    parts = [F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("none")), r"[^A-Za-z0-9.-]", "-") for k in keys]
    return F.concat(F.concat_ws("_", *parts), F.lit(ending))


def _write_lines(lines: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], head: Column | str) -> int:
    """One text file per key: a head and the ``value`` of each row in order."""
    rows = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("_l"), F.first(F.lit(head) if isinstance(head, str) else head).alias("_h"))
    text = F.concat(F.array_join(F.concat(F.array("_h"), F.col("_l.value")), "\n"), F.lit("\n"))
    return write_files(rows.select(_named(keys, ".txt").alias("name"), F.encode(text, "UTF-8").alias("content")), path)


def write_detection_docs(cars: DataFrame, path: str, keys: Sequence[str], source: str, origin: Sequence[float], dataset: Column | None = None) -> int:
    """One document per key with its cars in the order of their ids; positions are global."""
    entry = F.struct(*[F.col(c).alias(c) for c in CAR_FIELDS])
    name = F.concat_ws("_", *keys) if dataset is None else dataset
    docs = cars.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("cars"), F.first(name).alias("dataset_name"))
    doc = F.struct(F.lit(source).alias("source"), "dataset_name", F.array(*[F.lit(float(v)) for v in origin]).alias("global_origin"), "cars")
    return write_files(docs.select(_named(keys, ".json").alias("name"), F.encode(F.to_json(doc), "UTF-8").alias("content")), path)


def write_clusters_text(cars: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Clusters with three decimals, one file per key."""
    line = fixed_line({"id": None, "x": 3, "y": 3, "z": 3, "count": None, "conf": 3, "orient": None, "side": None})
    return _write_lines(cars.select(*keys, "id", line.alias("value")), path, keys, ["id"], CLUSTERS_HEAD)


def write_boxes_text(cars: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Whole boxes: lengths with three decimals, yaw with four, one file per key."""
    line = fixed_line({"id": None, **dict.fromkeys(("x", "y", "z", "length", "width", "height"), 3), "yaw": 4, "orient": None, "side": None})
    return _write_lines(cars.select(*keys, "id", line.alias("value")), path, keys, ["id"], BOXES_HEAD)


def write_transforms(poses: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Nested transforms of ``frame_id, timestamp, x, y, z, yaw`` as one JSON array per key, by frame."""
    where = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    turn = F.struct(F.lit(0.0).alias("pitch"), F.col("yaw").cast("double").alias("yaw"), F.lit(0.0).alias("roll"))
    entry = F.struct(F.col("frame_id").cast("long").alias("frame_id"), F.col("timestamp").cast("double").alias("timestamp"),
                     F.struct(where.alias("location"), turn.alias("rotation")).alias("transform"))
    docs = poses.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("doc"))
    return write_files(docs.select(_named(keys, ".json").alias("name"), F.encode("doc", "UTF-8").alias("content")), path)


def write_split_positions(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], value: str = "value", head: str | None = None) -> int:
    """The position lines of every split (``keys``) as they were read, below their head lines.

    ``head`` names a column with the head lines of the original file; without it, or where it is null or empty, the usual head is written.
    """
    top = F.lit(POSITIONS_HEAD) if head is None else F.coalesce(F.nullif(F.col(head), F.lit("")), F.lit(POSITIONS_HEAD))
    lines = rows.select(*keys, *order, F.col(value).alias("value"), top.alias("_top"))
    return _write_lines(lines, path, keys, order, F.col("_top"))


# --- scenario segment -------------------------------------------------------------------------------
SEGMENT_DOC = ("reference_run string, reference_length_m double, scenario_start_m double, scenario_end_m double, scenario_length_m double,"
               " reference_path_carla_x array<double>, reference_path_carla_y array<double>, reference_path_arc_length array<double>, reference_path_spacing_m double")


def write_segments(segments: DataFrame, path_rows: DataFrame, folder: str, keys: Sequence[str]) -> int:
    """One document per scenario: its segment and the vertices of its reference path."""
    keys = list(keys)
    line = path_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "s"))).alias("_p"))
    doc = F.struct(
        F.concat(F.lit("trajectory"), F.col("reference_run").cast("string")).alias("reference_run"), "reference_length_m", F.col("start_m").alias("scenario_start_m"),
        F.col("end_m").alias("scenario_end_m"), F.col("length_m").alias("scenario_length_m"), F.col("_p.x").alias("reference_path_carla_x"),
        F.col("_p.y").alias("reference_path_carla_y"), F.col("_p.s").alias("reference_path_arc_length"), F.col("spacing_m").alias("reference_path_spacing_m"))
    docs = segments.join(line, keys).select(_named(keys, ".json").alias("name"), F.encode(F.to_json(doc), "UTF-8").alias("content"))
    return write_files(docs, folder)


def read_segments(spark: SparkSession, path, pattern: str = r"([^/]+)\.json$", name: str = "scenario") -> tuple[DataFrame, DataFrame]:
    """(path, segments) of stored documents, as the scoring operators take them; the scenario is named by its file."""
    d = spark.read.schema(SEGMENT_DOC).option("multiLine", True).json(path).select(file_key(pattern, name), "*")
    d = d.where(F.col("scenario_start_m").isNotNull() & F.col("reference_path_carla_x").isNotNull())
    segments = d.select(
        name, F.regexp_extract("reference_run", r"(\d+)$", 1).try_cast("long").alias("reference_run"), "reference_length_m", F.col("scenario_start_m").alias("start_m"),
        F.col("scenario_end_m").alias("end_m"), F.col("scenario_length_m").alias("length_m"), F.col("reference_path_spacing_m").alias("spacing_m"))
    zipped = F.arrays_zip(F.col("reference_path_carla_x").alias("x"), F.col("reference_path_carla_y").alias("y"), F.col("reference_path_arc_length").alias("s"))
    path_rows = d.select(name, F.posexplode(zipped).alias("idx", "v")).select(name, F.col("idx").cast("long").alias("idx"), "v.x", "v.y", "v.s")
    return path_rows, segments


def read_colour_map(spark: SparkSession, path) -> DataFrame:
    """Replaced colours ``r, g, b -> r2, g2, b2`` with their order ``nth`` in the file.

    Keys look like ``(1, 2, 3)``, values like ``4,5,6``; a null value stands for grey (128). Entries that do not parse are left out.
    """
    doc = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", "map<string,string>")).alias("e"))
    rows = doc.select(F.posexplode("e").alias("nth", "e")).select("nth", F.regexp_extract_all(F.col("e.key"), F.lit(r"(\d+)"), 1).alias("k"), F.split(F.coalesce("e.value", F.lit("128,128,128")), ",").alias("v"))
    part = lambda c, i: F.trim(F.try_element_at(c, F.lit(i + 1))).try_cast("int")
    out = rows.where((F.size("k") == 3) & (F.size("v") == 3)).select(
        "nth", *[part("k", i).alias(n) for i, n in enumerate(("r", "g", "b"))], *[part("v", i).alias(n) for i, n in enumerate(("r2", "g2", "b2"))])
    return out.dropna()
