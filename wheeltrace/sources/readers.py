"""File readers. Every reader is tolerant in the same way: bad rows become NULL or are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.functions.angles import STEER_RANGE
from wheeltrace.operators.ordered import counted, with_summary
from wheeltrace.operators.scene import BACK_OFFSET
from wheeltrace.session import materialize

ODOMETRY = "timestamp double, tx double, ty double, tz double, qx double, qy double, qz double, qw double, yaw double"
TRAJECTORY = ("timestamp", "x", "y", "z", "yaw")


def file_key(pattern: str = r"([^/]+)/[^/]+$", name: str = "bag") -> Column:
    """Recording key from the file path (by default the parent folder)."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(name)


def _num(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _lines(spark: SparkSession, path) -> DataFrame:
    """Content lines of text files: trimmed, no blanks, no comments, with path and position.

    ``line_no`` only orders the lines of a file: start of the file block plus the row's place in its
    task. A block that is followed by another one fills its task, so its places stay below its length.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + place).alias("line_no"), F.trim("value").alias("value"))
    return raw.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def _documents(spark: SparkSession, path, pattern: str, folders: bool) -> DataFrame:
    """Whole text files as ``file`` (key from the path) and ``value``.

    With ``folders`` the path holds folders of documents, which tasks list and read: for very many small files.
    """
    if not folders:
        return spark.read.text(path, wholetext=True).select(file_key(pattern, "file"), "value")
    from wheeltrace.sources.python_sources import register

    register(spark)
    docs = spark.read.format("folder_documents").load(path)
    return docs.select(F.regexp_extract("path", pattern, 1).alias("file"), "value")


def read_odometry(spark: SparkSession, path, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Typed pose CSV with a header; order is by time where an operator needs it."""
    return spark.read.schema(ODOMETRY).csv(path, header=True).select(file_key(pattern), "*")


def read_trajectory(spark: SparkSession, path) -> DataFrame:
    """``timestamp, x, y, z, yaw`` with or without a header, columns in any order when named.

    A header line is data that does not parse, so it drops out with the other bad rows; when it names
    all columns it decides the order of its file.
    """
    rows = _lines(spark, path).select("path", "line_no", F.split("value", ",").alias("t"))
    rows = rows.select("path", "line_no", F.transform("t", lambda c: F.lower(F.trim(c))).alias("t"))
    named = F.forall(F.array(*[F.lit(c) for c in TRAJECTORY]), lambda c: F.array_contains("t", c))
    heads = rows.where(named).groupBy("path").agg(F.min_by("t", "line_no").alias("_h"))
    j = rows.join(heads, "path", "left")

    def at(i, c):
        place = F.when(F.col("_h").isNotNull(), F.array_position("_h", F.lit(c)).cast("int")).otherwise(F.lit(i + 1))
        return F.try_element_at("t", place).try_cast("double").alias(c)

    return j.select("path", "line_no", *[at(i, c) for i, c in enumerate(TRAJECTORY)]).dropna(subset=list(TRAJECTORY))


def parse_frame_positions(lines: DataFrame, value: str = "value", order: str = "line_no", keys=()) -> tuple[DataFrame, DataFrame]:
    """(positions, rejected lines). Eleven or more tokens are the long layout, five or more the short.

    A later line with the same frame id replaces an earlier one.
    """
    t = lines.where((F.trim(value) != "") & ~F.trim(value).startswith("#"))
    t = t.select("*", F.transform(F.split(value, ","), lambda c: F.trim(c)).alias("_t"))
    tok = lambda i: F.try_element_at("_t", F.lit(i + 1))
    n = F.size("_t")
    yaw = F.when(n >= 11, tok(9)).when(n >= 5, tok(4))
    whole = F.when(tok(0).rlike(r"^[+-]?\d+$"), tok(0).try_cast("long"))
    p = t.select(
        *keys, F.col(order), F.col(value), whole.alias("frame_id"), tok(1).try_cast("double").alias("ts"), tok(2).try_cast("double").alias("x"),
        tok(3).try_cast("double").alias("y"), F.when(n >= 11, tok(4)).try_cast("double").alias("z"), yaw.try_cast("double").alias("yaw"),
        F.element_at("_t", -1).alias("file"))
    good = F.col("frame_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("yaw").isNotNull()
    kept = p.where(good).groupBy(*keys, "frame_id").agg(F.max_by(F.struct("ts", "x", "y", "z", "yaw", "file"), order).alias("_p"))
    return kept.select(*keys, "frame_id", "_p.*"), p.where(~good).select(*keys, order, value)


def read_frame_positions(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    return parse_frame_positions(_lines(spark, path), keys=("path",))


def read_series(spark: SparkSession, path, pattern: str = r"([^/]+)$", name: str = "topic") -> DataFrame:
    """``ts, value`` text lines; lines that do not parse are skipped."""
    raw = spark.read.option("comment", "#").schema("a string, b string").csv(path, mode="PERMISSIVE")
    out = raw.select(file_key(pattern, name), _num(F.col("a")).alias("ts"), _num(F.col("b")).alias("value"))
    return out.where(F.col("ts").isNotNull() & F.col("value").isNotNull())


SIM_POINT = ("frame long, x double, y double, z double, yaw double, steer_raw double, steering double, steer_norm double, split string,"
             " steering_raw_rad double, steering_normalized double, steering_applied double, throttle_raw double")


def sim_steering(points: DataFrame, keys, pos: str, alias: str | None = None) -> DataFrame:
    """Adds ``steer``: raw value, else normalised times full lock, else NULL.

    The first record of a run decides for the whole run. ``alias`` names one more raw column that is
    accepted last (off by default).
    """
    names = ["steer_raw", "steering", *([alias] if alias else [])]
    first = points.groupBy(*keys).agg(*[F.min_by(F.col(n).isNotNull(), pos).alias(f"_has_{n}") for n in names])
    pick = F.when(F.col("_has_steer_raw"), F.col("steer_raw")).when(F.col("_has_steering"), F.col("steering") * STEER_RANGE)
    if alias:
        pick = F.when(F.col("_has_steer_raw") | F.col("_has_steering"), pick).when(F.col(f"_has_{alias}"), F.col(alias))
    return with_summary(points, first, keys).select(*points.columns, pick.alias("steer"))


def read_sim_trajectory(spark: SparkSession, path, alias: str | None = None) -> DataFrame:
    """JSON arrays of trajectory points, one file per run; ``alias`` as in ``sim_steering``."""
    raw = spark.read.schema(SIM_POINT).option("multiLine", True).json(path).select(file_key(r"([^/]+)$", "file"), "*")
    return sim_steering(raw, ["file"], "frame", alias)


TRANSFORMS = ("frame_id long, timestamp double, transform struct<location: struct<x: double, y: double, z: double>,"
              " rotation: struct<pitch: double, yaw: double, roll: double>>")


def flatten_transforms(df: DataFrame, back_offset: float = BACK_OFFSET, keep=()) -> DataFrame:
    """Nested transforms as flat poses, moved back along the heading by ``back_offset``."""
    loc, rot = "transform.location", "transform.rotation"
    yaw = F.coalesce(F.col(f"{rot}.yaw"), F.lit(0.0))
    a = F.radians(yaw)
    return df.select(*keep, "frame_id", "timestamp", (F.col(f"{loc}.x") - back_offset * F.cos(a)).alias("x"),
                     (F.col(f"{loc}.y") - back_offset * F.sin(a)).alias("y"), F.col(f"{loc}.z").alias("z"), yaw.alias("yaw"))


def read_transforms(spark: SparkSession, path, back_offset: float = BACK_OFFSET) -> DataFrame:
    raw = spark.read.schema(TRANSFORMS).option("multiLine", True).json(path)
    return flatten_transforms(raw.select(file_key(r"([^/]+)$", "file"), "*"), back_offset, ["file"])


def parse_clusters(lines: DataFrame, value: str = "value", keep=()) -> DataFrame:
    """``id, x, y`` plus orientation and side words found anywhere later in the row (last one wins)."""
    t = lines.where((F.trim(value) != "") & ~F.trim(value).startswith("#"))
    t = t.select(*keep, F.transform(F.split(value, ","), lambda c: F.lower(F.trim(c))).alias("_t"))
    tok = lambda i: F.try_element_at("_t", F.lit(i + 1)).try_cast("double")
    later = F.slice("_t", 4, F.greatest(F.size("_t") - 3, F.lit(0)))

    def word(*options):
        return F.coalesce(F.try_element_at(F.filter(later, lambda c: c.isin(*options)), F.lit(-1)), F.lit("unknown"))

    p = t.where(F.size("_t") >= 3).select(*keep, F.expr("cast(try_element_at(_t, 1) as string)").alias("_id"), tok(0).alias("id"), tok(1).alias("x"), tok(2).alias("y"),
                                          word("parallel", "perpendicular").alias("orient"), word("left", "right").alias("side"))
    # ids that are no number (nan, inf) cannot be an integer: such rows are skipped like other bad ones
    whole = F.when(~F.isnan("id"), F.col("id").try_cast("long"))
    ok = whole.isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    return p.where(ok).select(*keep, whole.alias("cluster_id"), "x", "y", "orient", "side")


def read_clusters(spark: SparkSession, path) -> DataFrame:
    return parse_clusters(_lines(spark, path), keep=("path",))


DETECTION_DOC = ("source string, dataset_name string, global_origin array<double>, cars array<struct<id: long, x: double, y: double, z: double,"
                 " length: double, width: double, height: double, yaw: double, count: long, conf: double, side: string, orient: string>>")


def read_detection_doc(spark: SparkSession, path) -> DataFrame:
    """One row per car with its document's source and origin; positions are global already."""
    doc = spark.read.schema(DETECTION_DOC).option("multiLine", True).json(path)
    return doc.select(file_key(r"([^/]+)$", "file"), "source", "dataset_name", "global_origin", F.inline("cars"))


def read_point_clouds(spark: SparkSession, path, range_bytes: int | None = None) -> DataFrame:
    """Points of raw cloud files: ``path, point, x, y, z, i``; a large cloud is read by several tasks.

    Four floats per point, else three (intensity 0), else rejected. Intensities are divided by 255 in clouds where any exceeds 1.
    """
    from wheeltrace.sources.python_sources import register

    register(spark)
    source = spark.read.format("point_clouds")
    if range_bytes:
        source = source.option("rangeBytes", range_bytes).option("taskBytes", 64 * range_bytes)
    pts = source.load(path)
    bytes_ = materialize(pts.where("i > 1").select("path").distinct(), "scaled").withColumn("_b", F.lit(True))
    out = pts.join(counted(bytes_), "path", "left")
    return out.select("path", "point", "x", "y", "z", F.when(F.col("_b"), (F.col("i") / 255).cast("float")).otherwise(F.col("i")).alias("i"))


def read_label_images(spark: SparkSession, path, size=(512, 512)) -> DataFrame:
    """Label image files to class maps; undecodable files are dropped."""
    from wheeltrace.operators.images import label_images

    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return label_images(img.select(F.col("origin").alias("frame"), "height", "width", "data"), size)


def read_osm(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, declared bounds) of map files; invisible nodes are left out."""
    node = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double, _visible string").load(path)
    nodes = node.where(F.coalesce("_visible", F.lit("true")) == "true").selectExpr("_id as id", "_lat as lat", "_lon as lon")
    way = spark.read.format("xml").option("rowTag", "way").schema(
        "_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>").load(path)
    ways = way.select(F.col("_id").alias("way_id"), F.coalesce(F.col("nd._ref"), F.array()).alias("refs"),
                      F.coalesce(F.map_from_entries("tag"), F.create_map().cast("map<string,string>")).alias("tags"))
    bounds = spark.read.format("xml").option("rowTag", "bounds").schema(
        "_minlat double, _maxlat double, _minlon double, _maxlon double").load(path)
    return nodes, ways, bounds.selectExpr("_minlat as minlat", "_maxlat as maxlat", "_minlon as minlon", "_maxlon as maxlon")


def parse_map_header(docs: DataFrame, text: str = "value", keep=()) -> DataFrame:
    """Projection text, offset, bounds and centre of map headers given as whole documents."""
    head = F.regexp_extract(text, r"(?s)(<header.*?(?:</header>|/>))", 1)
    d = docs.select(*keep, F.when(head != "", head).otherwise(F.col(text)).alias("_h"))
    geo = F.trim(F.regexp_extract("_h", r"(?s)<geoReference>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</geoReference>", 1))
    off = lambda a: F.coalesce(F.regexp_extract("_h", rf'<offset[^>]*\b{a}="([^"]+)"', 1).try_cast("double"), F.lit(0.0))
    bound = lambda a: F.coalesce(F.regexp_extract("_h", rf'<header[^>]*\b{a}="([^"]+)"', 1).try_cast("double"), F.lit(0.0))
    out = d.select(*keep, F.coalesce(F.nullif(geo, F.lit("")), F.lit("+proj=tmerc")).alias("geo_reference"), off("x").alias("offset_x"),
                   off("y").alias("offset_y"), *[bound(b).alias(b) for b in ("north", "south", "east", "west")])
    return out.select("*", ((F.col("east") + F.col("west")) / 2).alias("center_x"), ((F.col("north") + F.col("south")) / 2).alias("center_y"))


def read_map_header(spark: SparkSession, path, pattern: str = r"([^/]+)$", folders: bool = False) -> DataFrame:
    docs = _documents(spark, path, pattern, folders)
    return parse_map_header(docs, keep=("file",))


def run_catalog(names: DataFrame, name: str = "name", default_method: str | None = None, scheme: str = "condition") -> DataFrame:
    """Kind, method, condition and run from file names; names that match nothing are left out.

    Real: ``trajectory<N>.csv`` or ``<condition><N>_trajectory.txt``. Simulated, in this order:
    ``only_carla_<condition>_map_run<N>``, ``<condition>_<method>_run<N>``, ``<condition>_run<N>``,
    each with ``_trajectory.json``; else any ``<method>_run<N>_trajectory.json``, or the folder form
    ``<method>_run<N>/trajectory.json``. With ``scheme='method'`` a simulated name has no condition: all
    that stands before ``_run<N>`` is the method.
    """
    if scheme not in ("condition", "method"):
        raise ValueError(scheme)
    patterns = [  # kind, pattern, group of condition, method, run
        ("real", r"^trajectory(\d+)\.csv$", 0, 0, 1),
        ("real", r"^(\w+?)(\d+)_trajectory\.txt$", 1, 0, 2),
        ("sim", r"^only_carla_([a-z]+)_map_run(\d+)_trajectory\.json$", 1, 0, 2),
        ("sim", r"^([a-z]+)_([a-z]+)_run(\d+)_trajectory\.json$", 1, 2, 3),
        ("sim", r"^([a-z]+)_run(\d+)_trajectory\.json$", 1, 0, 2),
        ("sim", r"^([A-Za-z][A-Za-z0-9_]*)_run(\d+)_trajectory\.json$", 0, 1, 2),
        ("sim", r"^([A-Za-z][A-Za-z0-9_]*)_run(\d+)/trajectory\.json$", 0, 1, 2),
    ]
    if scheme == "method":
        patterns = [p for p in patterns if p[0] == "real" or p[3] == 1]
    base = names.select("*", F.regexp_extract(name, r"([^/]+/trajectory\.json|[^/]+)$", 1).alias("_b"))
    hits = []
    for kind, pat, cond, method, run in patterns:
        group = lambda g: F.regexp_extract("_b", pat, g) if g else F.lit(None).cast("string")  # noqa: B023, E731
        hits.append(F.when(F.col("_b").rlike(pat), F.struct(
            F.lit(kind).alias("kind"), F.coalesce(group(method), F.lit(default_method)).alias("method"), group(cond).alias("condition"),
            group(run).cast("long").alias("run"))))
    return base.select("*", F.coalesce(*hits).alias("_m")).where(F.col("_m").isNotNull()).select(*names.columns, "_m.*")


def validate_runs(points: DataFrame, keys, pos: str, runs: DataFrame | None = None) -> DataFrame:
    """Number of points of a run whose first point has x and y, else -1.

    ``runs`` lists all runs by key; those without any point (empty or unreadable files) get -1 too.
    """
    first_ok = F.min_by(F.col("x").isNotNull() & F.col("y").isNotNull(), pos)
    out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), first_ok.alias("_ok"))
    if runs is not None:
        out = runs.select(*keys).distinct().join(out, list(keys), "left")
    return out.select(*keys, F.when(F.col("_ok"), F.col("_n")).otherwise(F.lit(-1)).alias("points"))


CALIBRATION_KEYS = ("SHIFT_X", "SHIFT_Y", "YAW_OFFSET")


def parse_calibration(lines: DataFrame, keys, value: str = "value") -> DataFrame:
    """``KEY=VALUE`` lines of the known keys as one row per file, 0.0 when missing.

    ``line_no`` orders the lines: of a repeated key the last one counts. A value of a known key that is no
    number makes the whole file count as missing.
    """
    kv = F.split(F.trim(value), "=", 2)
    p = lines.select(*keys, "line_no", F.trim(kv[0]).alias("k"), F.try_element_at(kv, F.lit(2)).try_cast("double").alias("v"))
    bad = F.coalesce(F.bool_or(F.col("k").isin(*CALIBRATION_KEYS) & F.col("v").isNull()), F.lit(False))
    last = [F.max_by(F.when(F.col("k") == c, F.col("v")), F.when(F.col("k") == c, F.col("line_no"))) for c in CALIBRATION_KEYS]
    return p.groupBy(*keys).agg(*[F.when(bad, 0.0).otherwise(F.coalesce(v, F.lit(0.0))).alias(c.lower()) for c, v in zip(CALIBRATION_KEYS, last)])


def read_calibration(spark: SparkSession, path, pattern: str = r"([^/]+)$", folders: bool = False) -> DataFrame:
    files = _documents(spark, path, pattern, folders)  # a few lines each
    return parse_calibration(files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")), ["file"])


# Defaults of a camera description.
CAMERA_DEFAULTS = {"size": 512, "fov": 90.0, "fps": 20, "pitch": 0.0}


def parse_camera_config(docs: DataFrame, text: str = "value", keep=(), defaults: dict = CAMERA_DEFAULTS) -> DataFrame:
    """Nested or flat camera JSON; the first usable value of each alternative key wins.

    A position without x, y and z is an error.
    """
    def first(cast, *paths):
        return F.coalesce(*[F.get_json_object(text, f"$.{p}").try_cast("double") for p in paths], F.lit(None).cast("double")).cast(cast)

    both = lambda f: (f"camera.{f}", f)
    size = first("int", "target_size", "output_size", "size.x", "camera.target_size", "camera.output_size", "camera.size.x")
    out = docs.select(
        *keep, F.coalesce(size, F.lit(defaults["size"])).alias("size"), F.coalesce(first("double", *both("fov")), F.lit(defaults["fov"])).alias("fov"),
        F.coalesce(first("int", *both("fps")), F.lit(defaults["fps"])).alias("fps"), F.coalesce(first("double", *both("pitch")), F.lit(defaults["pitch"])).alias("pitch"),
        *[first("double", *both(f"position.{a}")).alias(a) for a in "xyz"],
        F.coalesce(F.get_json_object(text, "$.camera.original_size"), F.get_json_object(text, "$.original_size")).alias("original_size"))
    missing = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    checked = F.when(missing, F.raise_error(F.lit("camera position must contain x, y and z")).cast("double")).otherwise(F.col("x"))
    return out.withColumn("x", checked)


def read_camera_config(spark: SparkSession, path, pattern: str = r"([^/]+)$", folders: bool = False) -> DataFrame:
    docs = _documents(spark, path, pattern, folders)
    return parse_camera_config(docs, keep=("file",))


def frame_number(name: str | Column, style: str = "digits") -> Column:
    """Frame id in a file name: last digit group, token after the last ``_``, or a bare prefixed number."""
    c = F.col(name) if isinstance(name, str) else name
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    if style == "digits":
        stem = F.regexp_replace(base, r"\.[^.]*$", "")
        return F.regexp_extract(stem, r"(\d+)\D*$", 1).try_cast("long")
    if style == "token":
        return F.split_part(F.regexp_extract(base, r"([^_]*)$", 1), F.lit("."), F.lit(1)).try_cast("long")
    if style == "prefix":
        stem = F.regexp_replace(base, r"\.[^.]*$", "")
        return F.replace(F.replace(stem, F.lit("seg_"), F.lit("")), F.lit("frame_"), F.lit("")).try_cast("long")
    raise ValueError(style)
