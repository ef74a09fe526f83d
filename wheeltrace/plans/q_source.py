"""Queries: readers and writers, run on files that Spark writes from the test tables."""

import os
import uuid

from pyspark.sql import functions as F

from wheeltrace.operators import score as S
from wheeltrace.plans.derived import cte, derived, table
from wheeltrace.plans.q_align import _SPL
from wheeltrace.plans.q_drives import _SEG, scored
from wheeltrace.plans.q_path import _JIT, _VIO, _jitter, _violations, segment_parts
from wheeltrace.plans.registry import q, query, r, rounded
from wheeltrace.operators.align import split_assign
from wheeltrace.sources import documents as Doc
from wheeltrace.sources import readers as R
from wheeltrace.sources import sinks as W
from wheeltrace.sources.python_sources import write_files
from wheeltrace.session import scratch_folder


def _folder(spark, name):
    return os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _text(spark, df, name, keys=()):
    """Write a ``value`` column as text files, one folder per key value, and return the path."""
    path = _folder(spark, name)
    w = df.write.partitionBy(*keys) if keys else df.write
    w.text(path)
    return path


def _files(spark, docs, name):
    """Write one file per document (``id``, ``value``) and return the folder."""
    path = _folder(spark, name)
    write_files(docs.select(F.format_string("%d.doc", "id").alias("name"), F.encode("value", "UTF-8").alias("content")), path)
    return path


def _folders(spark, docs, name):
    """Write one file per document in 1,000 folders; the files of a folder are written by one task, whatever the input's file sizes."""
    path = _folder(spark, name)
    tasks = min(1000, 4 * spark.sparkContext.defaultParallelism)
    docs = docs.withColumn("at", F.pmod("id", F.lit(1000))).repartition(tasks, "at")
    write_files(docs.select(F.format_string("%03d/%d.doc", "at", "id").alias("name"), F.encode("value", "UTF-8").alias("content")), path)
    return path


@query("read_odometry", cte(f"SELECT CAST(bag AS VARCHAR) AS bag, {q('t_us/1e6', 6)} AS timestamp, {q('tx')} AS tx, {q('ty')} AS ty, {q('qz')} AS qz, {q('yaw')} AS yaw FROM odom", "odom"))
def read_odometry(spark, sf):
    o = derived(spark, sf, "odom").selectExpr("concat('bag', bag) as bag", "t_us/1e6 as timestamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw", "yaw")
    path = _folder(spark, "odometry")
    o.write.partitionBy("bag").csv(path, header=True)
    out = R.read_odometry(spark, f"{path}/*/", pattern=r"bag=bag(\d+)/")
    return rounded(out, "bag", timestamp="timestamp", tx="tx", ty="ty", qz="qz", yaw="yaw")


@query("read_trajectory", cte(f"SELECT bag, {q('t_us/1e6', 6)} AS timestamp, {q('tx')} AS x, {q('ty')} AS y, {q('yaw')} AS yaw FROM odom", "odom"))
def read_trajectory(spark, sf):
    o = derived(spark, sf, "odom")
    line = F.when(F.col("bag") % 2 == 0, F.concat_ws(", ", F.col("t_us") / 1e6, "tx", "ty", "tz", "yaw")).otherwise(
        F.concat_ws(",", "ty", "tx", F.col("t_us") / 1e6, "yaw", "tz"))
    # a comment everywhere, a header in odd folders (with its columns in another order), a broken row
    extra = o.where("idx = 0").select("bag", F.explode(F.array(F.lit("# pose log"), F.lit("1.0, oops, 2, 3, 4"), F.when(
        F.col("bag") % 2 == 1, F.lit("Y, X, Timestamp, Yaw, Z")))).alias("value")).where("value is not null")
    rows = o.select("bag", line.alias("value")).unionByName(extra)
    path = _folder(spark, "trajectory")
    rows.repartition("bag").sortWithinPartitions(F.desc("value")).write.partitionBy("bag").text(path)
    out = R.read_trajectory(spark, f"{path}/*/")
    return out.select(F.regexp_extract("path", r"bag=(\d+)/", 1).cast("long").alias("bag"), *[r(c).alias(c) for c in ("timestamp", "x", "y", "yaw")])


_LN = {
    "good": """SELECT line_no % 4000 AS frame_id, line_no, CASE WHEN line_no % 2 = 0 THEN 0.25e0 ELSE 0.75e0 END AS yaw FROM pose_lines WHERE line_no % 50 > 1""",
}


@query("read_frame_positions", cte("SELECT frame_id, arg_max(yaw, line_no) AS yaw, 1.5e0 AS x, 2.5e0 AS y FROM good GROUP BY frame_id UNION ALL SELECT -1, count(*), NULL, NULL FROM pose_lines WHERE line_no % 50 = 1", "pose_lines", extra=_LN))
def read_frame_positions(spark, sf):
    lines = derived(spark, sf, "pose_lines").select("line_no", F.expr(
        "case when line_no % 50 > 1 then concat(cast(line_no % 4000 as string), substr(value, instr(value, ','))) else value end").alias("value"))
    path = _folder(spark, "positions")  # files by the last digit of the frame, each in the order of its lines
    lines = lines.withColumn("file", F.pmod(F.coalesce(F.regexp_extract("value", r"^(\d+),", 1).try_cast("long"), F.lit(0)), F.lit(10)))
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").write.partitionBy("file").text(path)
    kept, rejected = R.read_frame_positions(spark, f"{path}/*/")
    # the number of rejected lines is reported as frame -1
    n = rejected.agg(F.count(F.lit(1)).cast("double").alias("yaw"))
    none = F.lit(None).cast("double")
    return kept.select("frame_id", "yaw", "x", "y").unionByName(n.select(F.lit(-1).cast("long").alias("frame_id"), "yaw", none.alias("x"), none.alias("y")))


@query("read_series", cte(f"SELECT CAST(bag AS VARCHAR) AS topic, {q('t_us/1e6', 6)} AS ts, {q('value')} AS value FROM series", "series"))
def read_series(spark, sf):
    s = derived(spark, sf, "series")
    rows = s.select("bag", F.concat_ws(", ", (F.col("t_us") / 1e6).cast("string"), F.col("value").cast("string")).alias("value"))
    junk = s.where("seq = 0").select("bag", F.explode(F.array(F.lit("# ts, value"), F.lit("12.0"), F.lit("a, b"))).alias("value"))
    path = _text(spark, rows.unionByName(junk), "series", ["bag"])
    return rounded(R.read_series(spark, f"{path}/*/", pattern=r"bag=(\d+)/"), "topic", ts="ts", value="value")


@query("read_sim_trajectory", cte(f"SELECT run, seq, CASE run % 3 WHEN 0 THEN {q('steer')} WHEN 1 THEN {q('steer*3*pi()')} END AS steer FROM runs", "runs"))
def read_sim_trajectory(spark, sf):
    runs = derived(spark, sf, "runs")
    steer = {"steer_raw": F.when(F.col("run") % 3 == 0, F.col("steer")), "steering": F.when(F.col("run") % 3 == 1, F.col("steer"))}
    pts = runs.select("run", F.to_json(F.struct(F.col("seq").alias("frame"), "x", "y", *[c.alias(n) for n, c in steer.items()])).alias("value"))
    path = _text(spark, pts, "sim", ["run"])  # line-delimited objects
    raw = spark.read.schema(R.SIM_POINT).json(f"{path}/*/").select(R.file_key(r"run=(\d+)/", "run"), "*")
    out = R.sim_steering(raw, ["run"], "frame")
    return out.select(F.col("run").cast("long").alias("run"), F.col("frame").alias("seq"), r("steer").alias("steer"))


@query("read_transforms", cte(f"SELECT bag, idx, {q('tx - 0.13e0*cos(radians(degrees(yaw)))')} AS x, {q('ty - 0.13e0*sin(radians(degrees(yaw)))')} AS y, {q('degrees(yaw)')} AS yaw FROM odom", "odom"))
def read_transforms(spark, sf):
    o = derived(spark, sf, "odom").select("bag", F.col("idx").alias("frame_id"), (F.col("t_us") / 1e6).alias("timestamp"), F.struct(
        F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z")).alias("location"),
        F.struct(F.lit(0.0).alias("pitch"), F.degrees("yaw").alias("yaw"), F.lit(0.0).alias("roll")).alias("rotation")).alias("transform"))
    path = _folder(spark, "transforms")
    o.write.partitionBy("bag").json(path)
    raw = spark.read.schema(R.TRANSFORMS + ", bag long").json(path)
    return R.flatten_transforms(raw, keep=["bag"]).select("bag", F.col("frame_id").alias("idx"), r("x").alias("x"), r("y").alias("y"), r("yaw").alias("yaw"))


@query("read_clusters", cte("""SELECT cluster_id, CASE WHEN cluster_id % 4 = 0 THEN 'unknown' ELSE orient END AS orient, CASE WHEN cluster_id % 6 = 5 THEN 'right' ELSE side END AS side
   FROM cars WHERE cluster_id % 9 > 0""", "cars"))
def read_clusters(spark, sf):
    c = derived(spark, sf, "cars")
    line = F.concat_ws(", ", F.concat(F.col("cluster_id").cast("string"), F.lit(".0")), F.when(F.col("cluster_id") % 9 == 0, F.lit("bad")).otherwise(F.lit("1.25")),
                       F.lit("2.5"), F.lit("0-255-0"), F.when(F.col("cluster_id") % 4 > 0, F.initcap("orient")), "side",
                       F.when(F.col("cluster_id") % 6 == 5, F.lit(" RIGHT ")))
    path = _text(spark, c.select(line.alias("value")).union(c.where("cluster_id = 1").selectExpr("'# id, x, y'")), "clusters")
    return R.read_clusters(spark, path).select("cluster_id", "orient", "side")


@query("read_detection_doc", cte(f"""SELECT cluster_id % 7 AS doc, cluster_id % 7 AS ox, cluster_id AS id, {q('lon')} AS x, {q('lat')} AS y, {q('4e0 + (cluster_id % 5)*0.25e0')} AS length,
   {q('1.5e0 + (cluster_id % 3)*0.25e0')} AS width, 1.5e0 AS height, cluster_id % 4 AS count, side, orient FROM cars""", "cars"))
def read_detection_doc(spark, sf):
    c = derived(spark, sf, "cars")
    k = F.col("cluster_id")
    car = F.struct(k.alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(0.0).alias("z"), (4 + k % 5 * 0.25).alias("length"),
                   (1.5 + k % 3 * 0.25).alias("width"), F.lit(1.5).alias("height"), (k % 4).alias("count"), "side", "orient")
    # documents hold a few cars each: one per seven cars, so that no document grows with the data
    docs = c.groupBy((F.col("cluster_id") % 7).alias("doc"), F.expr("cluster_id div 49").alias("part")).agg(F.collect_list(car).alias("cars"))
    docs = docs.select(F.concat(F.lit("d"), "doc").alias("dataset_name"), F.lit("lidar").alias("source"),
                       F.array(F.col("doc").cast("double"), F.lit(0.0), F.lit(0.0)).alias("global_origin"), "cars")
    path = _folder(spark, "detections")
    # one object per document and file, as the detection step writes them
    docs.write.option("maxRecordsPerFile", 1).json(path)
    raw = R.read_detection_doc(spark, path)
    return rounded(raw, F.substring("dataset_name", 2, 9).cast("long").alias("doc"), F.col("global_origin")[0].cast("long").alias("ox"), "id", "count", "side", "orient",
                   x="x", y="y", length="length", width="width", height="height")


@query("read_point_clouds", cte(f"""SELECT frame_id, CAST(k AS BIGINT) AS point, {q('CAST(c2w[4*k+1] AS DOUBLE)')} AS x, {q('CAST(c2w[4*k+3] AS DOUBLE)')} AS z, {q('CAST(c2w[4*k+4] AS DOUBLE)')} AS i
   FROM (SELECT frame_id, c2w, unnest(range(16)) AS k FROM cameras)""", "cameras"))
def read_point_clouds(spark, sf):
    import numpy as np
    import pandas as pd

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": [f"{f}.bin" for f in pdf["frame_id"]], "content": [np.asarray(v, dtype=np.float32).tobytes() for v in pdf["c2w"]]})

    path = _folder(spark, "clouds")
    write_files(derived(spark, sf, "cameras").select("frame_id", "c2w").mapInPandas(pack, "name string, content binary"), path)
    pts = R.read_point_clouds(spark, path, range_bytes=128)  # several ranges a file
    frame = F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("frame_id")
    return pts.select(frame, "point", *[r(F.col(c).cast("double")).alias(c) for c in ("x", "z", "i")])


@query("read_osm", """SELECT CAST(s_suppkey AS BIGINT) AS way_id, CAST(2 + s_suppkey % 3 AS INT) AS refs, CASE WHEN s_suppkey % 2 = 0 THEN 'residential' END AS highway FROM supplier
   UNION ALL SELECT -1, count(*), 'nodes' FROM customer WHERE c_custkey % 10 > 0""")
def read_osm(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    node = c.select(F.col("c_nationkey").alias("map"), F.lit(1).alias("o"), F.format_string(
        '<node id="%d" lat="48.%06d" lon="11.5" visible="%s"/>', F.col("c_custkey").cast("long"), F.col("c_custkey").cast("long"),
        F.when(F.col("c_custkey") % 10 > 0, "true").otherwise("false")).alias("value"))
    refs = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 2).cast("int")), lambda k: F.format_string('<nd ref="%d"/>', F.col("s_suppkey").cast("long") + k)), "")
    way = s.select(F.col("s_nationkey").alias("map"), F.lit(2).alias("o"), F.concat(
        F.format_string('<way id="%d">', F.col("s_suppkey").cast("long")), refs, F.when(
            F.col("s_suppkey") % 2 == 0, F.lit('<tag k="highway" v="residential"/>')).otherwise(F.lit("")), F.lit("</way>")).alias("value"))
    frame = table(spark, sf, "nation").select(F.col("n_nationkey").alias("map"), F.inline(F.array(
        F.struct(F.lit(0).alias("o"), F.lit('<osm version="0.6">').alias("value")), F.struct(F.lit(9).alias("o"), F.lit("</osm>").alias("value")))))
    rows = node.unionByName(way).unionByName(frame)
    path = _folder(spark, "osm")  # one document per map
    rows.repartition("map").sortWithinPartitions("map", "o").select("map", "value").write.partitionBy("map").text(path)
    nodes, ways, _ = R.read_osm(spark, f"{path}/*/")
    n = nodes.agg(F.count(F.lit(1)).alias("refs"))
    flat = ways.select("way_id", F.size("refs").cast("long").alias("refs"), F.col("tags")["highway"].alias("highway"))
    return flat.unionByName(n.select(F.lit(-1).cast("long").alias("way_id"), "refs", F.lit("nodes").alias("highway")))


@query("read_map_header", f"""SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 3 = 0 THEN '+proj=tmerc' ELSE '+proj=utm +zone=32' END AS geo_reference,
   CASE WHEN c_custkey % 4 = 0 THEN 0e0 ELSE c_custkey + 0.5e0 END AS offset_x, {q('(10e0 + c_custkey)/2')} AS center_x FROM customer""")
def read_map_header(spark, sf):
    k = F.col("c_custkey").cast("long")
    geo = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("<geoReference>\n<![CDATA[+proj=utm +zone=32 ]]></geoReference>"))
    off = F.when(k % 4 == 0, F.lit("")).otherwise(F.format_string('<offset x="%d.5" y="-2.0"/>', k))
    docs = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.format_string(
        '<?xml version="1.0"?><OpenDRIVE><header north="4" south="2" east="10" west="%d">', k), geo, off, F.lit("</header><road/></OpenDRIVE>")).alias("value"))
    out = R.read_map_header(spark, _folders(spark, docs, "headers"), pattern=r"(\d+)\.doc$", folders=True)
    return out.select(F.col("file").cast("long").alias("id"), "geo_reference", "offset_x", r("center_x").alias("center_x"))


@query("run_catalog", """SELECT id, CASE WHEN id % 6 < 2 THEN 'real' ELSE 'sim' END AS kind, CASE id % 6 WHEN 3 THEN 'gs' WHEN 5 THEN 'Gs_fast2' ELSE NULL END AS method,
   CASE id % 6 WHEN 1 THEN 'sunny' WHEN 2 THEN 'rain' WHEN 3 THEN 'snowy' WHEN 4 THEN 'cloudy' END AS condition, id AS run FROM (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer) WHERE id % 7 > 0""")
def run_catalog(spark, sf):
    k = F.col("c_custkey").cast("long")
    kinds = ["trajectory%d.csv", "sunny%d_trajectory.txt", "only_carla_rain_map_run%d_trajectory.json", "snowy_gs_run%d_trajectory.json",
             "cloudy_run%d_trajectory.json", "Gs_fast2_run%d/trajectory.json"]
    name = F.coalesce(*[F.when(k % 6 == i, F.format_string(f"/data/{p}", k)) for i, p in enumerate(kinds)])
    files = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 7 == 0, F.format_string("notes%d.md", k)).otherwise(name).alias("name"))
    return R.run_catalog(files).select("id", "kind", "method", "condition", "run")


@query("validate_runs", cte("SELECT run, CASE WHEN run % 3 = 2 THEN -1 ELSE count(*) END AS points FROM runs GROUP BY run", "runs"))
def validate_runs(spark, sf):
    runs = derived(spark, sf, "runs").withColumn("y", F.expr("case when run % 3 = 2 and seq = 0 then null else y end"))
    return R.validate_runs(runs, ["run"], "seq").select("run", F.col("points").cast("long").alias("points"))


@query("read_calibration", """SELECT id, CASE WHEN id % 5 = 0 THEN 0e0 ELSE id*0.5e0 END AS shift_x, CASE WHEN id % 2 = 0 AND id % 5 > 0 THEN -1.25e0 ELSE 0e0 END AS shift_y,
   CASE WHEN id % 5 = 0 THEN 0e0 ELSE 0.75e0 END AS yaw_offset FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier)""")
def read_calibration(spark, sf):
    k = F.col("s_suppkey").cast("long")
    # repeated keys (the last one counts), unknown keys, and files with a bad value
    lines = F.array(F.lit("YAW_OFFSET=0.25"), F.concat(F.lit("SHIFT_X="), (k * 0.5).cast("string")), F.when(k % 2 == 0, F.lit("SHIFT_Y=-1.25")).otherwise("SCALE=2"),
                    F.when(k % 5 == 0, F.lit("YAW_OFFSET=oops")).otherwise("YAW_OFFSET=0.75"))
    t = table(spark, sf, "supplier").select(k.alias("id"), F.array_join(lines, "\n").alias("value"))
    out = R.read_calibration(spark, _folders(spark, t, "calibration"), pattern=r"(\d+)\.doc$", folders=True)
    return out.select(F.col("file").cast("long").alias("id"), "shift_x", "shift_y", "yaw_offset")


@query("read_camera_config", """SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 3 WHEN 0 THEN 640 WHEN 1 THEN 256 ELSE 512 END AS size, 54.7e0 AS fov,
   CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 20 END AS fps, CAST(c_custkey AS DOUBLE) AS x FROM customer""")
def read_camera_config(spark, sf):
    k = F.col("c_custkey").cast("long")
    pos = '"fov": 54.7, "position": {"x": %d, "y": 0.0, "z": "1.4"}'
    fps = F.when(k % 2 == 0, F.lit(', "fps": 30')).otherwise(F.lit(""))
    nested = F.concat(F.lit('{"size": {"x": 640, "y": 1}, "camera": {'), F.format_string(pos, k), fps, F.lit("}}"))
    flat = F.concat(F.lit("{"), F.format_string(pos, k), fps, F.when(k % 3 == 1, F.lit(', "target_size": "bad", "output_size": 256')).otherwise(F.lit("")), F.lit("}"))
    docs = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, nested).otherwise(flat).alias("value"))
    out = R.read_camera_config(spark, _folders(spark, docs, "cameras"), pattern=r"(\d+)\.doc$", folders=True)
    return out.select(F.col("file").cast("long").alias("id"), "size", "fov", "fps", "x")


@query("frame_number", """SELECT CAST(page_id AS BIGINT) AS page_id, CAST(page_id*3 AS BIGINT) AS a, CAST(page_id AS BIGINT) AS b, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS BIGINT) END AS c,
   TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS d FROM pages""")
def frame_number(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    k = F.col("page_id")
    return p.select(
        "page_id", R.frame_number(F.format_string("/x/run7/frame_%06d_%d.png", k, k * 3)).alias("a"), R.frame_number(F.format_string("cam2_frame_%06d.png", k), "token").alias("b"),
        R.frame_number(F.when(k % 2 == 0, F.format_string("seg_frame_%06d.png", k)).otherwise(F.lit("seg_x.png")), "prefix").alias("c"),
        R.frame_number("url").alias("d"))


# --- writers ------------------------------------------------------------------------------------------
@query("write_fixed_text", cte("SELECT bag, printf('%.6f, %.4f, %.4f, %d', t_us/1e6, tx, round(ty, 7), idx) AS value FROM odom", "odom"))
def write_fixed_text(spark, sf):
    o = derived(spark, sf, "odom").select("bag", "idx", (F.col("t_us") / 1e6).alias("ts"), "tx", F.round("ty", 7).alias("ty"))
    path = _folder(spark, "fixed")
    W.write_fixed_text(o, path, {"ts": 6, "tx": 4, "ty": 4, "idx": None}, ["bag"], ["idx"])
    return spark.read.text(path).select(F.col("bag").cast("long").alias("bag"), "value")


@query("write_results_doc", cte(f"""SELECT run, {q('rate*100', 4)} AS out_pct, 'gs' AS method, {q('b - a', 3)} AS length_m FROM vio, seg""", "runs", extra={**_VIO, **_JIT}))
def write_results_doc(spark, sf):
    seg = segment_parts(spark, sf)[2]
    names = ["start_m", "end_m", "length_m"]
    segments = spark.createDataFrame([(0, *[seg[n] for n in names])], "scenario int, start_m double, end_m double, length_m double")
    qual = _violations(spark, sf).select(F.lit(0).alias("scenario"), F.lit("gs").alias("method"), "run", (F.col("run") * 0.25).alias("frechet"), (F.col("rate") * 100).alias("out_pct"), "mean_excess")
    jit = _jitter(spark, sf).select(F.lit(0).alias("scenario"), F.lit("gs").alias("method"), "run", "jitter", "max_jitter")
    avg = S.method_averages(qual, jit, keys=["scenario"])
    doc = W.results_doc(segments, qual, avg.select("scenario", "method", "runs", "avg_frechet_m", "avg_out_pct", "avg_mean_excess_m"), jit,
                        avg.select("scenario", "method", F.col("jitter_runs").alias("runs"), "avg_jitter", "max_jitter"), ["scenario"])
    path = _folder(spark, "results")
    W.write_results_doc(doc, path, ["scenario"])
    back = spark.read.schema("segment struct<length_m: double>, drive_quality array<struct<run: long, method: string, corridor_violation_pct: double>>").json(path)
    return back.select("segment", F.inline("drive_quality")).select("run", r("corridor_violation_pct", 4).alias("out_pct"), "method", r("segment.length_m", 3).alias("length_m"))


@query("write_splits", cte("SELECT c.bag, CAST(r.split AS INT) AS split, count(*) AS frames FROM camera c JOIN rg r ON r.bag = c.bag AND c.frame_id BETWEEN r.a AND r.b GROUP BY c.bag, r.split", "camera", extra=_SPL))
def write_splits(spark, sf):
    path = _folder(spark, "splits")
    W.write_splits(split_assign(derived(spark, sf, "camera"), ["bag"], "frame_id", 4, 20), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("bag").cast("long").alias("bag"), "split").agg(F.count(F.lit(1)).alias("frames"))


# --- documents written and read again ------------------------------------------------------------------
_CARD = """SELECT CAST(cluster_id % 25 AS BIGINT) AS map, cluster_id AS id, lon*1e3 AS x, lat*1e3 AS y, 0.125e0*(cluster_id % 8) AS z, 4.5e0 AS length, 1.75e0 AS width, 1.5e0 AS height,
   0.1e0*(cluster_id % 60) AS yaw, CAST(3 + cluster_id % 9 AS BIGINT) AS count, 0.5e0 AS conf, side, orient FROM cars"""


def _car_rows(spark, sf):
    c, k = derived(spark, sf, "cars"), F.col("cluster_id")
    return c.select((k % 25).alias("map"), k.alias("id"), (F.col("lon") * 1e3).alias("x"), (F.col("lat") * 1e3).alias("y"), (F.lit(0.125) * (k % 8)).alias("z"), F.lit(4.5).alias("length"),
                    F.lit(1.75).alias("width"), F.lit(1.5).alias("height"), (F.lit(0.1) * (k % 60)).alias("yaw"), (k % 9 + 3).alias("count"), F.lit(0.5).alias("conf"), "side", "orient")


@query("write_detection_doc", cte(f"SELECT map, id, {q('x')} AS x, {q('y')} AS y, {q('z')} AS z, {q('yaw')} AS yaw, count, conf, side, orient FROM cd", "cars", extra={"cd": _CARD}))
def write_detection_doc(spark, sf):
    path = _folder(spark, "parked")
    Doc.write_detection_docs(_car_rows(spark, sf), path, ["map"], "camera", (1.0, 2.0, 3.0))
    back = R.read_detection_doc(spark, path)
    return rounded(back, F.regexp_extract("file", r"(\d+)\.json$", 1).cast("long").alias("map"), "id", "count", "conf", "side", "orient", x="x", y="y", z="z", yaw="yaw")


@query("write_clusters_text", cte(f"SELECT map, id AS cluster_id, {q("CAST(printf('%.3f', x) AS DOUBLE)")} AS x, orient, side FROM cd", "cars", extra={"cd": _CARD}))
def write_clusters_text(spark, sf):
    path = _folder(spark, "clusters")
    Doc.write_clusters_text(_car_rows(spark, sf), path, ["map"])
    back = R.read_clusters(spark, path)
    return back.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("map"), "cluster_id", r("x").alias("x"), "orient", "side")


@query("write_boxes_text", cte("""SELECT map, printf('%d, %.3f, %.3f, %.3f, %.3f, %.3f, %.3f, %.4f, %s, %s', id, x, y, z, length, width, height, yaw, orient, side) AS value FROM cd
   UNION ALL SELECT DISTINCT map, '# cluster_id, x, y, z, length, width, height, yaw, orientation, side' FROM cd""", "cars", extra={"cd": _CARD}))
def write_boxes_text(spark, sf):
    path = _folder(spark, "boxes")
    Doc.write_boxes_text(_car_rows(spark, sf), path, ["map"])
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.txt$", 1).cast("long").alias("map"), "value")


@query("write_transforms", cte(f"SELECT bag, idx AS frame_id, {q('t_us/1e6', 6)} AS timestamp, {q('tx')} AS x, {q('ty')} AS y, {q('tz')} AS z, {q('degrees(yaw)')} AS yaw FROM odom", "odom"))
def write_transforms(spark, sf):
    o = derived(spark, sf, "odom").selectExpr("bag", "idx as frame_id", "t_us/1e6 as timestamp", "tx as x", "ty as y", "tz as z", "degrees(yaw) as yaw")
    path = _folder(spark, "transforms")
    Doc.write_transforms(o, path, ["bag"])
    back = R.read_transforms(spark, path, back_offset=0.0)
    return rounded(back, F.regexp_extract("file", r"(\d+)\.json$", 1).cast("long").alias("bag"), "frame_id", timestamp="timestamp", x="x", y="y", z="z", yaw="yaw")


@query("write_split_positions", cte("""SELECT concat(c.bag, '_', r.split) AS part, concat(c.frame_id, ', ', c.t_us) AS value FROM camera c JOIN rg r ON r.bag = c.bag AND c.frame_id BETWEEN r.a AND r.b
   UNION ALL SELECT DISTINCT concat(c.bag, '_', r.split), '# frames of the route' FROM camera c JOIN rg r ON r.bag = c.bag AND c.frame_id BETWEEN r.a AND r.b""", "camera", extra=_SPL))
def write_split_positions(spark, sf):
    rows = split_assign(derived(spark, sf, "camera"), ["bag"], "frame_id", 4, 20)
    rows = rows.withColumn("value", F.concat("frame_id", F.lit(", "), "t_us")).withColumn("head", F.lit("# frames of the route"))
    path = _folder(spark, "positions")
    Doc.write_split_positions(rows, path, ["bag", "split"], ["frame_id"], head="head")
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+_\d+)\.txt$", 1).alias("part"), "value")


@query("stored_segment", cte(f"""SELECT seg.route, best.run AS reference_run, {q('a', 4)} AS start_m, {q('b', 4)} AS end_m, n AS vertices, {q('sx', 3)} AS sum_x, {q('sy', 3)} AS sum_y, {q('ls', 4)} AS last_s
   FROM seg JOIN best USING (route) JOIN (SELECT route, count(*) AS n, sum(x) AS sx, sum(y) AS sy, max(s) AS ls FROM path GROUP BY route) USING (route)""", extra=_SEG))
def stored_segment(spark, sf):
    out = scored(spark, sf)
    folder = _folder(spark, "segments")
    Doc.write_segments(out["segments"], out["path"], folder, ["route"])
    path, segments = Doc.read_segments(spark, folder, name="route")
    line = path.groupBy("route").agg(F.count(F.lit(1)).alias("vertices"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("s").alias("ls"))
    return segments.join(line, "route").select(F.col("route").cast("long").alias("route"), "reference_run", r("start_m", 4).alias("start_m"), r("end_m", 4).alias("end_m"), "vertices",
                                               r("sx", 3).alias("sum_x"), r("sy", 3).alias("sum_y"), r("ls", 4).alias("last_s"))


@query("read_colour_map", """SELECT CAST(c_custkey AS INT) AS r, 1 AS g, 2 AS b, CASE WHEN c_custkey % 3 = 0 THEN 128 ELSE CAST(c_custkey % 256 AS INT) END AS r2, CASE WHEN c_custkey % 3 = 0 THEN 128 ELSE 7 END AS g2,
   CASE WHEN c_custkey % 3 = 0 THEN 128 ELSE 9 END AS b2 FROM customer""")
def read_colour_map(spark, sf):
    k = F.col("c_custkey").cast("long")
    entry = F.concat(F.format_string('"(%d, 1, 2)": ', k), F.when(k % 3 == 0, F.lit("null")).otherwise(F.format_string('"%d, 7,9"', k % 256)))
    part = table(spark, sf, "customer").select((k % 40).alias("id"), F.struct(k.alias("k"), entry.alias("e")).alias("s"))
    docs = part.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("s"))["e"], ", "), F.lit("}")).alias("value"))
    return Doc.read_colour_map(spark, _files(spark, docs, "colours")).select("r", "g", "b", "r2", "g2", "b2")
