"""Readers on small hand-written files, and known values."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheeltrace.functions import geodesy as G
from wheeltrace.operators import scene as Sc
from wheeltrace.sources import readers as R
from wheeltrace.sources import sinks as W


def put(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def test_known_coordinate_pair(spark):
    df = spark.createDataFrame([(692921.2199, 5339074.0196)], "x double, y double")
    row = G.utm_to_wgs84(df, "x", "y").first()
    assert row.lat == pytest.approx(48.17559486315574, abs=1e-8)
    assert row.lon == pytest.approx(11.5951469668968, abs=1e-8)
    back = G.sim_to_utm(G.utm_to_sim(df, "x", "y", "sx", "sy", (-8e5, -5e6)), "sx", "sy", "x2", "y2", (-8e5, -5e6)).first()
    assert (back.x2, back.y2) == pytest.approx((692921.2199, 5339074.0196), abs=1e-5)


def test_odometry(spark, tmp_path):
    head = "timestamp,tx,ty,tz,qx,qy,qz,qw,yaw\n"
    put(tmp_path, "bagA/odometry.csv", head + "2.5,1,2,3,0,0,0,1,0.5\n1.5,1,2,3,0,0,0,1,0.25\n")
    got = R.read_odometry(spark, f"{tmp_path}/*/odometry.csv").orderBy("timestamp").collect()
    assert [(r.bag, r.timestamp, r.yaw) for r in got] == [("bagA", 1.5, 0.25), ("bagA", 2.5, 0.5)]


def test_trajectory_layouts(spark, tmp_path):
    put(tmp_path, "a.csv", "# log\ntimestamp,x,y,z,yaw\n1,2,3,4,5\nbad,2,3,4,5\n")
    put(tmp_path, "b.csv", "1, 2, 3, 4, 5\n6,7,8\n")
    put(tmp_path, "c.csv", "Yaw, Z, Y, X, Timestamp\n5,4,3,2,1\n")
    put(tmp_path, "empty.csv", "")
    got = R.read_trajectory(spark, str(tmp_path)).collect()
    assert sorted(r.path[-5:] for r in got) == ["a.csv", "b.csv", "c.csv"]
    assert {(r.timestamp, r.x, r.y, r.z, r.yaw) for r in got} == {(1.0, 2.0, 3.0, 4.0, 5.0)}


def test_frame_positions(spark, tmp_path):
    put(tmp_path, "p.txt", "# FrameID\n0, 1.0, 10, 20, 0.5, f0.bin\n1, 1.1, 11, 21, 9, 0,0,0,1, 0.75, f1.png\n"
        "0, 1.2, 12, 22, 0.6, f0b.bin\nx, 1, 2, 3, 4, f\n2, 1.3\n")
    kept, rejected = R.read_frame_positions(spark, str(tmp_path))
    got = {r.frame_id: (r.x, r.yaw, r.file) for r in kept.collect()}
    assert got == {0: (12.0, 0.6, "f0b.bin"), 1: (11.0, 0.75, "f1.png")}
    assert rejected.count() == 2


def test_series_and_sim_trajectories(spark, tmp_path):
    put(tmp_path, "s/steering_1.txt", "# ts, value\n1.0, 0.5\n2.0\nx, y\n3.0, -0.25, extra\n")
    got = R.read_series(spark, f"{tmp_path}/s").orderBy("ts").collect()
    assert [(r.topic, r.ts, r.value) for r in got] == [("steering_1.txt", 1.0, 0.5), ("steering_1.txt", 3.0, -0.25)]
    put(tmp_path, "j/a_run1_trajectory.json", '[{"frame":1,"x":0,"y":0,"steer_raw":0.5,"steer_norm":0.1},{"frame":2,"x":1,"y":0,"steer_raw":1.5}]')
    put(tmp_path, "j/b_run1_trajectory.json", '[{"frame":1,"x":0,"y":0,"steering":0.5}]')
    put(tmp_path, "j/c_run1_trajectory.json", '[{"frame":1,"x":0,"y":0}]')
    sim = R.read_sim_trajectory(spark, f"{tmp_path}/j")
    got = {(r.file[0], r.frame): r.steer for r in sim.collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 1.5, ("b", 1): pytest.approx(0.5 * 3 * np.pi), ("c", 1): None}
    names = R.run_catalog(sim.select(F.col("file").alias("name")).distinct(), default_method="m").collect()
    assert {(r.method, r.condition, r.run) for r in names} == {("m", c, 1) for c in "abc"}
    assert {r.points for r in R.validate_runs(sim, ["file"], "frame").collect()} == {1, 2}
    every = sim.select("file").union(spark.createDataFrame([("empty.json",)], "file string"))
    assert {r.file: r.points for r in R.validate_runs(sim, ["file"], "frame", every).collect()}["empty.json"] == -1
    put(tmp_path, "k/d.json", '[{"frame":1,"x":0,"y":0,"steering_raw_rad":0.25}]')
    assert R.read_sim_trajectory(spark, f"{tmp_path}/k", alias="steering_raw_rad").first().steer == 0.25


def test_run_names(spark):
    names = spark.createDataFrame([("/d/gs_run3_trajectory.json",), ("/d/gs_fast_run12/trajectory.json",), ("/d/rain_gs_run4_trajectory.json",), ("/d/notes.txt",)], "name string")
    got = {(r.method, r.condition, r.run) for r in R.run_catalog(names, scheme="method").collect()}
    assert got == {("gs", None, 3), ("gs_fast", None, 12), ("rain_gs", None, 4)}
    assert {(r.method, r.condition, r.run) for r in R.run_catalog(names).collect()} == {(None, "gs", 3), ("gs_fast", None, 12), ("gs", "rain", 4)}


def test_transforms_and_hero_start(spark, tmp_path):
    t = '[{"frame_id":7,"timestamp":1.0,"transform":{"location":{"x":1,"y":2,"z":0.3},"rotation":{"pitch":0,"yaw":90,"roll":0}}}]'
    put(tmp_path, "r.json", t)
    row = R.read_transforms(spark, str(tmp_path)).first()
    assert (row.x, row.y, row.yaw) == pytest.approx((1.0, 1.87, 90.0))
    rear = R.read_transforms(spark, str(tmp_path), back_offset=0.0).withColumn("bag", F.lit(1))
    docs = spark.createDataFrame([(1, ([0.0, 0.0, 0.0], 0.0)), (2, ([5.0, 6.0, 7.0], 8.0))],
                                 "bag int, hero_car struct<position: array<double>, heading: double>")
    got = {r.bag: (r.source, r.x, r.z) for r in Sc.hero_start(rear.limit(0), rear, docs, ["bag"], "frame_id").collect()}
    assert got == {1: ("rear", 1.0, pytest.approx(0.8)), 2: ("document", 5.0, 7.5)}


def test_clusters(spark, tmp_path):
    put(tmp_path, "c.txt", "# id, x, y\n1.0, 2, 3, 0, 4, 0.9, parallel, left, 0-255-0\n2, 1, 1\n3, oops, 1\n4, 1\nnan, 1, 2\ninf, 1, 2\n5, 1, 1, left, RIGHT, Perpendicular\n")
    got = {r.cluster_id: (r.orient, r.side) for r in R.read_clusters(spark, str(tmp_path)).collect()}
    assert got == {1: ("parallel", "left"), 2: ("unknown", "unknown"), 5: ("perpendicular", "right")}


def test_detection_document(spark, tmp_path):
    put(tmp_path, "d.json", '{"source":"lidar","dataset_name":"d","global_origin":[1,2,3],"cars":[{"id":1,"x":5,"y":6,"length":4.5,"width":1.75,"height":1.5,"side":"left"},{"id":2,"x":7,"y":8}]}')
    got = R.read_detection_doc(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.x, r.length, r.width, r.height, r.global_origin[0], r.side) for r in got] == [
        (1, 5.0, 4.5, 1.75, 1.5, 1.0, "left"), (2, 7.0, None, None, None, 1.0, None)]


def test_point_clouds(spark, tmp_path):
    def cloud(name, values):
        put(tmp_path, name, np.asarray(values, dtype=np.float32).tobytes())

    cloud("four.bin", [1, 2, 3, 255, 4, 5, 6, 51])
    cloud("three.bin", [1, 2, 3, 4, 5, 6, 7, 8, 9])
    cloud("bad.bin", [1, 2, 3, 4, 5])
    cloud("empty.bin", [])
    got = R.read_point_clouds(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.point, r.x, round(r.i, 3)))
    assert by == {"four.bin": [(0, 1.0, 1.0), (1, 4.0, 0.2)], "three.bin": [(0, 1.0, 0.0), (1, 4.0, 0.0), (2, 7.0, 0.0)]}
    small = R.read_point_clouds(spark, str(tmp_path), range_bytes=16)  # a point or so in each range
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got))
    from wheeltrace.sources.python_sources import _CloudReader

    parts = _CloudReader({"path": str(tmp_path), "rangebytes": "16", "taskbytes": "16"}).partitions()
    assert [len(p.parts) for p in parts] == [1] * 5
    assert [len(p.parts) for p in _CloudReader({"path": str(tmp_path)}).partitions()] == [2]
    assert R.read_point_clouds(spark, f"{tmp_path}/f*.bin").count() == 2 and R.read_point_clouds(spark, f"{tmp_path}/three.bin").count() == 3
    assert R.read_point_clouds(spark, f"{tmp_path}/empty.bin").count() == 0


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_label_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    cls = rng.integers(0, 3, (8, 8))
    colours = np.array([[10, 10, 10], [10, 8, 132], [120, 70, 130]])
    put(tmp_path, "frame_000001.png", png(colours[cls] + rng.integers(-5, 6, (8, 8, 1))))
    same = R.read_label_images(spark, str(tmp_path), size=None).first()
    assert np.array(same.cls).reshape(8, 8).tolist() == cls.tolist()
    half = R.read_label_images(spark, str(tmp_path), size=(4, 4)).first()
    assert np.array(half.cls).reshape(4, 4).tolist() == cls[1::2, 1::2].tolist()
    big = R.read_label_images(spark, str(tmp_path)).first()
    assert (big.h, big.w, len(big.cls)) == (512, 512, 512 * 512)


OSM = """<osm version="0.6"><bounds minlat="48.0" minlon="11.0" maxlat="48.2" maxlon="11.4"/>
<node id="1" lat="48.1" lon="11.1"/><node id="2" lat="48.1" lon="11.2" visible="true"/><node id="3" lat="48.15" lon="11.2"/>
<node id="4" lat="48.0" lon="11.0" visible="false"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="parking:lane:left" v="Parallel"/></way>
<way id="11"><nd ref="1"/><nd ref="3"/><tag k="highway" v="footway"/></way>
<way id="12"><nd ref="1"/><nd ref="2"/><nd ref="4"/><tag k="building" v="yes"/><tag k="building:levels" v="3"/></way></osm>"""


def test_osm_edges_lines_and_buildings(spark, tmp_path):
    put(tmp_path, "map.osm", OSM)
    nodes, ways, bounds = R.read_osm(spark, str(tmp_path))
    assert nodes.count() == 3 and ways.count() == 3
    edges = Sc.osm_edges(nodes, ways)
    assert sorted((r.u, r.v, r.reversed) for r in edges.collect()) == [(1, 2, False), (2, 1, True), (2, 3, False), (3, 2, True)]
    tagged = edges.where("not reversed").withColumn("pl", F.col("tags")["parking:lane:left"])
    lines = Sc.parking_lines(tagged, "way_id", {"parking:lane:left": "pl"}).collect()
    assert [r.side for r in lines] == ["left", "left"]
    east = next(r for r in lines if r.x0 != r.x1 and abs(r.y0 - r.y1) < 1e-12)
    assert east.y0 == pytest.approx(48.1 + 6 / 111320)  # left of an eastward road is north
    m = F.lit(0).alias("m")
    stats = Sc.building_stats(nodes, ways, []).first()
    assert (stats.way_id, stats.height, stats.vertices) == (12, 9.0, 2)
    centre = Sc.map_centre(nodes.select("*", m), bounds.select("*", m), ["m"]).first()
    assert (centre.lat, centre.lon) == pytest.approx((48.1, 11.2))


def test_map_header(spark, tmp_path):
    put(tmp_path, "a.xodr", '<?xml version="1.0"?><OpenDRIVE><header north="4" south="2" east="10" west="-2"><geoReference><![CDATA[+proj=utm +zone=32]]></geoReference>'
        '<offset x="-10.5" y="20" z="0"/></header></OpenDRIVE>')
    put(tmp_path, "b.xodr", "<OpenDRIVE><header/></OpenDRIVE>")
    got = {r.file: (r.geo_reference, r.offset_x, r.offset_y, r.center_x, r.center_y) for r in R.read_map_header(spark, str(tmp_path)).collect()}
    assert got == {"a.xodr": ("+proj=utm +zone=32", -10.5, 20.0, 4.0, 3.0), "b.xodr": ("+proj=tmerc", 0.0, 0.0, 0.0, 0.0)}


def test_calibration_and_camera(spark, tmp_path):
    put(tmp_path, "s/shift.txt", "SHIFT_X=1.5\nOTHER=3\nYAW_OFFSET=0.25\n")
    row = R.read_calibration(spark, f"{tmp_path}/s").first()
    assert (row.shift_x, row.shift_y, row.yaw_offset) == (1.5, 0.0, 0.25)
    put(tmp_path, "t/twice.txt", "SHIFT_X=1\nSHIFT_X=2\n")
    put(tmp_path, "t/bad.txt", "SHIFT_X=1\nSHIFT_Y=oops\n")
    assert {r.file: (r.shift_x, r.shift_y) for r in R.read_calibration(spark, f"{tmp_path}/t").collect()} == {"twice.txt": (2.0, 0.0), "bad.txt": (0.0, 0.0)}
    put(tmp_path, "c/nested.json", '{"size":{"x":256},"camera":{"fov":54.7,"fps":30,"position":{"x":1,"y":2,"z":3},"pitch":-5}}')
    put(tmp_path, "c/flat.json", '{"fov":60,"position":{"x":1,"y":2,"z":3}}')
    got = {r.file: (r.size, r.fov, r.fps, r.pitch) for r in R.read_camera_config(spark, f"{tmp_path}/c").collect()}
    assert got == {"nested.json": (256, 54.7, 30, -5.0), "flat.json": (512, 60.0, 20, 0.0)}
    put(tmp_path, "bad/no.json", '{"fov":60,"position":{"x":1,"y":2}}')
    with pytest.raises(Exception, match="position"):
        R.read_camera_config(spark, f"{tmp_path}/bad").collect()


def test_incremental_results(spark, tmp_path):
    frames = spark.range(6).withColumnRenamed("id", "frame")
    calls = []

    def compute(tag):
        def run(todo):
            calls.append(todo.count())
            return todo.withColumn("by", F.lit(tag))

        return run

    path = f"{tmp_path}/res"
    W.incremental_results(frames.where("frame < 2"), compute("a"), path, ["frame"])
    out = W.incremental_results(frames, compute("b"), path, ["frame"])
    assert calls == [2, 4] and out.where("by = 'a'").count() == 2 and out.count() == 6
    assert W.incremental_results(frames, compute("c"), path, ["frame"], force=True).where("by = 'c'").count() == 6
    part = W.incremental_results(frames.where("frame = 1"), compute("d"), path, ["frame"], force=True)
    assert sorted((r.frame, r.by) for r in part.collect()) == [(0, "c"), (1, "d"), (2, "c"), (3, "c"), (4, "c"), (5, "c")]


def test_killed_and_doubled_writers_leave_each_key_once(spark, tmp_path):
    from wheeltrace.sources import python_sources as PS

    path = f"{tmp_path}/res"
    frames = spark.range(8).withColumnRenamed("id", "frame")
    W.write_results(frames.where("frame < 4").withColumn("by", F.lit("a")), path)
    before = PS.published_files(path)
    # a writer whose third task fails: staged files are there, but no manifest names them
    fail = F.when(F.col("frame") == 7, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="killed"):
        W.write_results(frames.repartition(4).withColumn("by", fail), path)
    (tmp_path / "res" / "data" / "left-over.parquet").write_bytes(b"half a file")
    assert PS.published_files(path) == before
    assert sorted((r.frame, r.by) for r in W.stored_results(spark, path, ["frame"]).collect()) == [(k, "a") for k in range(4)]
    # two writers that both saw the same gap: the later one counts, each key is there once
    for tag in "bc":
        W.write_results(frames.where("frame >= 4").withColumn("by", F.lit(tag)), path)
    assert sorted((r.frame, r.by) for r in W.stored_results(spark, path, ["frame"]).collect()) == [(k, "a" if k < 4 else "c") for k in range(8)]
    # a key may have several rows; force touches its keys only
    W.incremental_results(frames.where("frame = 2"), lambda f: f.crossJoin(spark.range(2)).selectExpr("frame", "concat('d', id) as by"), path, ["frame"], force=True)
    got = sorted((r.frame, r.by) for r in W.stored_results(spark, path, ["frame"]).collect())
    assert got == sorted([(2, "d0"), (2, "d1"), *[(k, "a") for k in (0, 1, 3)], *[(k, "c") for k in range(4, 8)]])
    assert W.stored_results(spark, f"{tmp_path}/none", ["frame"]) is None


def test_documents_round_trip(spark, tmp_path):
    from wheeltrace.sources import documents as D

    cars = spark.createDataFrame(
        [("a/b", 2, 1.0, 2.0, 0.5, 4.5, 1.8, 1.5, 0.25, 3, 0.9, "left", "parallel"), ("a/b", 1, 5.0, 6.0, 0.5, 4.5, 1.8, 1.5, 0.25, 4, 0.8, "right", "perpendicular"),
         (None, 1, 7.0, 8.0, 0.0, 4.0, 1.8, 1.5, 0.0, 5, 0.7, "left", "parallel")],
        "bag string, id long, x double, y double, z double, length double, width double, height double, yaw double, count long, conf double, side string, orient string")
    assert D.write_detection_docs(cars, f"{tmp_path}/docs", ["bag"], "lidar", (1, 2, 3)) == 2
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == ["a-b.json", "none.json"]
    got = R.read_detection_doc(spark, f"{tmp_path}/docs").orderBy("file", "id").collect()
    assert [(r.file, r.id, r.x, r.global_origin, r.source) for r in got] == [("a-b.json", 1, 5.0, [1, 2, 3], "lidar"), ("a-b.json", 2, 1.0, [1, 2, 3], "lidar"), ("none.json", 1, 7.0, [1, 2, 3], "lidar")]
    D.write_clusters_text(cars, f"{tmp_path}/clusters", ["bag"])
    assert (tmp_path / "clusters" / "a-b.txt").read_text() == D.CLUSTERS_HEAD + "\n1, 5.000, 6.000, 0.500, 4, 0.800, perpendicular, right\n2, 1.000, 2.000, 0.500, 3, 0.900, parallel, left\n"
    D.write_boxes_text(cars, f"{tmp_path}/boxes", ["bag"])
    assert (tmp_path / "boxes" / "none.txt").read_text() == D.BOXES_HEAD + "\n1, 7.000, 8.000, 0.000, 4.000, 1.800, 1.500, 0.0000, parallel, left\n"
    lines = spark.createDataFrame([("b", 0, 2, "2, x", None), ("b", 0, 10, "10, y", None), ("b", 1, 2, "2, x", "# own\n# head")], "bag string, split int, frame long, value string, head string")
    D.write_split_positions(lines, f"{tmp_path}/pos", ["bag", "split"], ["frame"], head="head")
    assert (tmp_path / "pos" / "b_0.txt").read_text() == D.POSITIONS_HEAD + "\n2, x\n10, y\n"
    assert (tmp_path / "pos" / "b_1.txt").read_text() == "# own\n# head\n2, x\n"
    put(tmp_path, "map/colours.json", '{"(1, 2, 3)": "4,5,6", "(7,8,9)": null, "odd": "1,2,3", "(1, 1, 1)": "x"}')
    assert sorted(tuple(r) for r in D.read_colour_map(spark, f"{tmp_path}/map").collect()) == [(0, 1, 2, 3, 4, 5, 6), (1, 7, 8, 9, 128, 128, 128)]


def test_stored_segment_scores_like_a_computed_one(spark, tmp_path):
    from wheeltrace.operators import paths, score
    from wheeltrace.sources import documents as D

    rows = [(route, run, i, 0.4 * i + 0.01 * run, 5.0 * run) for route in ("a", "b") for run in (1, 2) for i in range(60)]
    real = spark.createDataFrame(rows, "route string, run long, seq long, x double, y double")
    path, projected, segments = score.scenario_segments(real, ["route"])
    D.write_segments(segments, path, f"{tmp_path}/seg", ["route"])
    path2, segments2 = D.read_segments(spark, f"{tmp_path}/seg", name="route")
    assert sorted(map(tuple, segments2.collect())) == sorted(map(tuple, segments.select(*segments2.columns).collect()))
    again = paths.project_runs(real, path2, ["route"], ("route", "run"))
    a, b = (score.completion(p, s, ("route", "run")).orderBy("route", "run").collect() for p, s in ((projected, segments), (again, segments2)))
    assert a == b


def test_short_paths_keep_their_points(spark):
    from wheeltrace.operators.paths import fit_path

    rows = [("two", 0, 0.0, 0.0), ("two", 1, 4.0, 0.0), ("three", 0, 0.0, 0.0), ("three", 1, 1.0, 0.0), ("three", 2, 1.0, 3.0), ("one", 0, 5.0, 5.0)]
    rows += [("four", k, float(k), 0.0) for k in range(4)]
    got = fit_path(spark.createDataFrame(rows, "bag string, t long, x double, y double"), ["bag"], ["t"])
    n = {r.bag: r["count"] for r in got.groupBy("bag").count().collect()}
    assert n == {"two": 2000, "three": 3, "four": 2000}
    assert [(r.idx, r.x, r.y, r.tx, r.ty) for r in got.where("bag = 'three'").orderBy("idx").collect()][0] == (0, 0.0, 0.0, 1.0, 0.0)
    assert [(r.x, r.y) for r in got.where("bag = 'three'").orderBy("idx").collect()] == [(0.0, 0.0), (1.0, 0.0), (1.0, 3.0)]


def test_topics_by_hand(spark):
    from wheeltrace.operators.timesync import topic_summary

    rows = [("a", "/cam", "Image", 30), ("a", "/cam", "Image", 10), ("a", "/odom", "Pose", 5), ("b", "/cam", "Image", 7)]
    got = topic_summary(spark.createDataFrame(rows, "bag string, topic string, msgtype string, t_us long")).orderBy("bag", "topic").collect()
    assert [tuple(r) for r in got] == [("a", "/cam", "Image", 2, 10, 30, 5, 30), ("a", "/odom", "Pose", 1, 5, 5, 5, 30), ("b", "/cam", "Image", 1, 7, 7, 7, 7)]


def test_fixed_decimals_round_the_exact_value(spark):
    values = [0.00015, 5339007.49675, 0.125, 2.5, -1.00005, -0.0, 1e-9, 123456789.00005, 1e20, 0.1 + 0.2, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.select("i", W.fixed_line({"v": 4}).alias("a"), W.fixed_line({"v": 2}).alias("b"), W.fixed_line({"v": 0}).alias("c")).orderBy("i").collect()
    for v, r in zip(values, rows):
        assert [r.a, r.b, r.c] == (["null"] * 3 if v is None else [f"{v:.4f}", f"{v:.2f}", f"{v:.0f}"]), v
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),)], "v double").select(W.fixed_line({"v": 3}).alias("a")).collect()
    assert [r.a for r in odd] == ["NaN", "-Infinity"]


def test_documents_in_folders_are_listed_by_tasks(spark, tmp_path):
    for k in range(30):
        put(tmp_path, f"docs/{k % 4}/{k}.txt", f"SHIFT_X={k}\nYAW_OFFSET=0.5\n")
    put(tmp_path, "docs/1/_hidden.txt", "SHIFT_X=9")
    put(tmp_path, "docs/_temporary/7.txt", "SHIFT_X=9")
    out = R.read_calibration(spark, f"{tmp_path}/docs", r"(\d+)\.txt$", folders=True)
    assert sorted((int(r.file), r.shift_x, r.yaw_offset) for r in out.collect()) == [(k, float(k), 0.5) for k in range(30)]
    head = R.read_map_header(spark, f"file://{tmp_path}/docs", r"(\d+)\.txt$", folders=True)
    assert head.count() == 30 and head.rdd.getNumPartitions() == 4
