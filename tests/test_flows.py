"""The end-to-end flows on small made-up drives."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheeltrace.operators.grouping import BOX
from wheeltrace.plans import flows


def test_score_drives(spark):
    s = np.arange(0, 60, 0.4)
    real, sim = [], []
    for run, off in ((1, 0.0), (2, 0.5)):
        real += [(run, i, i * 0.1, x, off) for i, x in enumerate(s)]
    for run, off, upto in ((11, 0.25, 60), (12, 2.0, 60), (13, 0.0, 20)):
        sim += [(run, "gs", i, x, off, np.sin(i)) for i, x in enumerate(s) if x < upto]
    r = spark.createDataFrame(pd.DataFrame(real, columns=["run", "seq", "t", "x", "y"]))
    d = spark.createDataFrame(pd.DataFrame(sim, columns=["run", "method", "seq", "x", "y", "steer"]))
    steer = spark.createDataFrame(pd.DataFrame([(1, 0.05 + k * 0.11, np.cos(k)) for k in range(100)], columns=["run", "t", "steer"]))
    out = flows.score_drives(r, d, steer)
    done = {x.run: x.success for x in out["completion"].collect()}
    assert done == {11: True, 12: True, 13: False}
    q = {x.run: x for x in out["quality"].collect()}
    assert set(q) == {11, 12}
    assert q[11].frechet == pytest.approx(0.25) and q[11].out_pct == 0
    assert q[12].frechet == pytest.approx(1.5) and q[12].min_frechet_vs == 2
    assert q[12].out_pct == 100 and q[12].mean_excess == pytest.approx(1.5)
    assert {x.method for x in out["jitter"].collect()} == {"gs", "real_world"}
    doc = json.loads(out["document"].first().value)
    assert doc["segment"]["length_m"] == pytest.approx(out["segment"]["length_m"])
    assert len(doc["drive_quality"]) == 2 and doc["drive_quality_averages"][0]["method"] == "gs"


def test_methods_may_share_run_numbers(spark):
    s = np.arange(0, 60, 0.4)
    real = [(1, i, i * 0.1, x, 0.0) for i, x in enumerate(s)]
    sim = [(1, m, i, x, off, 0.0) for m, off in (("gs", 0.25), ("nerf", 1.5)) for i, x in enumerate(s)]
    out = flows.score_drives(
        spark.createDataFrame(pd.DataFrame(real, columns=["run", "seq", "t", "x", "y"])),
        spark.createDataFrame(pd.DataFrame(sim, columns=["run", "method", "seq", "x", "y", "steer"])))
    got = {(x.method, x.run): x.frechet for x in out["quality"].collect()}
    assert got == {("gs", 1): pytest.approx(0.25), ("nerf", 1): pytest.approx(1.5)}
    assert {(x.method, x.run) for x in out["completion"].collect()} == set(got)


def test_many_scenarios_in_one_job(spark):
    """Two routes at different places with different segments; drives of one route are not held against the other."""
    s = np.arange(0, 60, 0.4)
    real, sim, steer = [], [], []
    for route, y, n in (("a", 0.0, 150), ("b", 500.0, 100)):
        real += [(route, run, i, i * 0.1, x, y + off) for run, off in ((1, 0.0), (2, 0.5)) for i, x in enumerate(s[:n])]
        sim += [(route, 1, m, i, x, y + off, np.sin(i)) for m, off in (("gs", 0.25), ("nerf", 2.0)) for i, x in enumerate(s[:n])]
        steer += [(route, 1, 0.05 + k * 0.11, np.cos(k)) for k in range(80)]
    frames = [spark.createDataFrame(pd.DataFrame(rows, columns=cols)) for rows, cols in (
        (real, ["route", "run", "seq", "t", "x", "y"]), (sim, ["route", "run", "method", "seq", "x", "y", "steer"]), (steer, ["route", "run", "t", "steer"]))]
    out = flows.score_drives(*frames, keys=["route"])
    assert "segment" not in out
    seg = {r.route: r.length_m for r in out["segments"].collect()}
    assert seg["a"] == pytest.approx(s[149], abs=0.6) and seg["b"] == pytest.approx(s[99], abs=0.6)
    got = {(x.route, x.method): (x.frechet, x.min_frechet_vs, x.out_pct) for x in out["quality"].collect()}
    assert got == {(k, m): (pytest.approx(f), v, o) for k in "ab" for m, f, v, o in (("gs", 0.25, 1, 0.0), ("nerf", 1.5, 2, 100.0))}
    assert {(x.route, x.method) for x in out["jitter"].collect()} == {(k, m) for k in "ab" for m in ("gs", "nerf", "real_world")}
    docs = {r.route: json.loads(r.value) for r in out["document"].collect()}
    assert {k: len(d["drive_quality"]) for k, d in docs.items()} == {"a": 2, "b": 2}
    assert docs["b"]["segment"]["length_m"] == pytest.approx(seg["b"])
    entry = next(e for e in docs["b"]["drive_quality"] if e["method"] == "nerf")
    assert entry["min_frechet_vs"] == "run2" and entry["corridor_violation_pct"] == 100 and entry["min_frechet_m"] == pytest.approx(1.5)


def test_no_common_segment_is_an_error(spark):
    r = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(20)] + [(2, 0, 3.0, 0.0)], "run long, seq long, x double, y double")
    with pytest.raises(ValueError):
        flows.score.scenario_segment(r)
    with pytest.raises(ValueError, match="route"):
        flows.score.scenario_segments(r.withColumn("k", F.lit("route")), ["k"])


@pytest.mark.parametrize("sensor", ["lidar", "camera"])
def test_parked_cars(spark, sensor):
    rng = np.random.default_rng(0)
    poses = spark.createDataFrame(pd.DataFrame({"run": 0, "t_us": np.arange(100) * 10, "x": np.arange(100) * 1.0, "y": 0.0}))
    rows = []
    for f in range(1, 11):
        for k, (cx, cy, yaw) in enumerate(((20, 4, 0.0), (40, -4, 1.57), (60, 4, 3.1))):
            x, y = cx + rng.normal() * 0.1, cy + rng.normal() * 0.1
            rows.append((0, f, k, x, y, 0.8, "parallel", x, y, 0.0, 4.5, 1.8, 1.5, yaw))
    det = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "frame", "det_idx", "x", "y", "score", "orient", *BOX]))
    last = spark.createDataFrame([(0, 10)], "run long, last long")
    cars = flows.parked_cars(det, poses, sensor, (0.0, 0.0, 0.0), last_frames=last).orderBy("id").collect()
    assert [(c.id, c.side, c.orient, c["count"]) for c in cars] == [
        (1, "left", "parallel", 10), (2, "right", "perpendicular", 10), (3, "left", "parallel", 10)]
    assert cars[0].conf == pytest.approx(0.8)


def test_synchronise(spark):
    odo = spark.createDataFrame(pd.DataFrame({"bag": 1, "t_us": [0, 100], "tx": [0.0, 10.0], "ty": 0.0, "tz": 0.0, "qx": 0.0, "qy": 0.0, "qz": [0.0, 1.0], "qw": [1.0, 0.0]}))
    msg = spark.createDataFrame([(1, 50, 7, True), (1, 25, 8, False), (1, 150, 9, True)], "bag long, t_us long, event_id long, ok boolean")
    got = flows.synchronise(msg, odo, decodable=F.col("ok")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.tx) for r in got] == [(0, 5.0), (1, 10.0)]
    assert got[0].yaw == pytest.approx(np.pi / 2)


def test_method_averages_holds_the_distances(spark, tmp_path):
    """The mean distance per method is that of the runs' own Frechet distances."""
    import __spark_entry__ as entry

    spark.range(1200).selectExpr("id as o_orderkey", "(id * 7 + id div 11) % 6 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    q = entry.queries()
    closest = {r.p: r.min_frechet for r in q["frechet_min"](spark, str(tmp_path)).collect()}
    got = {r.method: r.avg_frechet_m for r in q["method_averages"](spark, str(tmp_path)).collect()}
    assert set(closest) == {3, 4, 5}
    assert got == {"gs": pytest.approx(closest[4], abs=1e-3), "sim": pytest.approx((closest[3] + closest[5]) / 2, abs=1e-3)}
