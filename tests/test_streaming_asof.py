"""As-of joins of two streams against the batch operators on the same rows."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheeltrace.operators import timesync as Ts
from wheeltrace.streaming import asof
from wheeltrace.streaming import ordered as St

START = 1_700_000_000_000_000


def made(seed=5):
    rng = np.random.default_rng(seed)
    poses, events = [], []
    for run in (1, 2):
        t = START + np.sort(rng.choice(200_000, 120, replace=False)) * 1000  # 200 seconds
        yaw = np.cumsum(rng.normal(size=120) * 0.2)
        poses += [(run, int(a), float(i), float(np.sin(i)), 0.5, 0.0, 0.0, float(np.sin(y / 2)), float(np.cos(y / 2))) for i, (a, y) in enumerate(zip(t, yaw))]
        at = START + rng.choice(np.arange(-5_000, 206_000), 90, replace=False) * 1000
        events += [(run, int(a), i, f"f{i}.png") for i, a in enumerate(at)] + [(run, int(t[7]), 1000, "same.png")]
    p = pd.DataFrame(poses, columns=["run", "t_us", "tx", "ty", "tz", "qx", "qy", "qz", "qw"])
    return p, pd.DataFrame(events, columns=["run", "t_us", "frame", "file"])


def stream_of(spark, pdf, files, end):
    """A stream of the rows in files by time (a few seconds mixed), and a last file that moves the watermark on."""
    path = tempfile.mkdtemp(prefix="wt-asof-")
    rng = np.random.default_rng(1)
    slot = ((pdf["t_us"] - START + rng.integers(-2_000_000, 2_000_000, len(pdf))) // 40_000_000).clip(0, files - 1)
    last = pdf.iloc[[0]].assign(t_us=end, run=-1)
    for k in range(files + 1):
        part = last if k == files else pdf[slot == k].sample(frac=1, random_state=k)
        df = spark.createDataFrame(part).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, out, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", St.ROCKSDB)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="wt-ck-")).start()
    try:
        q.processAllAvailable()
        late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    finally:
        q.stop()
    return spark.table(name).where("run > 0").toPandas(), late


@pytest.mark.parametrize("nearest", [False, True])
def test_asof_of_streams_equals_batch(spark, nearest):
    p, e = made()
    end = START + 3_600_000_000
    poses, events = stream_of(spark, p, 5, end), stream_of(spark, e, 5, end)
    pb, eb = spark.createDataFrame(p), spark.createDataFrame(e)
    if nearest:
        out = asof.asof_stream(events, poses, "run", "ts", ["tx", "ty", "tz"], ["frame", "file"], nearest=True, delay="8 seconds", patience_seconds=300)
        want, cols = Ts.nearest_pose_join(eb, pb, ["run"], "t_us"), ["tx", "ty", "tz"]
    else:
        out = asof.interp_stream(events, poses, "run", "ts", ["frame", "file"], delay="8 seconds", patience_seconds=300)
        want, cols = Ts.interp_join(eb, pb, ["run"], "t_us"), ["tx", "ty", "tz", "qx", "qy", "qz", "qw", "yaw"]
    got, late = run(spark, out, f"asof_{int(nearest)}")
    keys = ["run", "frame", "file", "t_us"]
    got, want = (d[[*keys, *cols]].sort_values(keys).reset_index(drop=True) for d in (got, want.toPandas()))
    assert late == 0 and len(got) == len(e)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_late_rows_are_counted(spark):
    p, e = made()
    end = START + 3_600_000_000
    late_event = e.iloc[[0]].assign(frame=5000, t_us=START + 1_000_000)
    # the late row comes in a file of its own, after the watermark has moved
    path = tempfile.mkdtemp(prefix="wt-late-")
    first = spark.createDataFrame(e).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")
    first.coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(e.iloc[[0]].assign(t_us=end, run=-1)).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(late_event).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    poses = spark.readStream.schema(spark.createDataFrame(p).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us").schema).option("maxFilesPerTrigger", 1).parquet(_poses_in_one(spark, p, end))
    got, late = run(spark, asof.asof_stream(events, poses, "run", "ts", ["tx"], ["frame"], delay="8 seconds", patience_seconds=300), "asof_late")
    assert late == 1 and 5000 not in set(got["frame"]) and len(got) == len(e)


def _poses_in_one(spark, p, end):
    path = tempfile.mkdtemp(prefix="wt-poses-")
    for part in (p, p.iloc[[0]].assign(t_us=end, run=-1), p.iloc[[0]].assign(t_us=end + 1, run=-1)):
        spark.createDataFrame(part).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us").coalesce(1).write.mode("append").parquet(path)
    return path
