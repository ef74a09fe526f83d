"""Streams replayed out of order give the batch result."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheeltrace.operators import grouping as Gp
from wheeltrace.operators import monitors as Mo
from wheeltrace.streaming import ordered as St

N = 120


def drive():
    rng = np.random.default_rng(5)
    rows = []
    for run in (1, 2):
        for i in range(N):
            still = 30 <= i < 95 if run == 1 else False
            rows.append((run, i, i + 1, 3.0 if still else i * 0.5, 0.0, 0.0, float(rng.normal()) * 6,
                         0.3 if (run == 2 and 50 <= i < 85) else 0.1, (i // 55) % 2, 1_700_000_000_000 + i * 1000))
    return pd.DataFrame(rows, columns=["run", "seq", "frame", "x", "y", "z", "v", "dist", "cand", "ms"])


def replay(spark, pdf, step, schema, order, files=4):
    """Write the rows in shuffled order inside a few files and stream them with one file per batch."""
    path = tempfile.mkdtemp(prefix="wt-stream-")
    pdf = pdf.assign(slot=pdf["ms"].rank(method="dense").astype(int) * files // (pdf["ms"].nunique() + 1))
    end = pdf.iloc[[0]].assign(ms=pdf["ms"].max() + 3_600_000, slot=files, run=-1)
    both = pd.concat([pdf, end]).sample(frac=1, random_state=3)
    df = spark.createDataFrame(both).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    for k in range(files + 1):
        df.where(F.col("slot") == k).drop("slot").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.drop("slot").schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = St.ordered_stream(stream, "run", "ts", order, step, schema, delay="5 seconds")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", St.ROCKSDB)
    name = f"out_{abs(hash(schema + str(step))) % 10**8}"
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="wt-ck-")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).where("run > 0")


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_ema_stream_matches_batch(spark):
    pdf = drive()
    want = Mo.ema_smooth(spark.createDataFrame(pdf), ["run"], "seq", "v")
    got = replay(spark, pdf, St.ema_step("v", ["run", "seq"]), "run long, seq long, smooth double", ["seq"])
    assert rows(got, "run", "seq", "smooth") == rows(want, "run", "seq", "smooth")


@pytest.mark.parametrize("kind", ["stuck", "coverage"])
def test_streak_stream_matches_batch(spark, kind):
    pdf = drive()
    batch, step = {
        "stuck": (Mo.stuck_monitor, St.stuck_step(["run", "seq"])),
        "coverage": (Mo.coverage_monitor, St.coverage_step(["run", "seq"])),
    }[kind]
    want = batch(spark.createDataFrame(pdf), ["run"], "seq")
    got = replay(spark, pdf, step, "run long, seq long", ["seq"])
    assert rows(got, "run", "seq") == rows(want, "run", "stop_at") != []


def test_hysteresis_and_hold_stream_match_batch(spark):
    pdf = drive()
    df = spark.createDataFrame(pdf)
    want = Mo.switch_hysteresis(df, ["run"], "seq", "frame", "cand", rows=16)
    got = replay(spark, pdf, St.hysteresis_step("frame", "cand", ["run", "seq"]), "run long, seq long, active long", ["seq"])
    assert rows(got, "run", "seq", "active") == rows(want, "run", "seq", "active")
    assert {r[2] for r in rows(want, "run", "seq", "active")} == {0, 1}
    want = Mo.hold_last(df, ["run"], "seq", "frame", "v", rows=16)
    got = replay(spark, pdf, St.hold_step("frame", "v", ["run", "seq"]), "run long, seq long, held double", ["seq"])
    assert rows(got, "run", "seq", "held") == rows(want, "run", "seq", "held")


def test_tracker_stream_matches_batch(spark):
    rng = np.random.default_rng(2)
    out = []
    for run in (1, 2):
        for f in range(1, 61):
            if f % 7 == 0 and f != 56:
                continue
            k = 0
            for s in range(5):
                if rng.random() < 0.6 and not (s == 2 and f > 20):
                    x = s * 6 + rng.normal() * 0.4
                    out.append((run, f, k, x, 0.0, 1, 0.5, x * 0.5, *([0.1] * 6), 1_700_000_000_000 + f * 1000))
                    k += 1
    cols = ["run", "frame", "det_idx", "x", "y", "par", "w", *Gp.BOX, "ms"]
    pdf = pd.DataFrame(out, columns=cols)
    fold = Gp._track_fold(2.0, 15, "run")
    last = pdf.groupby("run")["frame"].max()
    want = []
    for run, g in pdf.groupby("run"):
        t = fold(None, g.sort_values(["frame", "det_idx"]))
        t = t[(t["last_frame"] + 16 <= last[run]) & (t["hits"] >= 4)]
        want += [(run, int(a), int(b), int(h)) for a, b, h in zip(t["first_frame"], t["first_det"], t["hits"])]
    schema = ("run long, first_frame long, first_det long, last_frame long, px double, py double, hits long, n_par long,"
              " n_perp long, w double, " + ", ".join(f"{b} double" for b in Gp.BOX))
    got = replay(spark, pdf, St.tracker_step(), schema, ["frame", "det_idx"])
    assert rows(got, "run", "first_frame", "first_det", "hits") == sorted(want) != []
