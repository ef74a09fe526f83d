"""Operators against plain loops on small data, with chunks and limits small enough to matter."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheeltrace.operators import align as Al
from wheeltrace.operators import frechet as Fr
from wheeltrace.operators import grouping as Gp
from wheeltrace.operators import images as Im
from wheeltrace.operators import monitors as Mo
from wheeltrace.operators import nearest as Ne
from wheeltrace.operators import ordered as Od
from wheeltrace.operators import paths as Pa
from wheeltrace.operators import timesync as Ts
from wheeltrace.session import materialize


@pytest.fixture()
def many_parts(spark):
    """Keep small shuffles split, so that carries across ranges are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def shuffled(spark, pdf, parts=3):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(parts)


def sample(n=200, keys=3, seed=0):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.6, 0, rng.integers(0, keys, n))  # one hot key
    return pd.DataFrame({"k": k, "t": rng.integers(0, 60, n), "id": np.arange(n), "v": rng.normal(size=n)})


@pytest.mark.parametrize("large", [1 << 40, 0])
def test_dense_number_is_exact(many_parts, monkeypatch, large):
    monkeypatch.setattr(Od, "LARGE_BYTES", large)
    pdf = sample()
    got = Od.dense_number(shuffled(many_parts, pdf), ["k"], ["t", "id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["k", "t", "id"]).groupby("k").cumcount().sort_index()
    assert got["pos"].tolist() == want.tolist()


def test_columns_that_only_order_are_not_written(many_parts, monkeypatch):
    written = []
    monkeypatch.setattr(Od, "materialize", lambda df, *a: written.append(df.columns) or materialize(df, *a))
    pdf = sample()
    got = Od.dense_number(shuffled(many_parts, pdf), ["k"], ["t", "id"], drop=["t"]).toPandas().sort_values("id")
    want = pdf.sort_values(["k", "t", "id"]).groupby("k").cumcount().sort_index()
    assert got["pos"].tolist() == want.tolist() and list(got.columns) == ["k", "id", "v", "pos"]
    assert all("t" not in c for c in written)


def test_running_and_neighbours_cross_chunks(many_parts):
    pdf = sample().sort_values(["k", "t", "id"]).reset_index(drop=True)
    pdf["pos"] = pdf.groupby("k").cumcount()
    pdf["gap"] = pdf["v"].where(pdf["v"] > 0.5)
    df = shuffled(many_parts, pdf).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("gap"))}
    got = Od.running(df, ["k"], "pos", specs, rows=7).toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    g = pdf.groupby("k")
    np.testing.assert_allclose(got["s"], g["v"].cumsum())
    np.testing.assert_allclose(got["m"], g["v"].cummax())
    np.testing.assert_allclose(got["l"], g["gap"].ffill())
    nb = Od.neighbours(df, ["k"], "pos", {"a": ("v", -3), "b": ("v", 2)}, rows=7)
    nb = nb.toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    assert len(nb) == len(pdf)
    np.testing.assert_allclose(nb["a"], g["v"].shift(3))
    np.testing.assert_allclose(nb["b"], g["v"].shift(-2))


def test_exact_percentile(many_parts):
    pdf = sample()
    got = Od.exact_percentile(shuffled(many_parts, pdf), ["k"], "v", 0.05, "p").toPandas().set_index("k")["p"]
    want = pdf.groupby("k")["v"].apply(lambda v: np.percentile(v, 5))
    np.testing.assert_allclose(got.sort_index(), want.sort_index())


def asof_data(seed):
    rng = np.random.default_rng(seed)
    poses = pd.DataFrame({"bag": rng.integers(0, 2, 80), "t": rng.choice(1000, 80, replace=False) * 2, "x": rng.normal(size=80)})
    events = pd.DataFrame({"bag": rng.integers(0, 2, 60), "t": rng.integers(-50, 2100, 60), "e": np.arange(60)})
    events.loc[:4, ["bag", "t"]] = poses.loc[:4, ["bag", "t"]].to_numpy()  # some at pose times
    return poses, events


@pytest.mark.parametrize("seed", [0, 1])
def test_interpolation_and_nearest_match_numpy(many_parts, seed):
    poses, events = asof_data(seed)
    p, e = shuffled(many_parts, poses), shuffled(many_parts, events)
    got = Ts.interp_series(e, p, ["bag"], "t", ["x"]).toPandas().sort_values("e")
    near = Ts.nearest_pose_join(e, p, ["bag"], "t", ("x",)).toPandas().sort_values("e")
    want, want_near = [], []
    for _, r in events.iterrows():
        s = poses[poses.bag == r.bag].sort_values("t")
        want.append(np.interp(r.t, s.t, s.x))
        i = int(np.searchsorted(s.t.to_numpy(), r.t))
        ts = s.t.to_numpy()
        if i == 0:
            j = 0
        elif i == len(ts):
            j = i - 1
        else:
            j = i - 1 if abs(r.t - ts[i - 1]) < abs(r.t - ts[i]) else i
        want_near.append(ts[j])
    np.testing.assert_allclose(got["x"], want)
    assert near["pose_t"].tolist() == want_near


def test_yaw_shortest_goes_through_pi(spark):
    p = spark.createDataFrame([(0, 0, 3.0), (0, 10, -3.0)], "bag long, t long, yaw double").withColumn("tx", F.lit(0.0)).withColumn("ty", F.lit(0.0))
    e = spark.createDataFrame([(0, 5)], "bag long, t long")
    naive = Ts.interp_join_yaw_naive(e, p, ["bag"], "t").first()["yaw"]
    short = Ts.interp_join_yaw_naive(e, p, ["bag"], "t", wrap="shortest").first()["yaw"]
    assert naive == pytest.approx(0.0) and abs(short) == pytest.approx(np.pi)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_nearest_vertices(spark, monkeypatch, limit):
    """By broadcast and by ranges with tiny ranges and visits."""
    monkeypatch.setattr(Ne, "RANGE_ROWS", 20)
    monkeypatch.setattr(Ne, "VISIT_ROWS", 7)
    rng = np.random.default_rng(4)
    path = pd.DataFrame({"k": rng.integers(0, 2, 150), "idx": np.arange(150), "x": rng.normal(size=150) * 20, "y": rng.normal(size=150) * 20})
    path.loc[100:, ["x", "y"]] = path.loc[:49, ["x", "y"]].to_numpy()  # duplicates: first index wins
    pts = pd.DataFrame({"k": rng.integers(0, 3, 120), "id": np.arange(120), "px": rng.normal(size=120) * 30, "py": rng.normal(size=120) * 30})
    pts.loc[:5, "px"] += 5000  # far away
    got = Ne.nearest_target(spark.createDataFrame(pts), spark.createDataFrame(path), ["k"], ["id"], ("px", "py"), Ne.vertex("x", "y"), "idx", ("x",), broadcast_bytes=limit)
    got = got.toPandas().sort_values("id")
    for r, (_, p) in zip(got.itertuples(), pts.iterrows()):
        c = path[path.k == p.k]
        if c.empty:
            assert pd.isna(r.idx)
            continue
        d = np.hypot(c.x - p.px, c.y - p.py).to_numpy()
        assert r.dist == pytest.approx(d.min(), abs=1e-9)
        assert r.idx == c.idx.to_numpy()[d <= d.min() + 1e-12].min()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_nearest_segments(spark, monkeypatch, limit):
    monkeypatch.setattr(Ne, "RANGE_ROWS", 6)
    rng = np.random.default_rng(7)
    a = rng.normal(size=(40, 2)) * 30
    b = a + rng.normal(size=(40, 2)) * np.where(np.arange(40) % 10 == 0, 60, 3)[:, None]
    seg = pd.DataFrame({"k": 0, "s": np.arange(40), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]})
    pts = pd.DataFrame({"k": 0, "id": np.arange(60), "px": rng.normal(size=60) * 50, "py": rng.normal(size=60) * 50})
    got = Ne.nearest_target(spark.createDataFrame(pts), spark.createDataFrame(seg), ["k"] if limit else [], ["id"], ("px", "py"),
                            Ne.segment("ax", "ay", "bx", "by"), "s", broadcast_bytes=limit).toPandas().sort_values("id")
    for r, p in zip(got.itertuples(), pts[["px", "py"]].to_numpy()):
        u = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        d = np.linalg.norm(p - (a + u[:, None] * (b - a)), axis=1)
        assert r.s == d.argmin() and r.dist == pytest.approx(d.min())


def test_packed_tree_equals_all_pairs():
    rng = np.random.default_rng(12)
    for n in (1, 2, 15, 16, 17, 300, 5000):
        a = rng.integers(0, 40, (n, 2)) * 0.5
        b = a + rng.normal(size=(n, 2))
        p = np.concatenate([rng.normal(size=(200, 2)) * 30, a[:50]])
        order = rng.permutation(n)
        for line in (False, True):
            tree = Ne.PackedTree(a[:, 0], a[:, 1], *((b[:, 0], b[:, 1]) if line else (None, None)), order)
            d, row = tree.search(p[:, 0], p[:, 1])
            all_ = np.stack([tree._exact(p[:, 0], p[:, 1], np.full(len(p), t)) for t in range(n)], 1)
            assert (d == all_.min(1)).all()
            tied = np.where(all_ == all_.min(1, keepdims=True), tree.order, n)
            assert (order[row] == tied.min(1)).all()


@pytest.mark.parametrize("pairs", [1 << 19, 64])
def test_tree_holds_few_pairs_for_a_long_path_and_for_ties(monkeypatch, pairs):
    monkeypatch.setattr(Ne, "PAIRS", pairs, raising=False)
    rng, most = np.random.default_rng(0), [0]
    children = Ne.PackedTree._children

    def counted(self, level, who, node):
        out = children(self, level, who, node)
        most[0] = max(most[0], len(out[0]))
        return out

    monkeypatch.setattr(Ne.PackedTree, "_children", counted)
    x = 0.5 * np.arange(60_000)  # 30 km in a strip of 30 m
    path = x, 15 * np.sin(x / 80)
    angle = np.linspace(0, 2 * np.pi, 500)
    ring = np.where(np.arange(500) % 2, 3.0, -3.0), np.where(np.arange(500) % 4 < 2, 4.0, -4.0)  # all equally far from the middle
    px = np.append(rng.uniform(0, 33_000, 500), [0, 15_000])
    for (tx, ty), qx, qy in ((path, px, 15 * np.sin(px / 80) + rng.random(502)), (ring, np.zeros(9), np.zeros(9)),
                             ((np.cos(angle), np.sin(angle)), rng.normal(0, 1e-3, 40), np.zeros(40))):
        most[0] = 0
        d, row = Ne.PackedTree(tx, ty, None, None, np.arange(len(tx))).search(qx, qy)
        want = (qx[:, None] - tx) ** 2 + (qy[:, None] - ty) ** 2
        assert (row == want.argmin(1)).all() and np.allclose(d, want.min(1))
        assert most[0] <= max(200 * len(qx), pairs) and (pairs > 64 or most[0] <= 502 * Ne.FAN)


def test_nearest_needs_two_jobs(spark):
    path = spark.range(1000).selectExpr("id as idx", "id * 0.5 as x", "sin(id) as y", "concat('name', id) as name")
    pts = spark.range(50).selectExpr("id", "cast(null as double) as px", "0.0 as py").unionByName(spark.range(5000).selectExpr("id + 50 as id", "id * 0.11 as px", "cos(id) as py"))
    spark.sparkContext.setJobGroup("nearest", "")
    out = Ne.nearest_target(pts, path, [], ["id"], ("px", "py"), Ne.vertex("x", "y"), "idx", ("name",))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) <= 3  # an aggregate counts twice with adaptive plans
    spark.sparkContext.setJobGroup("", "")
    assert out.where("px is null and idx is null and name is null and dist is null").count() == 50
    assert out.where("px is not null and name = concat('name', idx)").count() == 5000


# --- order-dependent grouping ---------------------------------------------------------------------
def naive_first_fit(items, radius):
    clusters = []
    for o, x, y, w in items:
        for c in clusters:
            if np.hypot(x / w - c[1] / c[3], y / w - c[2] / c[3]) < radius:
                c[1] += x
                c[2] += y
                c[3] += w
                c[4] += 1
                break
        else:
            clusters.append([o, x, y, w, 1])
    return sorted((c[0], c[4], round(c[3], 6)) for c in clusters)


@pytest.mark.parametrize("max_rows", [10_000, 60, 9])
def test_first_fit_matches_loop(many_parts, max_rows):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for run, n in ((0, 150), (1, 40)):
        w = rng.uniform(0.3, 1, n)
        x = rng.integers(0, 12, n) * 3.5 + rng.normal(size=n)
        y = rng.integers(0, 2, n) * 9 + rng.normal(size=n) * 0.5
        items = [(i, x[i] * w[i], y[i] * w[i], w[i]) for i in range(n)]
        rows += [(run, *it, 1) for it in items]
        want[run] = naive_first_fit(items, 2.0)
    df = shuffled(many_parts, pd.DataFrame(rows, columns=["run", "ord", "bx", "by", "w", "n"]))
    got = Gp.first_fit(df, 2.0, sums=["n"], max_rows=max_rows).toPandas()
    for run, g in got.groupby("run"):
        assert sorted((int(a), int(b), round(c, 6)) for a, b, c in zip(g.first_ord, g.n, g.w)) == want[run]


def detections(rows):
    cols = ["run", "frame", "det_idx", "x", "y", "score", "orient", *Gp.BOX]
    return pd.DataFrame([(*r, 0.5, "parallel", *([0.1] * 7)) for r in rows], columns=cols)


def test_tracker_by_hand(spark):
    """Expected tracks worked out on paper: radius 2, confirmed from 4 hits on, dropped after 15 frames without a hit."""
    steady = [(0, f, 0, 0.5 * f, 0.0) for f in range(1, 7)]                   # moves along: one track of 6 hits
    short = [(0, f, 1, 50.0, 50.0) for f in range(1, 4)]                      # 3 hits only: never confirmed
    gap = [(0, f, 2, 100.0, 0.0) for f in (1, 2, 3, 4, 19, 20)]               # 14 frames without a hit: still the same
    lost = [(0, f, 3, 200.0, 0.0) for f in (1, 2, 3, 4, 21, 22, 23, 24)]      # 16 frames: archived, then a second track
    near = [(0, 1, 4, 300.0, 0.0), (0, 2, 4, 301.9, 0.0), (0, 3, 4, 303.8, 0.0), (0, 4, 4, 305.7, 0.0), (0, 5, 4, 307.8, 0.0)]  # the last step is too far
    pair = [(0, f, 5 + k, 400.0 + 1.5 * k, 0.0) for f in range(1, 5) for k in (0, 1)]  # two objects closer than the radius keep apart
    df = spark.createDataFrame(detections([*steady, *short, *gap, *lost, *near, *pair]))
    last = spark.createDataFrame([(0, 30)], "run long, last long")
    got = {(r.first_frame, r.first_det): (r.hits, r.archived) for r in Gp.track_static(df, last).collect()}
    assert {k: n for k, (n, _) in got.items()} == {(1, 0): 6, (1, 2): 6, (1, 3): 4, (21, 3): 4, (1, 4): 4, (1, 5): 4, (1, 6): 4}
    assert got[1, 3][1] and not got[21, 3][1]


def test_tracker_is_the_same_however_it_is_cut(many_parts):
    rng = np.random.default_rng(3)
    rows = []
    for run, sites, last in ((0, 9, 90), (1, 3, 40)):
        for f in range(1, last + 1):
            if f % 9:  # every ninth frame was processed but is empty
                at = [s for s in range(sites) if rng.random() < (0.5 if (f // 25 + s) % 2 else 0.1)]
                rows += [(run, f, i, s * 2.4 + rng.normal() * 0.5, rng.normal() * 0.4) for i, s in enumerate(at)]
    df = shuffled(many_parts, detections(rows))
    lasts = many_parts.createDataFrame([(0, 90), (1, 40)], "run long, last long")
    out = [Gp.track_static(df, lasts, max_rows=n).toPandas().sort_values(["run", "ord"]).reset_index(drop=True) for n in (10_000, 80, 12)]
    for other in out[1:]:
        pd.testing.assert_frame_equal(out[0], other, check_exact=False)
    got = out[0]
    assert got["archived"].any() and not got["archived"].all()
    assert (got.hits >= 4).all() and got.hits.sum() <= len(rows)
    assert not got.duplicated(["run", "first_frame", "first_det"]).any()  # no detection opens two tracks


@pytest.mark.parametrize("n, digits", [(300, 6), (300, 1), (30, 1)])
def test_tracker_matches_all_pairs_at_one_place(monkeypatch, n, digits):
    rng = np.random.default_rng(n + digits)
    pdf = pd.DataFrame({"run": 0, "frame": np.repeat(np.arange(6), n), "det_idx": np.tile(np.arange(n), 6)})
    pdf["x"], pdf["y"] = np.round(rng.normal(0, 1.2, (2, 6 * n)), digits)
    pdf[["par", *Gp.BOX]], pdf["w"] = 0.0, np.arange(6.0 * n)
    out = {}
    for spot in (8, 10**9):  # in cells of x order; cells as lists
        monkeypatch.setattr(Gp, "SPOT", spot, raising=False)
        out[spot] = Gp._track_fold(2.0, 1, "run")(None, pdf)
    pd.testing.assert_frame_equal(out[8], out[10**9])
    live = []  # plain loop over all pairs
    for f in range(6):
        at = pdf[pdf.frame == f]
        xy, w, free = at[["x", "y"]].to_numpy(), at.w.to_numpy(), np.ones(n, bool)
        for t in (t for t in live if t[1] + 2 >= f):
            d = np.where(free, np.sqrt(((xy - t[0]) ** 2).sum(1)), np.inf)
            k = int(d.argmin())
            if d[k] < 2.0:
                free[k] = False
                t[:] = [xy[k], f, t[2] + w[k]]
        live += [[xy[k], f, w[k]] for k in np.flatnonzero(free)]
    assert sorted(out[8].w) == sorted(t[2] for t in live)


def test_tracker_work_follows_the_detections_at_one_place():
    n = 4000
    xy = np.random.default_rng(5).normal(0, 0.2, (2, 4 * n))
    pdf = pd.DataFrame({"run": 0, "frame": np.repeat(np.arange(4), n), "det_idx": np.tile(np.arange(n), 4), "x": xy[0], "y": xy[1]})
    pdf[["par", "w", *Gp.BOX]] = 1.0
    start = time.process_time()
    out = Gp._track_fold(2.0, 15, "run")(None, pdf)
    assert out.hits.sum() == 4 * n
    assert time.process_time() - start < 3  # all pairs: 48 million distances


@pytest.mark.parametrize("max_rows", [10_000, 20])
def test_folds_run_once(spark, max_rows):
    pdf = pd.DataFrame({"run": 0, "ord": np.arange(60), "bx": np.arange(60) // 6 * 50.0, "by": 0.0, "w": 1.0, "n": 1})
    assert "FlatMapGroupsInPandas" not in plan_of(Gp.first_fit(spark.createDataFrame(pdf), 2.0, sums=["n"], max_rows=max_rows))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_stay_where_they_are_while_parts_are_found(spark):
    df = spark.createDataFrame([(i % 2, i, float(i % 60), 0.0) for i in range(600)], "run long, frame long, x double, y double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = Gp.cell_components(df, ["run"], ("x", "y"), 2.0)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert cut.count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_parts_apart_in_time_are_cut(many_parts, monkeypatch):
    """One chain of places, seen in visits far apart: no part is larger than a visit, and none needs slices."""
    rng = np.random.default_rng(4)
    rows = [(0, 40 * v + f, i, 1.5 * i + rng.normal() * 0.1, 0.0) for v in range(5) for f in range(1, 9) for i in range(6)]
    df = shuffled(many_parts, detections(rows))
    lasts = many_parts.createDataFrame([(0, 210)], "run long, last long")
    cut = Gp.cell_components(df, ["run"], ("x", "y"), 2.0, "frame", 16)
    assert sorted(r["count"] for r in cut.groupBy("comp").count().collect()) == [48] * 5
    assert Gp.cell_components(df, ["run"], ("x", "y"), 2.0).select("comp").distinct().count() == 1
    want = Gp.track_static(df, lasts).toPandas().sort_values("ord").reset_index(drop=True)
    monkeypatch.setattr(Gp, "_sliced", None)
    got = Gp.track_static(df, lasts, max_rows=48).toPandas().sort_values("ord").reset_index(drop=True)
    pd.testing.assert_frame_equal(want, got, check_exact=False)
    assert len(got) >= 25


def test_finished_clusters_leave_the_loop(many_parts, monkeypatch):
    """Along one road only the clusters near the last rows stay open from slice to slice."""
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"run": 0, "ord": np.arange(n), "bx": np.arange(n) * 0.9 + rng.normal(size=n) * 0.2, "by": 0.0, "w": 1.0, "n": 1})
    states = []
    monkeypatch.setattr(Gp, "materialize", lambda df, name, **kw: states.append((name, materialize(df, name, **kw))) or states[-1][1])
    got = Gp.first_fit(shuffled(many_parts, pdf), 2.0, sums=["n"], max_rows=20).toPandas()
    want = naive_first_fit(list(pdf[["ord", "bx", "by", "w"]].itertuples(index=False, name=None)), 2.0)
    assert sorted((int(a), int(b), round(c, 6)) for a, b, c in zip(got.first_ord, got.n, got.w)) == want
    open_ = [df.where("not done").count() for name, df in states if name == "state"]
    assert len(open_) == 20 and max(open_) <= 5 and open_[-1] == 0
    slices = next(df for name, df in states if name == "slices")
    assert "PartitionFilters: [isnotnull(_slice" in slices.where("_slice = 3")._jdf.queryExecution().toString()


def test_merge_pass_by_hand(spark):
    """Weighted means pull a cluster along, so the third point is reached only through the second."""
    w = [1.0, 3.0, 1.0, 1.0, 1.0]
    x = [0.0, 2.0, 3.9, 20.0, 22.4]
    # 0 takes 1 (2.0 away): mean 1.5; then 2 (2.4 away): mean 1.98. 3 takes 4 (2.4 away).
    zeros = {b: 0.0 for b in Gp.BOX}
    pdf = pd.DataFrame({"run": 0, "first_ord": np.arange(5), **zeros, "bx": np.multiply(x, w), "by": 0.0, "w": w, "hits": 1, "n_par": 0, "n_perp": 0, "first_frame": 1})
    got = Gp.merge_clusters(spark.createDataFrame(pdf)).toPandas().sort_values("first_ord")
    assert list(zip(got.first_ord, got.hits)) == [(0, 3), (3, 2)]
    assert got.w.tolist() == [5.0, 2.0] and (got.bx / got.w).tolist() == pytest.approx([9.9 / 5, 21.2])


# --- curves ---------------------------------------------------------------------------------------
def naive_frechet(p, q):
    ca = np.zeros((len(p), len(q)))
    for i in range(len(p)):
        for j in range(len(q)):
            d = np.hypot(*(p[i] - q[j]))
            prev = [ca[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
            ca[i, j] = max(d, min(prev)) if prev else d
    return ca[-1, -1]


@pytest.mark.parametrize("block, strip, fan, direct", [(16, 1024, 32, 0), (2, 4, 2, 0), (1, 1, 3, 0), (2, 4, 2, None), (1, 1, 3, 400)])
def test_frechet_matches_loop(spark, monkeypatch, block, strip, fan, direct):
    """Also with tiny blocks, strips and groups of maps, so that every way of composing is used."""
    for name, value in (("LEAST_BLOCK", block), ("STRIP", strip), ("FAN", fan)):
        monkeypatch.setattr(Fr, name, value)
    rng = np.random.default_rng(6)
    curves = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0) for k, n in ((0, 30), (1, 17), (2, 1), (3, 24))}
    pdf = pd.DataFrame([(k, i, *pt) for k, c in curves.items() for i, pt in enumerate(c)], columns=["run", "seq", "x", "y"])
    df = spark.createDataFrame(pdf)
    got = {(r.p, r.q): r.frechet for r in Fr.frechet_discrete(df.where("run < 3"), df.where("run > 0"), direct_cells=direct).collect()}
    assert len(got) == 9
    for (a, b), v in got.items():
        assert v == pytest.approx(naive_frechet(curves[a], curves[b]))
    assert got[(1, 1)] == 0
    best = Fr.frechet_min(spark.createDataFrame([(0, 5, 2.0), (0, 4, 2.0), (0, 9, 3.0)], "p long, q long, frechet double")).first()
    assert (best.min_frechet, best.vs) == (2.0, 4)


def search_by_strips(p, q, block, strip):
    """The search without Spark: bounds, strips, maps and candidates of one pair."""
    boxes = [np.array([[*c[i:i + block].min(0), *c[i:i + block].max(0)] for i in range(0, len(c), block)]) for c in (p, q)]
    low, high, j0, j1 = Fr.stretch(*boxes)
    low, high = low * (1 - 1e-12) - 1e-300, high * (1 + 1e-12) + 1e-300
    a = np.repeat(j0 * block, block)[:len(p)].tolist()
    b = np.repeat(np.minimum((j1 + 1) * block, len(q)), block)[:len(p)].tolist()
    limits = np.linspace(max(low, 0), high, 9)[1:-1]
    while True:
        out, ends = None, []
        for i in range(0, len(p), strip):
            rows = slice(i, i + strip)
            above = (a[i - 1], b[i - 1]) if i else (0, 0)
            lo, hi, live = Fr.strip_map(p[rows, 0], p[rows, 1], q[:, 0], q[:, 1], a[rows], b[rows], above, limits, i == 0)
            last = a[rows][-1]
            m = np.where(lo <= hi, lo - last, Fr.NOWHERE), np.where(lo <= hi, hi - last, -1), live
            out = m if out is None else Fr.compose(out, m)
            ends.append(Fr.between(p[rows, 0], p[rows, 1], q[:, 0], q[:, 1], a[rows], b[rows], np.concatenate([[low], limits, [high]])))
        through = out[2][:, -1]
        k = int(through.argmax()) if through.any() else len(limits)
        left = np.unique(np.concatenate([e[k] for e in ends]))
        low, high = limits[k - 1] if k else low, limits[k] if k < len(limits) else high
        limits = Fr.thinned(left, 5)
        if not len(limits):
            return np.sqrt(high)


def band_of(p, q, block):
    boxes = [np.array([[*c[i:i + block].min(0), *c[i:i + block].max(0)] for i in range(0, len(c), block)]) for c in (p, q)]
    _, _, j0, j1 = Fr.stretch(*boxes)
    return np.repeat(j0 * block, block)[:len(p)], np.repeat(np.minimum((j1 + 1) * block, len(q)), block)[:len(p)]


def test_frechet_search_on_many_curves():
    rng = np.random.default_rng(8)
    for t in range(120):
        n, m = rng.integers(1, 40, 2)
        if t % 3:  # like drives along one road, with turns back
            p, q = (np.stack([np.cumsum(rng.normal(0.4, 0.5, k)), rng.normal(0, 0.4, k)], 1) for k in (n, m))
        else:
            p, q = rng.integers(0, 4, (n, 2)).astype(float), rng.integers(0, 4, (m, 2)).astype(float)  # many ties
        block, strip = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        want = naive_frechet(p, q)
        assert search_by_strips(p, q, block, strip * block) == pytest.approx(want, abs=1e-12), t
        a, b = band_of(p, q, block)
        assert np.sqrt(Fr.band_minimax(p[:, 0], p[:, 1], q[:, 0], q[:, 1], a, b)) == pytest.approx(want, abs=1e-12), t


def drives_of(rng, t, most):
    n, m = rng.integers(1, most, 2)
    if t % 3:  # like drives along one road, with turns back
        return tuple(np.stack([np.cumsum(rng.normal(0.4, 0.5, k)), rng.normal(0, 0.4, k)], 1) for k in (n, m))
    return rng.integers(0, 4, (n, 2)).astype(float), rng.integers(0, 4, (m, 2)).astype(float)  # many ties


def test_frechet_tables_of_strips_on_many_curves(monkeypatch):
    """Bands from boxes of several sizes, and tables of strips of several pairs swept side by side, against the plain loop."""
    monkeypatch.setattr(Fr, "COARSE", 4)
    rng = np.random.default_rng(9)
    for t in range(60):
        monkeypatch.setattr(Fr, "FINER", int(rng.integers(2, 5)))
        monkeypatch.setattr(Fr, "BAND_CELLS", 60 if t % 7 == 0 else 10**6)
        monkeypatch.setattr(Fr, "SIDE_BY_SIDE", int(rng.integers(1, 40)))
        block, strip = int(rng.integers(1, 4)), int(rng.integers(1, 5))
        pairs, strips = [drives_of(rng, t, 50) for _ in range(3)], []
        for k, (p, q) in enumerate(pairs):
            a, b = band_of(p, q, block)
            want = naive_frechet(p, q)
            assert np.sqrt(Fr.band_minimax(p[:, 0], p[:, 1], q[:, 0], q[:, 1], a, b)) == pytest.approx(want, abs=1e-12), t
            for i in range(0, len(p), strip * block):
                rows = slice(i, i + strip * block)
                strips.append((k, want, (p[rows, 0], p[rows, 1], q[:, 0], q[:, 1], a[rows], b[rows], (a[i - 1], b[i - 1]) if i else (-1, 0))))
        out = {}
        for (k, want, _), table in zip(strips, Fr.strip_values([s for _, _, s in strips])):
            out[k] = (want, Fr.compose_values(out[k][1], table) if k in out else table)
        assert len(out) == 3
        for want, table in out.values():
            assert np.sqrt(table[0, -1]) == pytest.approx(want, abs=1e-12), t


@pytest.mark.parametrize("wide, strip, together", [(0, 4, 64), (1024, 4, 64), (1024, 3, 1)])
def test_frechet_ways_agree(spark, monkeypatch, wide, strip, together):
    """Search and tables of values, with pairs of several sizes."""
    for name, value in (("LEAST_BLOCK", 2), ("STRIP", strip), ("COARSE", 4), ("WIDE", wide), ("TOGETHER", together)):
        monkeypatch.setattr(Fr, name, value)
    rng = np.random.default_rng(4)
    curves = {k: c for k, c in enumerate([*drives_of(rng, 1, 60), *drives_of(rng, 3, 30)])}
    df = spark.createDataFrame(pd.DataFrame([(f"c{k}", i, *pt) for k, c in curves.items() for i, pt in enumerate(c)], columns=["run", "seq", "x", "y"]))
    got = {(r.p, r.q): r.frechet for r in Fr.frechet_discrete(df, df, direct_cells=0).collect()}
    assert len(got) == 16
    for (a, b), v in got.items():
        assert v == pytest.approx(naive_frechet(curves[int(a[1])], curves[int(b[1])]), abs=1e-12)


def test_frechet_of_curves_that_end_apart(spark, monkeypatch):
    """A short drive beside a long one has a wide band; its end settles the distance without a search."""
    for name, value in (("LEAST_BLOCK", 2), ("STRIP", 4), ("WIDE", 4)):
        monkeypatch.setattr(Fr, name, value)
    monkeypatch.setattr(Fr, "_search", None)
    x = np.arange(60) * 0.4
    curves = {0: np.stack([x, np.sin(x)], 1), 1: np.stack([x, np.sin(x) + 0.3], 1)[:45], 2: np.stack([x, np.sin(x) - 0.2], 1)[12:]}
    df = spark.createDataFrame(pd.DataFrame([(k, i, *pt) for k, c in curves.items() for i, pt in enumerate(c)], columns=["run", "seq", "x", "y"]))
    got = {(r.p, r.q): r.frechet for r in Fr.frechet_discrete(df.where("run > 0"), df.where("run = 0"), direct_cells=0).collect()}
    assert got == {(k, 0): pytest.approx(naive_frechet(curves[k], curves[0]), abs=1e-12) for k in (1, 2)}
    rng = np.random.default_rng(2)
    for t in range(200):  # only ever the distance itself
        p, q = drives_of(rng, t, 12)
        d = Fr.walk(p[:, 0].tolist(), p[:, 1].tolist(), q[:, 0].tolist(), q[:, 1].tolist())
        assert d is None or np.sqrt(d) == pytest.approx(naive_frechet(p, q), abs=1e-12)


def test_frechet_sweep_of_long_curves_is_narrow():
    """The boxes of long curves along one road leave a band as narrow as their distance, not as a large block."""
    s = np.arange(120_000) * 0.35
    p, q = (np.stack([s, 15 * np.sin(s / 80) + k * np.cos(s)], 1) for k in (0.2, 0.5))
    a, b = band_of(p, q, Fr.LEAST_BLOCK)
    assert (b - a).max() <= 200


def test_frechet_jobs_do_not_follow_the_length(spark, monkeypatch):
    rounds = []
    for n in (200, 3000):
        count = []
        monkeypatch.setattr(Fr, "materialize", lambda df, name: count.append(name) or materialize(df, name))
        s = np.arange(n) * 0.3
        rows = [(k, i, float(x), float(np.sin(x / 9) + k * np.cos(x))) for k in (0, 1) for i, x in enumerate(s)]
        df = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "seq", "x", "y"]))
        assert Fr.frechet_discrete(df.where("run = 0"), df.where("run = 1"), direct_cells=0).count() == 1
        rounds.append(len(count))
    assert rounds[1] <= rounds[0] + 2 and rounds[1] < 14


def test_downsample_curve_matches_linspace(spark):
    df = spark.createDataFrame([(0, i) for i in range(1234)], "run long, seq long")
    got = sorted(r.seq for r in Fr.downsample_curve(df, "run", "seq", 500).collect())
    assert got == sorted(set(np.linspace(0, 1233, 500, dtype=int).tolist()))


def test_resample_and_arc_length(many_parts):
    rng = np.random.default_rng(9)
    pts = np.cumsum(rng.uniform(0, 1, size=(60, 2)), axis=0)
    df = shuffled(many_parts, pd.DataFrame({"run": 0, "seq": np.arange(60), "x": pts[:, 0], "y": pts[:, 1]}))
    arc = Pa.arc_length(df, ["run"], "seq", rows=7)
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(pts, axis=0).T))])
    np.testing.assert_allclose([r.s for r in arc.orderBy("seq").collect()], s)
    got = Pa.resample_path(arc, ["run"], "seq", spacing=0.5).orderBy("idx").toPandas()
    at = np.linspace(0, s[-1], max(int(s[-1] / 0.5) + 1, 2))
    np.testing.assert_allclose(got["s"], at)
    np.testing.assert_allclose(got["x"], np.interp(at, s, pts[:, 0]))
    tan = Pa.path_tangent(df, ["run"], "seq", rows=7).orderBy("seq").toPandas()
    g = np.gradient(pts, axis=0)
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    np.testing.assert_allclose(tan[["tx", "ty"]], g)


def test_kinematic_yaw_matches_loop(spark):
    rng = np.random.default_rng(12)
    step = rng.normal(size=(43, 2)) * (rng.random(43) > 0.5)[:, None]
    step[5:14] = 0
    pts = np.cumsum(step, axis=0)
    last, want = 0.0, []
    for i in range(43):
        j = min(i + 5, 42)
        a, b = (max(0, i - 5), i) if j == i else (i, j)
        d = pts[b] - pts[a]
        if not (abs(d[0]) < 0.001 and abs(d[1]) < 0.001):
            last = np.degrees(np.arctan2(d[1], d[0])) % 360
        want.append(last)
    df = spark.createDataFrame(pd.DataFrame({"bag": 0, "i": np.arange(43), "x": pts[:, 0], "y": pts[:, 1]}))
    got = [r.yaw_deg for r in Pa.kinematic_yaw(df, ["bag"], "i", rows=8).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)


# --- monitors, splits, images ---------------------------------------------------------------------
def test_ema_matches_loop(spark):
    v = np.random.default_rng(1).normal(size=900) * 15
    prev, want = None, []
    for x in v:
        prev = x if prev is None else 0.85 * prev + (1 - 0.85) * x
        want.append(max(min(prev, 9.0), -9.0))
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "i": np.arange(900), "v": v}))
    got = [r.smooth for r in Mo.ema_smooth(df, ["k"], "i", "v", rows=300).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_hysteresis_by_hand(spark):
    """A candidate takes over in the fifth frame after it appeared, and only if it stayed until then."""
    cand = [0] * 3 + [1] * 8 + [2] * 4 + [1] * 2 + [2] * 6 + [0] * 5 + [2] + [0] * 6
    want = [0] * 8 + [1] * (3 + 4 + 2 + 5) + [2] * (1 + 5 + 1 + 5) + [0]
    for rows in (16, 5):
        df = spark.createDataFrame(pd.DataFrame({"k": 0, "i": np.arange(len(cand)), "f": np.arange(1, len(cand) + 1), "c": cand}))
        got = [r.active for r in Mo.switch_hysteresis(df, ["k"], "i", "f", "c", delay=5, rows=rows).orderBy("i").collect()]
        assert got == want


def test_smoothing_keeps_all_history(spark):
    v = np.zeros(2300)
    v[3] = 1e80  # still 5.3e7 and more beyond the first chunk border
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "i": np.arange(len(v)), "v": v}))
    got = {r.i: r.smooth for r in Mo.ema_smooth(df, ["k"], "i", "v", limit=1e300).where("i in (3, 1023, 1024, 2200)").collect()}
    for i, x in got.items():
        assert x == pytest.approx(0.15 * 1e80 * 0.85 ** (i - 3), rel=1e-9)


def test_best_split_matches_loop(spark):
    rng = np.random.default_rng(5)
    splits = [(0, 10, 40), (1, 35, 60), (2, 58, 90), (3, 100, 120)]
    walk = np.clip(np.cumsum(rng.integers(-9, 10, 300)) + 50, 0, 140)
    cur, want = 0, []
    for f in walk:
        if not splits[cur][1] <= f <= splits[cur][2]:
            cover = [s for s in splits if s[1] <= f <= s[2]]
            if cover:
                cur = max(cover, key=lambda s: s[2])[0]
            else:
                gap = [s[1] - f if f < s[1] else f - s[2] for s in splits]
                cur = int(np.argmin(gap))
        want.append(cur)
    df = spark.createDataFrame(pd.DataFrame({"bag": 0, "pos": np.arange(300), "frame": walk}))
    sp = spark.createDataFrame([(0, *s) for s in splits], "bag long, split long, min_frame long, max_frame long")
    got = [r.split_idx for r in Al.best_split(df, sp, ["bag"], "pos", "frame", rows=16).orderBy("pos").collect()]
    assert got == want


def test_small_components_match_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        mask = rng.random((14, 17)) < 0.45
        seen, want = np.zeros_like(mask), np.zeros_like(mask)
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            stack, comp = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                comp.append((a, b))
                for c in range(max(a - 1, 0), min(a + 2, 14)):
                    for d in range(max(b - 1, 0), min(b + 2, 17)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            if len(comp) < 6:
                for a, b in comp:
                    want[a, b] = True
        assert (Im.small_components(mask, 6) == want).all()
    assert not Im.small_components(np.zeros((3, 3), bool), 5).any()


def test_similarity_fit_recovers_transform(spark):
    rng = np.random.default_rng(3)
    src = rng.normal(size=(50, 3)) * 10
    a = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    a *= np.sign(np.linalg.det(a))
    dst = 0.7 * src @ a.T + [1, 2, 3]
    df = spark.createDataFrame(pd.DataFrame(np.hstack([src, dst]), columns=list("abcxyz")))
    fit = Al.similarity_fit_nd(df, list("abc"), list("xyz"))
    assert fit["scale"] == pytest.approx(0.7)
    np.testing.assert_allclose(fit["rotation"], a, atol=1e-9)
    np.testing.assert_allclose(fit["translation"], [1, 2, 3], atol=1e-9)


def test_frame_match_needs_three(spark):
    a = spark.createDataFrame([(1,), (2,)], "f long")
    with pytest.raises(ValueError):
        Al.frame_match(a, a, ["f"])


def test_frame_match_counts_each_data_set(spark):
    a = spark.createDataFrame([(1, f) for f in range(5)] + [(2, f) for f in range(5)], "bag long, f long")
    with pytest.raises(ValueError, match="2"):
        Al.frame_match(a, a.where("bag = 1 or f = 0"), ["bag", "f"])
    assert Al.frame_match(a, a, ["bag", "f"])[0].count() == 10


def test_similarity_fit_3d_per_key(spark):
    """Noisy points, reflections that no rotation reaches, flat and single points: as the singular value decomposition has it."""
    rng = np.random.default_rng(21)
    frames = []
    for k in range(12):
        n = 1 if k == 11 else 40
        a = rng.normal(size=(n, 3)) * [5, 3, 0 if k == 10 else 2]
        u, _, v = np.linalg.svd(rng.normal(size=(3, 3)))
        turn = u @ v * (-1 if np.linalg.det(u @ v) < 0 else 1)
        b = 0.5 * k * a @ turn.T + rng.normal(size=3) + rng.normal(size=(n, 3)) * 0.3
        if k == 9:
            b[:, 0] *= -1
        frames.append(pd.DataFrame({"k": k, **{c: a[:, i] for i, c in enumerate("abc")}, **{c: b[:, i] for i, c in enumerate("xyz")}}))
    df = spark.createDataFrame(pd.concat(frames))
    got = {r.k: r for r in Al.similarity_fit_3d(df, ["k"], "abc", "xyz").collect()}
    for k, f in enumerate(frames[:11]):
        a, b = f[list("abc")].to_numpy(), f[list("xyz")].to_numpy()
        want = Al.similarity_fit_nd(spark.createDataFrame(f), list("abc"), list("xyz"))
        np.testing.assert_allclose(np.reshape(got[k].rotation, (3, 3)), want["rotation"], atol=1e-7)
        assert got[k].scale == pytest.approx(want["scale"])
        np.testing.assert_allclose(got[k].translation, want["translation"], atol=1e-7)
        left = b - (want["scale"] * a @ np.array(want["rotation"]).T + want["translation"])
        assert got[k].rms == pytest.approx(np.sqrt((left ** 2).sum(1).mean()), abs=1e-6)
    assert got[11].scale is None and got[11].rotation is None and got[11].rms is None


def test_maps_compose_by_doubling():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        maps = rng.integers(0, 5, (n, 5))
        state, want = np.arange(5), []
        for m in maps:
            state = m[state]
            want.append(state)
        assert (Al.composed(maps) == np.array(want)).all()


def test_summaries_do_not_move_the_rows(spark, monkeypatch):
    from wheeltrace.operators import ordered

    monkeypatch.setattr(ordered, "LARGE_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).selectExpr("id % 3 as bag", "id as frame", "id * 0.01 as yaw", "id * 1.0 as x", "id * 0.5 as y")
        splits = spark.range(3).selectExpr("id as bag", "0L as split", "0.0 as cx", "0.0 as cy", "1.0 as a", "0.0 as b", "0.0 as tx", "0.0 as ty")
        for out in (Al.split_assign(rows, ["bag"], "frame", 4, 2), Al.nearest_centroid(rows, splits, ["bag"], "x", "y")):
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert Al.circular_mean(rows, ["bag"], "yaw").count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_similarity_fit_per_key(spark):
    rows = [(1, x, y, 2 * x + 1 + e, 2 * y - 1) for x, y, e in ((0, 0, 0.3), (4, 0, -0.3), (4, 3, 0.3), (0, 3, -0.3))] + [(2, 1.0, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], "k long, a double, b double, x double, y double")
    got = {r.k: r for r in Al.similarity_fit(df, ["k"], "ab", "xy").collect()}
    assert got[2].scale is None and got[2].t_x is None and got[2].rms is None
    g, fixed = got[1], {r.k: r for r in Al.similarity_fit(df, ["k"], "ab", "xy", with_scale=False).collect()}[1]
    for fit in (g, fixed):
        c, s = fit.scale * np.cos(fit.theta), fit.scale * np.sin(fit.theta)
        err = [(x - (c * a - s * b + fit.t_x)) ** 2 + (y - (s * a + c * b + fit.t_y)) ** 2 for k, a, b, x, y in rows if k == 1]
        assert fit.rms == pytest.approx(np.sqrt(np.mean(err)))
    assert fixed.scale == 1 and fixed.rms > g.rms > 0


def test_equal_times_have_no_rate(spark):
    from wheeltrace.operators import score as S

    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, 2.0), (1, 2, 0.5, 4.0)], "k long, i long, t double, v double")
    got = [(r.i, r.rate) for r in S.rate_of_change(df, ["k"], "i", "v", "t").orderBy("i").collect()]
    assert got == [(1, None), (2, 4.0)]


def test_colours_are_replaced_one_after_the_other(spark):
    px = spark.createDataFrame([(k, (k, 0, 0)) for k in range(5)], "id long, c struct<r: int, g: int, b: int>")
    remap = spark.createDataFrame([(1, 0, 0, 2, 0, 0), (2, 0, 0, 3, 0, 0), (4, 0, 0, 1, 0, 0)], "r int, g int, b int, r2 int, g2 int, b2 int")
    got = {r.id: r.c.r for r in Im.remap_colours(px, "c", remap).collect()}
    assert got == {0: 0, 1: 3, 2: 3, 3: 3, 4: 1}


def test_edges_without_length_have_no_line(spark):
    from wheeltrace.operators import scene as Sc

    e = spark.createDataFrame([(1, 11.0, 48.0, 11.0, 48.0), (2, 11.0, 48.0, 11.001, 48.0)], "id long, lon0 double, lat0 double, lon1 double, lat1 double")
    assert {r.id for r in Sc.parking_lines(e, "id", {}, override=True).collect()} == {2}


def test_every_condition_has_its_columns(spark):
    from wheeltrace.operators import score as S

    df = spark.createDataFrame([("a", "rain", 90.0), ("a", "sunny", 100.0), ("b", "rain", 100.0)], "method string, condition string, completion_pct double")
    got = {r.method: r.rain_fail for r in S.condition_matrix(df).collect()}
    assert got == {"a": "1/1", "b": "0/1"}
    assert "rain_fail" not in S.condition_matrix(df, conditions=["sunny"]).columns
