"""Queries: detections, tracks and clusters, point clouds."""

from pyspark.sql import functions as F

from wheeltrace.operators import detect as D
from wheeltrace.operators import grouping as Gp
from wheeltrace.operators.ordered import dense_number
from wheeltrace.plans.derived import cte, derived
from wheeltrace.plans.q_path import _FITT, fitted
from wheeltrace.plans.registry import q, query, r, rounded

_RANGE = "sqrt(x*x + y*y)"


@query("detection_filter", cte(f"""SELECT 'camera' AS sensor, run, frame, det_idx FROM detections WHERE score >= 0.28e0 AND label = 0 AND z <= 50
   UNION ALL SELECT 'lidar', run, frame, det_idx FROM detections WHERE score >= 0.5e0 AND label = 1 AND {_RANGE} <= 40""", "detections"))
def detection_filter(spark, sf):
    d = derived(spark, sf, "detections")
    cols = ("run", "frame", "det_idx")
    cam = D.filter_camera(d).select(F.lit("camera").alias("sensor"), *cols)
    return cam.unionByName(D.filter_lidar(d, label=1).select(F.lit("lidar").alias("sensor"), *cols))


@query("correct_detection", cte(f"""SELECT run, frame, det_idx, {q('x*0.84e0')} AS x, {q('y')} AS y, {q('c')} AS z, {q('score*(1/(1 + c/20))')} AS weight
   FROM (SELECT *, (tax*100 + 5)*0.85e0 - 2.2e0 AS c FROM detections)""", "detections"))
def correct_detection(spark, sf):
    d = derived(spark, sf, "detections").withColumn("z", F.col("tax") * 100 + 5)
    return rounded(D.correct_detection(d), "run", "frame", "det_idx", x="x", y="y", z="z", weight="weight")


def _mat(m):
    return [[repr(v) for v in row] for row in m]


def _pose_sql(chain, box, trans, yaw_dir):
    """Rotation by 0.3 about z after the fixed chain, written out per axis."""
    m = _mat(chain)
    p = [f"({m[i][0]}*({box[0]}) + {m[i][1]}*({box[1]}) + {m[i][2]}*({box[2]}) + {m[i][3]})" for i in range(3)]
    d = [f"({m[i][0]}*({yaw_dir[0]}) + {m[i][1]}*({yaw_dir[1]}) + {m[i][2]}*({yaw_dir[2]}))" for i in range(3)]
    rot = lambda v: (f"(cos(0.3e0)*{v[0]} - sin(0.3e0)*{v[1]})", f"(sin(0.3e0)*{v[0]} + cos(0.3e0)*{v[1]})", v[2])
    c, w = rot(p), rot(d)
    return [f"{c[i]} + {trans[i]}" for i in range(3)], f"atan2({w[1]}, {w[0]})"


from wheeltrace.functions.angles import camera_chain, lidar_chain  # noqa: E402

_CAM_C, _CAM_Y = _pose_sql(camera_chain(), ("x", "y", "z + 10"), ("5e0", "-3e0", "1e0"), ("cos(yaw)", "0e0", "-sin(yaw)"))
_LID_C, _LID_Y = _pose_sql(lidar_chain(), ("x", "y", "z - 0.25e0 + hgt/2"), ("5e0", "-3e0", "1e0"), ("cos(yaw)", "sin(yaw)", "0e0"))


def _quat():
    return (F.lit(0.0), F.lit(0.0), F.sin(F.lit(0.15)), F.cos(F.lit(0.15)))


def _trans():
    return (F.lit(5.0), F.lit(-3.0), F.lit(1.0))


@query("box_to_world", cte(f"SELECT run, frame, det_idx, {q(_CAM_C[0], 5)} AS x, {q(_CAM_C[1], 5)} AS y, {q(_CAM_C[2], 5)} AS z, {q(_CAM_Y, 5)} AS yaw FROM detections", "detections"))
def box_to_world(spark, sf):
    c, yaw = D.box_to_world(("x", "y", F.col("z") + 10), "yaw", _quat(), _trans())
    return rounded(derived(spark, sf, "detections"), "run", "frame", "det_idx", x=c[0], y=c[1], z=c[2], yaw=yaw, digits=5)


@query("box_to_global", cte(f"SELECT run, frame, det_idx, {q(_LID_C[0], 5)} AS x, {q(_LID_C[1], 5)} AS y, {q(_LID_C[2] + ' - hgt/2', 5)} AS z, {q(_LID_Y, 5)} AS yaw FROM detections", "detections"))
def box_to_global(spark, sf):
    c, yaw = D.box_to_global(("x", "y", "z"), "hgt", "yaw", 0.25, _quat(), _trans())
    return rounded(derived(spark, sf, "detections"), "run", "frame", "det_idx", x=c[0], y=c[1], z=c[2], yaw=yaw, digits=5)


_K = (417.37, 425.19, 400.13, 250.71)  # focal lengths and centre of the test camera
_CORN = " UNION ALL ".join(
    f"SELECT run, frame, det_idx, {4 * k + i} AS k, cos(yaw)*({sl}*len/2) + sin(yaw)*({sh}*hgt/2) + x - 60 AS cx, {sw}*wid/2 + y*0.1e0 AS cy, "
    f"-sin(yaw)*({sl}*len/2) + cos(yaw)*({sh}*hgt/2) + tax*300 + 1e0 AS cz FROM detections"
    for k, sh in enumerate((-1, 1)) for i, (sl, sw) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))


@query("box_corners", cte("""SELECT run, frame, det_idx, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM px GROUP BY run, frame, det_idx
   HAVING min(cz) > 0 AND bool_or(u >= 0 AND u < 800 AND v >= 0 AND v < 503)""", "detections",
   extra={"corn": _CORN, "px": """SELECT *, CASE WHEN cz > 0 THEN CAST(trunc(cx/cz*417.37e0 + 400.13e0) AS INT) END AS u,
      CASE WHEN cz > 0 THEN CAST(trunc(cy/cz*425.19e0 + 250.71e0) AS INT) END AS v FROM corn"""}))
def box_corners(spark, sf):
    d = derived(spark, sf, "detections")
    c = D.box_corners(F.col("x") - 60, F.col("y") * 0.1, F.col("tax") * 300 + 1.0, "len", "wid", "hgt", "yaw")
    vis = D.visible_boxes(d.select("run", "frame", "det_idx", c.alias("corners")), "corners", _K, (800, 503))
    u, v = F.col("pixels.u"), F.col("pixels.v")
    return vis.select("run", "frame", "det_idx", F.array_min(u).alias("u0"), F.array_max(u).alias("u1"),
                      F.array_min(v).alias("v0"), F.array_max(v).alias("v1"))


@query("pinhole", cte("""SELECT run, frame, det_idx, count(*) AS corners, sum(u) AS su, sum(v) AS sv FROM px WHERE cz > 0 GROUP BY run, frame, det_idx""", "detections",
   extra={"corn": _CORN, "px": """SELECT *, CASE WHEN cz > 0 THEN CAST(trunc(cx/cz*417.37e0 + 400.13e0) AS BIGINT) END AS u,
      CASE WHEN cz > 0 THEN CAST(trunc(cy/cz*425.19e0 + 250.71e0) AS BIGINT) END AS v FROM corn"""}))
def pinhole(spark, sf):
    c = D.box_corners(F.col("x") - 60, F.col("y") * 0.1, F.col("tax") * 300 + 1.0, "len", "wid", "hgt", "yaw")
    front = F.filter(c, lambda p: p["z"] > 0)
    px = derived(spark, sf, "detections").select("run", "frame", "det_idx", F.inline(D.pinhole(front, *_K)))
    return px.groupBy("run", "frame", "det_idx").agg(F.count(F.lit(1)).alias("corners"), F.sum("u").alias("su"), F.sum("v").alias("sv"))


def camera_detections(spark, sf):
    """Filtered detections with boxes, orientation and processed-frame numbers."""
    d = D.filter_camera(derived(spark, sf, "detections"))
    return d.select(
        "run", (F.col("frame") + 1).alias("frame"), "det_idx", "x", "y", "score",
        F.when(F.col("yaw") < 0.785, "parallel").otherwise("perpendicular").alias("orient"),
        F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), F.col("len").alias("bl"),
        F.col("wid").alias("bw"), F.col("hgt").alias("bh"), F.col("yaw").alias("byaw"),
    )


def tracks(spark, sf):
    d = camera_detections(spark, sf)
    last = derived(spark, sf, "detections").groupBy("run").agg((F.max("frame") + 1).alias("last"))
    return Gp.track_static(d, last)


# the tracker as a recursion over frames; inside a frame the tracks are folded in creation order
_PARTS = {"bx": "x", "by_": "y", "bz": "z", "bl": "len", "bw": "wid", "bh": "hgt", "ba": "yaw"}
_NEW = "struct_pack(ff := frame, fd := d.k, l := frame, x := d.x, y := d.y, n := 1, sw := d.w, " + ", ".join(f"{n} := d.{c}*d.w" for n, c in _PARTS.items()) + ")"
_HIT = "sw := e.o[1].sw + m.w, " + ", ".join(f"{n} := e.o[1].{n} + m.{c}*m.w" for n, c in _PARTS.items())
_BOX = ", ".join(f"{c} := {{0}}{c}" for c in ("z", "len", "wid", "hgt", "yaw"))
_TRK = {
    "cd": "SELECT run, frame + 1 AS frame, det_idx, x, y, score AS w, z, len, wid, hgt, yaw FROM detections WHERE score >= 0.28e0 AND label = 0 AND z <= 50",
    "fr": """SELECT run, frame, list(struct_pack(d := 0e0, k := det_idx, x := x, y := y, w := w, """ + _BOX.format("") + """) ORDER BY det_idx) AS dets,
      CAST(row_number() OVER (PARTITION BY run ORDER BY frame) AS BIGINT) AS i FROM cd GROUP BY run, frame""",
    "trk(run, i, st) USING KEY (run)": """SELECT run, i, list_transform(dets, lambda d: """ + _NEW + """) FROM fr WHERE i = 1
      UNION ALL SELECT run, i, list_concat(acc.o, list_transform(acc.f, lambda d: """ + _NEW + """)) FROM (
        SELECT f.run, f.i, f.frame, list_reduce(list_prepend(struct_pack(o := list_filter(t.st, lambda z: false), f := f.dets), list_transform(t.st, lambda z: struct_pack(o := [z], f := list_filter(f.dets, lambda d: false)))),
          lambda a, e: CASE WHEN e.o[1].l + 16 >= f.frame AND len(list_filter(a.f, lambda d: sqrt((d.x-e.o[1].x)*(d.x-e.o[1].x) + (d.y-e.o[1].y)*(d.y-e.o[1].y)) < 2e0)) > 0 THEN
            struct_pack(o := list_append(a.o, list_transform([list_min(list_transform(a.f, lambda d: struct_pack(d := sqrt((d.x-e.o[1].x)*(d.x-e.o[1].x) + (d.y-e.o[1].y)*(d.y-e.o[1].y)), k := d.k, x := d.x, y := d.y, w := d.w, """ + _BOX.format("d.") + """)))],
                lambda m: struct_pack(ff := e.o[1].ff, fd := e.o[1].fd, l := f.frame, x := m.x, y := m.y, n := e.o[1].n + 1, """ + _HIT + """))[1]),
              f := list_filter(a.f, lambda d: d.k <> list_min(list_transform(a.f, lambda d: struct_pack(d := sqrt((d.x-e.o[1].x)*(d.x-e.o[1].x) + (d.y-e.o[1].y)*(d.y-e.o[1].y)), k := d.k))).k))
          ELSE struct_pack(o := list_append(a.o, e.o[1]), f := a.f) END) AS acc
        FROM trk t JOIN fr f ON f.run = t.run AND f.i = t.i + 1)""",
    "lastf": "SELECT run, max(frame) + 1 AS last FROM detections GROUP BY run",
    "tr": "SELECT t.run, t.c.ff AS first_frame, t.c.fd AS first_det, t.c.n AS hits, t.c.l + 16 <= l.last AS archived, t.c.l + 16 AS gone, t.c.sw AS w, " + ", ".join(f"t.c.{n} AS {n}" for n in _PARTS) + " FROM (SELECT run, unnest(st) AS c FROM trk) t JOIN lastf l ON l.run = t.run WHERE t.c.n >= 4",
}


@query("track_static", "WITH RECURSIVE " + cte(f"""SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY archived, CASE WHEN archived THEN gone ELSE -1 END, first_frame, first_det) - 1 AS BIGINT) AS ord,
   first_frame, first_det, CAST(hits AS BIGINT) AS hits, archived, {q('w')} AS w, {', '.join(f'{q(n)} AS {c}' for n, c in zip(_PARTS, Gp.BOX))} FROM tr""", "detections", extra=_TRK)[5:])
def track_static(spark, sf):
    return rounded(tracks(spark, sf), "run", "ord", "first_frame", "first_det", "hits", "archived", w="w", **{c: c for c in Gp.BOX})


def _first_fit(items: str, radius: str, extra: tuple) -> dict:
    """First-fit as a recursion over the rows of every run; ``extra`` are further summed columns."""
    cur = ", ".join(["bx := d.bx", "by_ := d.by_", "w := d.w", *[f"{c} := d.{c}" for c in extra], "mf := d.mf", "lc := d.lc", "fo := d.ord"])
    add = ", ".join([*[f"{c} := c.{c} + d.{c}" for c in ("bx", "by_", "w", *extra)], "mf := least(c.mf, d.mf)", "lc := d.lc", "fo := c.fo"])
    gap = "sqrt((n.bx/n.w - c.bx/c.w)*(n.bx/n.w - c.bx/c.w) + (n.by_/n.w - c.by_/c.w)*(n.by_/n.w - c.by_/c.w))"
    return {
        f"{items}_w(run, ord, st) USING KEY (run)": f"""SELECT d.run, d.ord, [struct_pack({cur})] FROM {items} d WHERE d.ord = 0
          UNION ALL SELECT d.run, d.ord, CASE WHEN coalesce(d.hit, 0) = 0 THEN list_append(d.st, struct_pack({cur}))
            ELSE list_transform(d.st, lambda c, i: CASE WHEN i = d.hit THEN struct_pack({add}) ELSE c END) END
          FROM (SELECT n.*, k.st, list_position(list_transform(k.st, lambda c: {gap} < {radius}), true) AS hit FROM {items}_w k JOIN {items} n ON n.run = k.run AND n.ord = k.ord + 1) d""",
        f"{items}_c": f"SELECT run, unnest(st, recursive := true) FROM {items}_w",
    }


# tracklets: what one site shows in a block of ten frames
_TLT = """SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY b, obj) - 1 AS BIGINT) AS ord, bx, by_, w, hits, mf, 0e0 AS lc FROM (
   SELECT run, obj, frame // 10 AS b, sum(x*score) AS bx, sum(y*score) AS by_, sum(score) AS w, count(*) AS hits, min(frame) AS mf FROM detections GROUP BY run, obj, frame // 10)"""
_CT = {"tl": _TLT, **_first_fit("tl", "1.8e0", ("hits",))}
_MC = {**_CT, "ml": "SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY fo) - 1 AS BIGINT) AS ord, bx, by_, w, hits, mf, lc, fo AS old FROM tl_c", **_first_fit("ml", "2.5e0", ("hits",))}


def tracklets(spark, sf):
    s = F.col("score")
    sums = {"bx": "x", "by": "y", "bz": "z", "bl": "len", "bw": "wid", "bh": "hgt", "byaw": "yaw"}
    t = derived(spark, sf, "detections").groupBy("run", "obj", F.expr("frame div 10").alias("b")).agg(
        *[F.sum(F.col(c) * s).alias(n) for n, c in sums.items()], F.sum(s).alias("w"), F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("yaw") < 0.785).alias("n_par"), F.count_if(F.col("yaw") >= 0.785).alias("n_perp"), F.min("frame").alias("first_frame"))
    return dense_number(t, ["run"], ["b", "obj"], "ord")


@query("cluster_tracks", "WITH RECURSIVE " + cte(f"SELECT run, fo AS first_ord, mf AS first_frame, CAST(hits AS BIGINT) AS hits, {q('bx', 5)} AS bx, {q('by_', 5)} AS by, {q('w')} AS w FROM tl_c", "detections", extra=_CT)[5:])
def cluster_tracks(spark, sf):
    c = Gp.cluster_tracks(tracklets(spark, sf))
    return c.select("run", "first_ord", "first_frame", "hits", r("bx", 5).alias("bx"), r("by", 5).alias("by"), r("w").alias("w"))


@query("merge_clusters", "WITH RECURSIVE " + cte(f"SELECT c.run, o.old AS first_ord, c.mf AS first_frame, CAST(c.hits AS BIGINT) AS hits, {q('c.bx', 5)} AS bx, {q('c.by_', 5)} AS by, {q('c.w')} AS w FROM ml_c c JOIN ml o ON o.run = c.run AND o.ord = c.fo", "detections", extra=_MC)[5:])
def merge_clusters(spark, sf):
    c = Gp.merge_clusters(Gp.cluster_tracks(tracklets(spark, sf)))
    return c.select("run", "first_ord", "first_frame", "hits", r("bx", 5).alias("bx"), r("by", 5).alias("by"), r("w").alias("w"))


_CDT = {
    "dd": """SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY frame, det_idx) - 1 AS BIGINT) AS ord, x*score AS bx, y*score AS by_, score AS w, 1 AS cnt,
      sin(yaw)*score AS ys, 0 AS mf, score AS lc FROM detections WHERE score >= 0.28e0 AND label = 0 AND z <= 50""",
    **_first_fit("dd", "2e0", ("cnt", "ys")),
}


@query("cluster_detections", "WITH RECURSIVE " + cte(f"SELECT run, fo AS first_ord, CAST(cnt AS BIGINT) AS count, {q('bx', 5)} AS bx, {q('by_', 5)} AS by, {q('w')} AS w, {q('ys', 5)} AS yaw_sin, {q('lc')} AS last_conf FROM dd_c", "detections", extra=_CDT)[5:])
def cluster_detections(spark, sf):
    c = Gp.cluster_detections(camera_detections(spark, sf))
    return c.select("run", "first_ord", "count", r("bx", 5).alias("bx"), r("by", 5).alias("by"), r("w").alias("w"), r("yaw_sin", 5).alias("yaw_sin"), r("last_conf").alias("last_conf"))


_SUMS = """SELECT run, obj AS first_ord, sum(x*score) AS bx, sum(y*score) AS by_, sum(len*score) AS bl, sum(z*score) AS bz, sum(wid*score) AS bw, sum(hgt*score) AS bh, sum(yaw*score) AS byaw, sum(score) AS w, count(*) AS n,
  min(frame) AS first_frame, sum(sin(yaw)*score) AS ys, sum(cos(yaw)*score) AS yc FROM detections GROUP BY run, obj"""
_FIN = {
    **_FITT, "sums": _SUMS,
    "cars_": """SELECT 'camera' AS sensor, run, first_ord, first_frame, bx/w + 692900e0 AS x, by_/w + 5338950e0 AS y, bz/w + 550e0 AS z, bl/w AS length, bw/w AS width, bh/w AS height, byaw/w AS yaw, n, w/n AS conf FROM sums
      UNION ALL SELECT 'lidar', run, first_ord, 0, bx/w + 692900e0, by_/w + 5338950e0, bz/w + 550e0, bl/w, bw/w, bh/w, atan2(ys, yc), n, w/n FROM sums WHERE n >= 3""",
    "nn_": """SELECT c.sensor, c.run, c.first_ord, min(struct_pack(d2 := (c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y), idx := f.idx)) AS m
      FROM cars_ c JOIN fit f ON f.bag = c.run GROUP BY c.sensor, c.run, c.first_ord""",
    "fin": """SELECT c.*, CASE WHEN f.tx*(c.y-f.y) - f.ty*(c.x-f.x) > 0 THEN 'left' ELSE 'right' END AS side,
      abs(((c.yaw + pi()) - 2*pi()*floor((c.yaw + pi())/(2*pi())) - pi()) - atan2(f.ty, f.tx)) AS d,
      row_number() OVER (PARTITION BY c.sensor, c.run ORDER BY c.first_frame, c.first_ord) AS id
      FROM cars_ c JOIN nn_ n ON n.sensor = c.sensor AND n.run = c.run AND n.first_ord = c.first_ord JOIN fit f ON f.bag = c.run AND f.idx = n.m.idx""",
}


@query("finalise_cars", cte(f"""SELECT sensor, run, CAST(id AS BIGINT) AS id, {q('x', 6)} AS x, {q('y', 6)} AS y, {q('z', 6)} AS z, {q('length', 4)} AS length, {q('width', 4)} AS width, {q('height', 4)} AS height, {q('yaw', 9)} AS yaw, n AS count, {q('conf', 9)} AS conf, side,
   CASE WHEN least(d, 2*pi() - d) < pi()/4 OR least(d, 2*pi() - d) > 3*pi()/4 THEN 'parallel' ELSE 'perpendicular' END AS orient FROM fin""", "odom", "detections", extra=_FIN))
def finalise_cars(spark, sf):
    s = F.col("score")
    sums = derived(spark, sf, "detections").groupBy("run", F.col("obj").alias("first_ord")).agg(
        F.sum(F.col("x") * s).alias("bx"), F.sum(F.col("y") * s).alias("by"), F.sum(F.col("z") * s).alias("bz"),
        F.sum(F.col("len") * s).alias("bl"), F.sum(F.col("wid") * s).alias("bw"), F.sum(F.col("hgt") * s).alias("bh"),
        F.sum(F.col("yaw") * s).alias("byaw"), F.sum(s).alias("w"), F.count(F.lit(1)).alias("count"),
        F.min("frame").alias("first_frame"), F.sum(F.sin("yaw") * s).alias("yaw_sin"), F.sum(F.cos("yaw") * s).alias("yaw_cos"),
    ).withColumn("hits", F.col("count")).withColumn("last_conf", F.col("w") / F.col("count"))
    path = fitted(spark, sf).withColumnRenamed("bag", "run")
    origin = (692900.0, 5338950.0, 550.0)
    out = None
    for sensor in ("camera", "lidar"):
        cars = D.finalise_cars(sums, path, sensor, origin).select(
            F.lit(sensor).alias("sensor"), "run", "id", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"), r("length", 4).alias("length"), r("width", 4).alias("width"), r("height", 4).alias("height"), r("yaw", 9).alias("yaw"), "count",
            r("conf", 9).alias("conf"), "side", "orient")
        out = cars if out is None else out.unionByName(cars)
    return out


@query("yaw_vote", cte("""SELECT run, obj, count(*) FILTER (WHERE yaw < 0.785e0) AS parallel, count(*) FILTER (WHERE yaw >= 0.785e0) AS perpendicular FROM detections GROUP BY run, obj""", "detections"))
def yaw_vote(spark, sf):
    d = derived(spark, sf, "detections").withColumn("orient", F.when(F.col("yaw") < 0.785, "parallel").otherwise("perpendicular"))
    v = Gp.yaw_vote(d, ["run", "obj"])
    return v.select("run", "obj", *[F.coalesce(F.col("votes")[c], F.lit(0)).alias(c) for c in ("parallel", "perpendicular")])


@query("label_counts", cte("""SELECT orient, side, CAST(NULL AS VARCHAR) AS pair_side, count(*) AS n FROM cars GROUP BY GROUPING SETS ((orient), (side))
   UNION ALL SELECT orient, NULL, side, count(*) FROM cars GROUP BY orient, side""", "cars"))
def label_counts(spark, sf):
    from wheeltrace.operators.scene import label_counts as counts

    out = counts(derived(spark, sf, "cars"), "side", "orient")
    pair = F.col("kind") == "pair"
    return out.select("orient", F.when(~pair, F.col("side")).alias("side"), F.when(pair, F.col("side")).alias("pair_side"), "n")


# --- clouds -----------------------------------------------------------------------------------
_Z = "tax*10e0 + (det_idx % 7)*0.01e0 - 2e0"


@query("ground_level", cte(f"SELECT run, frame, {q('g')} AS ground, {q('CASE WHEN abs(-1.73e0 - g) > 0.2e0 THEN -1.73e0 - g ELSE 0e0 END')} AS shift FROM (SELECT run, frame, quantile_cont({_Z}, 0.05) AS g FROM detections GROUP BY run, frame)", "detections"))
def ground_level(spark, sf):
    pts = derived(spark, sf, "detections").select("run", "frame", F.expr(_Z.replace("e0", "d")).alias("z"))
    return rounded(D.ground_shift(pts, ["run", "frame"]), "run", "frame", ground="ground", shift="shift")


@query("voxel_downsample", cte(f"""SELECT run, floor((x - 0.013e0)/0.1e0) AS vx, floor((y - 0.013e0)/0.1e0) AS vy, floor((tax - 0.013e0)/0.1e0) AS vz, {q('avg(x)', 5)} AS x, {q('avg(y)', 5)} AS y, {q('avg(tax)', 5)} AS z,
   {q('avg(score)', 5)} AS score, count(*) AS n FROM detections GROUP BY 1, 2, 3, 4""", "detections"))
def voxel_downsample(spark, sf):
    pts = derived(spark, sf, "detections").select("run", "x", "y", F.col("tax").alias("z"), "score")
    v = D.voxel_downsample(pts, ["run"], extra=("score",), origin=(0.013,) * 3)
    return v.select("run", *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "vz")], *[r(c, 5).alias(c) for c in ("x", "y", "z", "score")], "n")


@query("merge_clouds", cte(f"""SELECT run, count(*) AS n, {q('sum(x)', 3)} AS sx FROM (SELECT run, x FROM detections WHERE label = 0 UNION ALL SELECT run, x + 1 FROM detections WHERE label = 1) GROUP BY run""", "detections"))
def merge_clouds(spark, sf):
    d = derived(spark, sf, "detections")
    both = D.merge_clouds(d.where("label = 0").select("run", "x"), d.where("label = 1").select("run", (F.col("x") + 1).alias("x")))
    return both.groupBy("run").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 3).alias("sx"))
