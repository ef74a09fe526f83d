"""Queries: alignment fits, matching, splits, set operations."""

from pyspark.sql import functions as F

from wheeltrace.operators import align as Al
from wheeltrace.plans.derived import cte, derived
from wheeltrace.plans.q_time import OFFSET, tm_fwd, tm_inv
from wheeltrace.plans.registry import q, query, r, rounded

_E = lambda i: f"CAST(list_extract(c2w, {i}) AS DOUBLE)"
_PAIR = f"""SELECT frame_id, split, {_E(4)} AS sx, {_E(8)} AS sy, 0.5e0*(0.8e0*{_E(4)} - 0.6e0*{_E(8)}) + 3e0 + 0.01e0*{_E(1)} AS dx,
  0.5e0*(0.6e0*{_E(4)} + 0.8e0*{_E(8)}) - 2e0 + 0.01e0*{_E(2)} AS dy, {_E(3)}*4e0 AS syaw, -{_E(3)}*4e0 + 0.7e0 + 0.05e0*{_E(1)} AS dyaw,
  {_E(5)}*0.1e0 AS pitch, {_E(6)}*0.1e0 AS roll, {_E(12)} AS z FROM cameras"""


def _pairs(spark, sf):
    derived(spark, sf, "cameras").createOrReplaceTempView("_wt_cameras")
    return spark.sql(_PAIR.replace("list_extract", "element_at").replace("FROM cameras", "FROM _wt_cameras"))


def _wrap(e):
    return f"(({e}) + pi() - 2*pi()*floor((({e}) + pi())/(2*pi())) - pi())"


_YAW = {
    "pr": _PAIR,
    "sg": f"SELECT split, s AS yaw_sign, {_wrap('dyaw - s*syaw')} AS d FROM pr, (SELECT unnest([1, -1]) AS s)",
    "cm": "SELECT split, yaw_sign, atan2(avg(sin(d)), avg(cos(d))) AS m FROM sg GROUP BY split, yaw_sign",
    "rs": f"SELECT g.split, g.yaw_sign, c.m, stddev_pop({_wrap('g.d - c.m')}) AS sd FROM sg g JOIN cm c ON c.split = g.split AND c.yaw_sign = g.yaw_sign GROUP BY g.split, g.yaw_sign, c.m",
    "ya": "SELECT split, arg_min(yaw_sign, sd) AS yaw_sign, arg_min(m, sd) AS yaw_offset, min(sd) AS residual_std FROM rs GROUP BY split",
    "fit0": """SELECT split, count(*) AS n, avg(sx) AS msx, avg(sy) AS msy, avg(dx) AS mdx, avg(dy) AS mdy, var_pop(sx) + var_pop(sy) AS v,
      covar_pop(dy, sx) - covar_pop(dx, sy) AS qq, covar_pop(dx, sx) + covar_pop(dy, sy) AS pp FROM pr GROUP BY split""",
    "fit": """SELECT *, atan2(qq, pp) AS theta, sqrt(qq*qq + pp*pp)/v AS scale, mdx - (pp/v*msx - qq/v*msy) AS t_x, mdy - (qq/v*msx + pp/v*msy) AS t_y FROM fit0""",
}


@query("circular_mean", cte(f"SELECT split, {q('atan2(avg(sin(a)), avg(cos(a)))')} AS mean, {q('max(sd)')} AS residual_std FROM (SELECT p.split, p.syaw AS a, s.sd FROM pr p JOIN sd s ON s.split = p.split) GROUP BY split", "cameras", extra={
    "pr": _PAIR, "mm": "SELECT split, atan2(avg(sin(syaw)), avg(cos(syaw))) AS m FROM pr GROUP BY split",
    "sd": f"SELECT p.split, stddev_pop({_wrap('p.syaw - m.m')}) AS sd FROM pr p JOIN mm m ON m.split = p.split GROUP BY p.split"}))
def circular_mean(spark, sf):
    return rounded(Al.circular_mean(_pairs(spark, sf), ["split"], "syaw"), "split", mean="mean", residual_std="residual_std")


@query("yaw_alignment", cte(f"SELECT split, yaw_sign, {q('yaw_offset')} AS yaw_offset, {q('residual_std')} AS residual_std FROM ya", "cameras", extra=_YAW))
def yaw_alignment(spark, sf):
    out = Al.yaw_alignment(_pairs(spark, sf), ["split"], "syaw", "dyaw")
    return rounded(out, "split", "yaw_sign", yaw_offset="yaw_offset", residual_std="residual_std")


@query("similarity_fit", cte(f"SELECT split, n, {q('scale')} AS scale, {q('theta')} AS theta, {q('t_x')} AS t_x, {q('t_y')} AS t_y, {q('rms', 4)} AS rms FROM fit JOIN (SELECT p.split, sqrt(avg((dx-(pp/v*sx-qq/v*sy+t_x))*(dx-(pp/v*sx-qq/v*sy+t_x)) + (dy-(qq/v*sx+pp/v*sy+t_y))*(dy-(qq/v*sx+pp/v*sy+t_y)))) AS rms FROM pr p JOIN fit f ON f.split = p.split GROUP BY p.split) USING (split)", "cameras", extra=_YAW))
def similarity_fit(spark, sf):
    out = Al.similarity_fit(_pairs(spark, sf), ["split"], ("sx", "sy"), ("dx", "dy"))
    return rounded(out, "split", "n", scale="scale", theta="theta", t_x="t_x", t_y="t_y").join(out.select("split", r("rms", 4).alias("rms")), "split")


# every bag has its own scale, rotation (about z, then about x) and shift
_TURN = ["cos(az)", "-sin(az)*cos(ax)", "sin(az)*sin(ax)", "sin(az)", "cos(az)*cos(ax)", "-cos(az)*sin(ax)", "0e0", "sin(ax)", "cos(ax)"]
_FIT3 = "0.3e0 + 0.7e0*bag AS az, 0.2e0*bag - 0.5e0 AS ax, 0.5e0 + 0.25e0*bag AS sc, 10e0*bag AS sx, -3e0 AS sy, 1e0 + bag AS sz"


@query("similarity_fit_3d", cte(f"SELECT bag, n, {q('sc')} AS scale, {', '.join(f'{q(e)} AS r{i}' for i, e in enumerate(_TURN))}, {q('sx', 5)} AS t_x, {q('sy', 5)} AS t_y, {q('sz', 5)} AS t_z FROM (SELECT bag, count(*) AS n, {_FIT3} FROM odom GROUP BY bag)", "odom"))
def similarity_fit_3d(spark, sf):
    o = derived(spark, sf, "odom").selectExpr("bag", "tx - 692900e0 as x", "ty - 5339000e0 as y", "5e0*sin(0.1e0*idx) as z", *_FIT3.split(", "))
    e = [f"({t})" for t in _TURN]
    moved = [f"sc*({e[3 * i]}*x + {e[3 * i + 1]}*y + {e[3 * i + 2]}*z) + s{a} as d{a}" for i, a in enumerate("xyz")]
    fit = Al.similarity_fit_3d(o.selectExpr("bag", "x", "y", "z", *moved), ["bag"], "xyz", ("dx", "dy", "dz"))
    return fit.select("bag", "n", r("scale").alias("scale"), *[r(F.col("rotation")[i]).alias(f"r{i}") for i in range(9)],
                      *[r(F.col("translation")[i], 5).alias(f"t_{a}") for i, a in enumerate("xyz")])


_REP = {
    **_YAW,
    "er": f"""SELECT p.split, p.pitch, p.roll, p.z, sqrt((dx-(pp/v*sx-qq/v*sy+t_x))*(dx-(pp/v*sx-qq/v*sy+t_x)) + (dy-(qq/v*sx+pp/v*sy+t_y))*(dy-(qq/v*sx+pp/v*sy+t_y))) AS e,
      degrees({_wrap('p.dyaw - (y.yaw_sign*p.syaw + y.yaw_offset)')}) AS ye FROM pr p JOIN fit f ON f.split = p.split JOIN ya y ON y.split = p.split""",
}


@query("alignment_report", cte(f"""SELECT split, count(*) AS n, {q('avg(e)')} AS pos_mean, {q('max(e)')} AS pos_max, {q('sqrt(avg(e*e))')} AS pos_rms, {q('avg(abs(ye))')} AS yaw_mean,
   {q('max(abs(ye))')} AS yaw_max, {q('stddev_pop(ye)')} AS yaw_std, {q('stddev_pop(pitch)')} AS pitch_std, {q('stddev_pop(roll)')} AS roll_std, {q('avg(z)')} AS z_mean,
   {q('median(pitch)')} AS pitch_median, {q('median(roll)')} AS roll_median FROM er GROUP BY split""", "cameras", extra=_REP))
def alignment_report(spark, sf):
    p = _pairs(spark, sf)
    fit = Al.similarity_fit(p, ["split"], ("sx", "sy"), ("dx", "dy")).drop("n", "rms")
    ya = Al.yaw_alignment(p, ["split"], "syaw", "dyaw")
    out = Al.alignment_report(p, fit, ya, ["split"], ("sx", "sy"), ("dx", "dy"), "syaw", "dyaw", "pitch", "roll", "z")
    return out.select("split", "n", *[r(c).alias(c) for c in out.columns if c not in ("split", "n")])


@query("axis_drift", cte(f"SELECT b.bag, {q('degrees(a.ax)', 5)} AS start_deg, {q('degrees(b.ax - a.ax)', 5)} AS drift_deg, abs(degrees(b.ax - a.ax)) >= 0.1e0 AS warn FROM ax a JOIN ax b ON a.bag = b.bag AND a.idx = 0 AND b.idx > 0", "odom", extra={
    "two": "SELECT o.bag, o.idx, o.tx, o.ty FROM odom o JOIN (SELECT bag, count(*) // 2 AS mid FROM odom GROUP BY bag) m ON m.bag = o.bag AND (o.idx = 0 OR o.idx = m.mid)",
    "h": "SELECT bag, idx, tx, ty, 0 AS k FROM two UNION ALL SELECT bag, idx, tx + 1, ty, 1 FROM two",
    **tm_inv("h", "tx", "ty", "9e0", 0.9996, "500000e0", "lat", "lon"), "hh": "SELECT bag, idx, k, lat, lon FROM h_f",
    **tm_fwd("hh", "lat", "lon", "0e0", 1.0, "0e0", "px", "py"),
    "ax": "SELECT a.bag, a.idx, atan2(-(b.py - a.py), b.px - a.px) AS ax FROM hh_f a JOIN hh_f b ON a.bag = b.bag AND a.idx = b.idx AND a.k = 0 AND b.k = 1"}))
def axis_drift(spark, sf):
    out = Al.axis_drift(derived(spark, sf, "odom").select("bag", "idx", "tx", "ty"), ["bag"], "idx", "tx", "ty", OFFSET)
    return out.select("bag", r("start_deg", 5).alias("start_deg"), r("drift_deg", 5).alias("drift_deg"), "warn")


@query("extent", cte("SELECT split, " + ", ".join(f"{q(f'min({c}) - 1.5e0')} AS {c}_min, {q(f'max({c}) + 1.5e0')} AS {c}_max, {q(f'max({c}) - min({c})')} AS {c}_range, {q(f'avg({c})')} AS {c}_mean" for c in ("sx", "sy", "z")) + " FROM pr GROUP BY split", "cameras", extra={"pr": _PAIR}))
def extent(spark, sf):
    out = Al.extent(_pairs(spark, sf), ["split"], ["sx", "sy", "z"], buffer=1.5)
    return out.select("split", *[r(c).alias(c) for c in out.columns if c != "split"])


@query("frame_match", cte("SELECT c.bag, c.frame_id, c.t_us AS cam_us, l.t_us AS lidar_us FROM camera c JOIN lidar l ON l.bag = c.bag AND l.frame_id = c.frame_id", "camera", "lidar"))
def frame_match(spark, sf):
    cam = derived(spark, sf, "camera").withColumnRenamed("t_us", "cam_us")
    lid = derived(spark, sf, "lidar").withColumnRenamed("t_us", "lidar_us")
    return Al.frame_match(cam, lid, ["bag", "frame_id"])[0].select("bag", "frame_id", "cam_us", "lidar_us")


_SPL = {
    "nf": "SELECT bag, max(frame_id) + 1 AS n FROM camera GROUP BY bag",
    "rg": """SELECT bag, i + 1 AS split, i*(n//4) AS a, CASE WHEN i < 3 THEN least((i+1)*(n//4) + 20 - 1, n - 1) ELSE n - 1 END AS b FROM (SELECT bag, n, unnest(range(4)) AS i FROM nf)""",
}


@query("split_assign", cte("SELECT c.bag, c.frame_id, CAST(r.split AS INT) AS split FROM camera c JOIN rg r ON r.bag = c.bag AND c.frame_id BETWEEN r.a AND r.b", "camera", extra=_SPL))
def split_assign(spark, sf):
    return Al.split_assign(derived(spark, sf, "camera"), ["bag"], "frame_id", 4, 20).select("bag", "frame_id", "split")


@query("split_overlap", cte("""SELECT p.bag, CAST(p.split AS INT) AS split, p.lo, p.hi, (SELECT count(*) FROM camera c WHERE c.bag = p.bag AND c.frame_id % 2 = 0 AND c.frame_id BETWEEN p.lo AND p.hi) AS frames
   FROM (SELECT a.bag, a.split, greatest(a.a, b.a) AS lo, least(a.b, b.b) AS hi FROM rg a JOIN rg b ON b.bag = a.bag AND b.split = a.split + 1) p WHERE p.hi >= p.lo""", "camera", extra=_SPL))
def split_overlap(spark, sf):
    cam = derived(spark, sf, "camera")
    return Al.split_overlap(cam, cam.where("frame_id % 2 = 0"), ["bag"], "frame_id", 4, 20).select("bag", "split", "lo", "hi", "frames")


_BEST = {
    "spn": "SELECT bag, max(frame_id) + 1 AS n FROM camera GROUP BY bag",
    "wk": "SELECT c.bag, c.frame_id AS pos, (c.frame_id*7) % s.n AS f FROM camera c JOIN spn s ON s.bag = c.bag",
    "rng": "SELECT bag, i AS k, i*(n//4) AS lo, (i+1)*(n//4) + 10 AS hi FROM (SELECT bag, n, unnest(range(4)) AS i FROM spn)",
    # where a step goes when its current split does not cover the frame, and which splits cover it
    "fb": """SELECT w.bag, w.pos, w.f, coalesce(arg_max(r.k, r.hi*10 - r.k) FILTER (WHERE w.f BETWEEN r.lo AND r.hi),
      arg_min(r.k, greatest(r.lo - w.f, w.f - r.hi, 0)*10 + r.k)) AS b, list(r.k) FILTER (WHERE w.f BETWEEN r.lo AND r.hi) AS c
      FROM wk w JOIN rng r ON r.bag = w.bag GROUP BY w.bag, w.pos, w.f""",
    "walk": """SELECT bag, pos, f, CASE WHEN list_contains(coalesce(c, []), 0) THEN 0 ELSE b END AS cur FROM fb WHERE pos = 0
      UNION ALL SELECT n.bag, n.pos, n.f, CASE WHEN list_contains(coalesce(n.c, []), w.cur) THEN w.cur ELSE n.b END FROM walk w JOIN fb n ON n.bag = w.bag AND n.pos = w.pos + 1""",
}


@query("best_split", "WITH RECURSIVE " + cte("SELECT bag, pos, f AS frame, cur AS split_idx FROM walk", "camera", extra=_BEST)[5:])
def best_split(spark, sf):
    cam = derived(spark, sf, "camera")
    spans = cam.groupBy("bag").agg((F.max("frame_id") + 1).alias("n"))
    ranges = spans.selectExpr(
        "bag", "inline(transform(sequence(0, 3), i -> struct(i as split, i * (n div 4) as min_frame, (i + 1) * (n div 4) + 10 as max_frame)))")
    # frames are visited back and forth, so that keeping the current split matters
    walk = cam.join(spans, "bag").selectExpr("bag", "frame_id as pos", "(frame_id * 7) % n as frame")
    return Al.best_split(walk, ranges, ["bag"], "pos", "frame")


_CEN = {
    "sp": "SELECT bag, k AS split, k*60e0 - 20e0 AS cx, 4e0 AS cy, 0.5e0*cos(k*0.2e0) AS a, 0.5e0*sin(k*0.2e0) AS b, 1e0 AS tx_, -1e0 AS ty_ FROM (SELECT DISTINCT bag FROM odom), (SELECT unnest(range(4)) AS k)",
    "ds": "SELECT o.bag, o.idx, s.split, sqrt((a*x-b*y+tx_-cx)*(a*x-b*y+tx_-cx)+(b*x+a*y+ty_-cy)*(b*x+a*y+ty_-cy)) AS d FROM (SELECT bag, idx, tx - 692900e0 AS x, ty - 5339000e0 AS y FROM odom) o JOIN sp s ON s.bag = o.bag",
}


@query("nearest_centroid", cte(f"SELECT bag, idx, CAST(arg_min(split, d) AS BIGINT) AS split, {q('min(d)')} AS centroid_dist FROM ds GROUP BY bag, idx", "odom", extra=_CEN))
def nearest_centroid(spark, sf):
    o = derived(spark, sf, "odom").selectExpr("bag", "idx", "tx - 692900d as x", "ty - 5339000d as y")
    sp = o.select("bag").distinct().selectExpr("bag", "explode(sequence(0L, 3L)) as split").selectExpr(
        "bag", "split", "split*60d - 20d as cx", "4d as cy", "0.5d*cos(split*0.2d) as a", "0.5d*sin(split*0.2d) as b", "1d as tx", "-1d as ty")
    return rounded(Al.nearest_centroid(o, sp, ["bag"], "x", "y"), "bag", "idx", "split", centroid_dist="centroid_dist")


_COV = {
    "pr": _PAIR,
    "pt": "SELECT run, seq, ((seq*13 + run) % 400)*0.02e0 - 4e0 AS px, ((seq*29 + run) % 300)*0.02e0 - 3e0 AS py FROM runs",
    "cn": "SELECT p.run, p.seq, min(struct_pack(d2 := (p.px-c.sx)*(p.px-c.sx)+(p.py-c.sy)*(p.py-c.sy), id := c.frame_id)) AS m FROM pt p, pr c GROUP BY p.run, p.seq",
}


@query("coverage_distance", cte(f"SELECT n.run, n.seq, n.m.id AS cam, {q('sqrt(n.m.d2)')} AS dist, {q('c.z')} AS lookup_z FROM cn n JOIN pr c ON c.frame_id = n.m.id", "runs", "cameras", extra=_COV))
def coverage_distance(spark, sf):
    pts = derived(spark, sf, "runs").selectExpr("run", "seq", "((seq*13 + run) % 400)*0.02d - 4d as px", "((seq*29 + run) % 300)*0.02d - 3d as py")
    cams = _pairs(spark, sf).selectExpr("frame_id as cam", "sx", "sy", "z")
    out = Al.coverage_distance(pts, cams, [], ["run", "seq"], ("px", "py"), ("sx", "sy"), "z", "cam")
    return out.select("run", "seq", "cam", r("dist").alias("dist"), r("lookup_z").alias("lookup_z"))


_IDS = [lambda s, d: derived(s, d, "camera").select("bag", "frame_id"), lambda s, d: derived(s, d, "lidar").select("bag", (F.col("frame_id") + 50).alias("frame_id"))]


@query("frame_union", cte("SELECT bag, frame_id FROM camera UNION SELECT bag, frame_id + 50 FROM lidar", "camera", "lidar"))
def frame_union(spark, sf):
    return Al.frame_union(*[f(spark, sf) for f in _IDS])


@query("frame_intersect", cte("SELECT bag, frame_id FROM camera INTERSECT SELECT bag, frame_id + 50 FROM lidar", "camera", "lidar"))
def frame_intersect(spark, sf):
    return Al.frame_intersect(*[f(spark, sf) for f in _IDS])


@query("missing_frames", cte("SELECT bag, frame_id FROM camera EXCEPT SELECT bag, frame_id + 50 FROM lidar", "camera", "lidar"))
def missing_frames(spark, sf):
    return Al.missing_frames(*[f(spark, sf) for f in _IDS], ["bag", "frame_id"])
