"""Queries: path algebra and drive scoring."""

from pyspark.sql import functions as F

from wheeltrace.operators import frechet as fr
from wheeltrace.operators import paths as P
from wheeltrace.operators import score as S
from wheeltrace.operators.ordered import attach, neighbours
from wheeltrace.plans.derived import cte, derived
from wheeltrace.plans.registry import q, query, r, rounded
from wheeltrace.session import materialize

_MEMO: dict = {}

# --- DuckDB text of the shared steps ----------------------------------------------------------
_W = "(PARTITION BY run ORDER BY seq)"
ARC = {
    "step": f"SELECT *, coalesce(sqrt((x - lag(x) OVER {_W})*(x - lag(x) OVER {_W}) + (y - lag(y) OVER {_W})*(y - lag(y) OVER {_W})), 0e0) AS ds FROM runs",
    "arc": f"SELECT *, sum(ds) OVER {_W} AS s FROM step",
}
REF = {
    **ARC,
    "best": "SELECT run, max(s) AS len FROM arc WHERE kind = 'real' GROUP BY run ORDER BY len DESC, run LIMIT 1",
    "cnt": "SELECT run, len, greatest(CAST(floor(len/0.5e0) AS BIGINT) + 1, 2) AS n FROM best",
    "stat": "SELECT run, idx, CASE WHEN idx = n - 1 THEN len ELSE idx*(len/(n - 1)) END AS s FROM (SELECT run, len, n, unnest(range(n)) AS idx FROM cnt)",
    "path": """SELECT t.idx, t.s, CASE WHEN b.s IS NULL THEN a.x ELSE a.x + (t.s - a.s)/(b.s - a.s)*(b.x - a.x) END AS x,
      CASE WHEN b.s IS NULL THEN a.y ELSE a.y + (t.s - a.s)/(b.s - a.s)*(b.y - a.y) END AS y
      FROM stat t ASOF LEFT JOIN arc a ON a.run = t.run AND t.s >= a.s ASOF LEFT JOIN arc b ON b.run = t.run AND t.s < b.s""",
    "ref": """SELECT *, coalesce(lead(x) OVER (ORDER BY idx) - x, x - lag(x) OVER (ORDER BY idx)) AS tx,
      coalesce(lead(y) OVER (ORDER BY idx) - y, y - lag(y) OVER (ORDER BY idx)) AS ty FROM path""",
}
PROJ = {
    **REF,
    "near": """SELECT r.run, r.seq, min(struct_pack(d2 := (r.x - p.x)*(r.x - p.x) + (r.y - p.y)*(r.y - p.y), idx := p.idx)) AS m
      FROM runs r, path p GROUP BY r.run, r.seq""",
    "proj": f"""SELECT r.run, r.kind, r.seq, r.x, r.y, r.steer, p.idx, sqrt(n.m.d2) AS dist, p.s,
      max(p.s) OVER (PARTITION BY r.run ORDER BY r.seq) AS progress,
      CASE WHEN sqrt(p.tx*p.tx + p.ty*p.ty) > 1e-9 THEN (p.tx*(r.y - p.y) - p.ty*(r.x - p.x))/sqrt(p.tx*p.tx + p.ty*p.ty)
        ELSE sqrt(n.m.d2) END AS offset_m
      FROM runs r JOIN near n ON n.run = r.run AND n.seq = r.seq JOIN ref p ON p.idx = n.m.idx""",
    "ends": "SELECT run, kind, arg_min(progress, seq) AS p0, arg_max(progress, seq) AS p1 FROM proj GROUP BY run, kind",
    "seg": "SELECT max(p0) AS a, min(p1) AS b FROM ends WHERE kind = 'real'",
}
LAT = {
    **PROJ,
    "clean": "SELECT * FROM (SELECT *, lag(progress) OVER (PARTITION BY run ORDER BY seq) AS pp FROM proj) WHERE progress - coalesce(pp, -1e0) > 0",
    "span": "SELECT run, kind, min(progress) AS lo, max(progress) AS hi FROM clean GROUP BY run, kind",
    "sta": "SELECT k AS station, a + k*0.5e0 AS at FROM (SELECT a, b, unnest(range(CAST(ceil((b - a)/0.5e0) AS BIGINT))) AS k FROM seg)",
    "lat": """SELECT w.run, w.kind, w.station, w.at, CASE WHEN d.progress IS NULL THEN c.offset_m ELSE
        c.offset_m + (w.at - c.progress)/(d.progress - c.progress)*(d.offset_m - c.offset_m) END AS offset_m
      FROM (SELECT s.run, s.kind, t.station, t.at FROM span s JOIN sta t ON t.at BETWEEN s.lo AND s.hi) w
      ASOF LEFT JOIN clean c ON c.run = w.run AND w.at >= c.progress ASOF LEFT JOIN clean d ON d.run = w.run AND w.at < d.progress""",
    "cor": "SELECT station, min(offset_m) AS lo, max(offset_m) AS hi FROM lat WHERE kind = 'real' GROUP BY station",
}


def segment_parts(spark, sf):
    """(path, projected runs, segment), computed once per session and folder like a stored table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        runs = derived(spark, sf, "runs")
        path, real, seg = S.scenario_segment(runs.where("kind = 'real'"))
        sim = P.project_runs(runs.where("kind = 'sim'"), path)
        _MEMO[key] = (path, materialize(real.unionByName(sim), "projected"), seg)
    return _MEMO[key]


@query("arc_length", cte(f"SELECT run, seq, {q('s', 5)} AS s FROM arc", "runs", extra=ARC))
def arc_length(spark, sf):
    return rounded(P.arc_length(derived(spark, sf, "runs"), ["run"], "seq"), "run", "seq", s="s", digits=5)


@query("longest_run", cte(f"SELECT run, {q('len', 5)} AS length FROM best", "runs", extra=REF))
def longest_run(spark, sf):
    arcs = P.arc_length(derived(spark, sf, "runs").where("kind = 'real'"), ["run"], "seq")
    return rounded(S.longest_run(arcs), "run", length="length", digits=5)


@query("resample_path", cte(f"SELECT idx, {q('x', 5)} AS x, {q('y', 5)} AS y, {q('s', 5)} AS s FROM path", "runs", extra=REF))
def resample_path(spark, sf):
    arcs = materialize(P.arc_length(derived(spark, sf, "runs").where("kind = 'real'"), ["run"], "seq"), "arcs")
    ref = arcs.join(S.longest_run(arcs).select("run"), "run", "left_semi")
    return rounded(P.resample_path(ref, ["run"], "seq"), "idx", x="x", y="y", s="s", digits=5)


@query("nearest_path_point", cte(f"SELECT run, seq, idx, {q('dist', 5)} AS dist, {q('s', 5)} AS s FROM proj", "runs", extra=PROJ))
def nearest_path_point(spark, sf):
    path, _, _ = segment_parts(spark, sf)
    pts = derived(spark, sf, "runs").withColumn("k", F.lit(0))
    out = P.nearest_path_point(pts, path.withColumn("k", F.lit(0)), ["k"], ["run", "seq"])
    return rounded(out, "run", "seq", "idx", dist="dist", s="s", digits=5)


@query("monotone_progress", cte(f"SELECT run, seq, {q('progress', 5)} AS progress FROM proj", "runs", extra=PROJ))
def monotone_progress(spark, sf):
    proj = segment_parts(spark, sf)[1].drop("progress")
    return rounded(P.monotone_progress(proj, ["run"], "seq"), "run", "seq", progress="progress", digits=5)


@query("strict_increase", cte("SELECT run, seq FROM clean", "runs", extra=LAT))
def strict_increase(spark, sf):
    return P.strict_increase(segment_parts(spark, sf)[1], ["run"], "seq").select("run", "seq")


@query("signed_lateral", cte(f"SELECT run, seq, {q('offset_m', 5)} AS offset_m FROM proj", "runs", extra=PROJ))
def signed_lateral(spark, sf):
    path = segment_parts(spark, sf)[0]
    return rounded(P.project_runs(derived(spark, sf, "runs"), path), "run", "seq", offset_m="offset_m", digits=5)


@query("scenario_segment", cte(f"""SELECT CAST(best.run AS BIGINT) AS reference_run, {q('len', 4)} AS reference_length_m, {q('a', 4)} AS start_m,
   {q('b', 4)} AS end_m, {q('b - a', 4)} AS length_m FROM seg, best""", "runs", extra=PROJ))
def scenario_segment(spark, sf):
    path, proj, seg = segment_parts(spark, sf)
    ends = proj.where("kind = 'real'").groupBy("run").agg(F.min_by("progress", "seq").alias("a"), F.max_by("progress", "seq").alias("b"))
    arcs = S.longest_run(P.arc_length(derived(spark, sf, "runs").where("kind = 'real'"), ["run"], "seq"))
    out = attach(arcs, ends.agg(F.max("a").alias("a"), F.min("b").alias("b")), [])
    return out.select(F.col("run").alias("reference_run"), r("length", 4).alias("reference_length_m"), r("a", 4).alias("start_m"),
                      r("b", 4).alias("end_m"), r(F.col("b") - F.col("a"), 4).alias("length_m"))


@query("trim_to_segment", cte("SELECT run, seq FROM proj, seg WHERE progress BETWEEN a AND b", "runs", extra=PROJ))
def trim_to_segment(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    return S.trim_to_segment(proj, seg).select("run", "seq")


_COMP = {**PROJ, "comp": "SELECT run, kind, greatest(0e0, least(1e0, (p1 - a)/(b - a))) AS c, p0 > a + 5 AS late FROM ends, seg"}


@query("completion", cte(f"SELECT run, {q('c')} AS completion, c >= 0.95e0 AS success, late AS starts_late FROM comp", "runs", extra=_COMP))
def completion(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    return S.completion(proj, seg).select("run", r("completion").alias("completion"), "success", "starts_late")


@query("resample_lateral", cte(f"SELECT run, station, {q('offset_m', 5)} AS offset_m FROM lat", "runs", extra=LAT))
def resample_lateral(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    out = P.resample_lateral(proj, seg["start_m"], seg["end_m"])
    return rounded(out, "run", "station", offset_m="offset_m", digits=5)


def _stations(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    return materialize(P.resample_lateral(proj, seg["start_m"], seg["end_m"]), "stations")


@query("corridor", cte(f"SELECT station, {q('lo', 5)} AS lo, {q('hi', 5)} AS hi FROM cor", "runs", extra=LAT))
def corridor(spark, sf):
    st = _stations(spark, sf).where(F.col("run") < 3)
    return rounded(S.corridor(st), "station", lo="lo", hi="hi", digits=5)


_VIO = {
    **LAT,
    "ev": """SELECT l.run, l.offset_m < c.lo OR l.offset_m > c.hi AS outside,
      CASE WHEN l.offset_m < c.lo THEN c.lo - l.offset_m WHEN l.offset_m > c.hi THEN l.offset_m - c.hi ELSE 0e0 END AS ex
      FROM lat l JOIN cor c ON c.station = l.station WHERE l.kind = 'sim'""",
    "vio": """SELECT run, count(*) AS n, avg(CASE WHEN outside THEN 1e0 ELSE 0e0 END) AS rate, avg(ex) AS me,
      coalesce(avg(CASE WHEN outside THEN ex END), 0e0) AS meo FROM ev GROUP BY run HAVING count(*) >= 10""",
}


def _violations(spark, sf):
    st = _stations(spark, sf)
    return S.corridor_violation(st.where(F.col("run") >= 3), S.corridor(st.where(F.col("run") < 3)))


@query("corridor_violation", cte(f"SELECT run, n AS stations, {q('rate')} AS rate, {q('me', 5)} AS mean_excess, {q('meo', 5)} AS mean_excess_out FROM vio", "runs", extra=_VIO))
def corridor_violation(spark, sf):
    v = _violations(spark, sf)
    return v.select("run", "stations", r("rate").alias("rate"), r("mean_excess", 5).alias("mean_excess"), r("mean_excess_out", 5).alias("mean_excess_out"))


def _frechet(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    inside = S.trim_to_segment(proj, seg)
    sim, real = inside.where("kind = 'sim'"), inside.where("kind = 'real'")
    return fr.frechet_discrete(sim, real), sim.groupBy(F.col("run").alias("p")).agg(F.count(F.lit(1)).alias("n"))


# anti-diagonals of the distance matrix as lists, one step per diagonal, all pairs at once
_INF = "CAST('inf' AS DOUBLE)"
_D2 = "(t.px[i+1] - t.qx[w.d+2-i])*(t.px[i+1] - t.qx[w.d+2-i]) + (t.py[i+1] - t.qy[w.d+2-i])*(t.py[i+1] - t.qy[w.d+2-i])"
_FR = {
    **PROJ,
    "cv": "SELECT p.run, p.kind, list(p.x ORDER BY p.seq) AS xs, list(p.y ORDER BY p.seq) AS ys, count(*) AS n FROM proj p, seg WHERE p.progress BETWEEN seg.a AND seg.b GROUP BY p.run, p.kind",
    "pq": "SELECT a.run AS p, b.run AS q, a.xs AS px, a.ys AS py, b.xs AS qx, b.ys AS qy, a.n, b.n AS m FROM cv a JOIN cv b ON a.kind = 'sim' AND b.kind = 'real'",
    "dp(p, q, d, l1, l2) USING KEY (p, q)": f"""SELECT p, q, CAST(0 AS BIGINT), list_concat([{_INF}, (px[1]-qx[1])*(px[1]-qx[1]) + (py[1]-qy[1])*(py[1]-qy[1])], list_transform(range(n-1), lambda i: {_INF})),
      list_transform(range(n+1), lambda i: {_INF}) FROM pq UNION ALL
      SELECT w.p, w.q, w.d + 1, list_prepend({_INF}, list_transform(range(t.n), lambda i: CASE WHEN w.d + 1 - i >= 0 AND w.d + 1 - i < t.m
        THEN greatest({_D2}, least(w.l1[i+1], w.l1[i+2], w.l2[i+1])) ELSE {_INF} END)), w.l1
      FROM dp w JOIN pq t ON t.p = w.p AND t.q = w.q WHERE w.d + 1 <= t.n + t.m - 2""",
    "fd": "SELECT d.p, d.q, sqrt(d.l1[len(d.l1)]) AS f, t.n FROM dp d JOIN pq t ON t.p = d.p AND t.q = d.q",
}


@query("frechet_discrete", "WITH RECURSIVE " + cte(f"SELECT p, q, {q('f')} AS frechet FROM fd", "runs", extra=_FR)[5:])
def frechet_discrete(spark, sf):
    return rounded(_frechet(spark, sf)[0], "p", "q", frechet="frechet")


@query("frechet_min", "WITH RECURSIVE " + cte(f"SELECT p, {q('min(f)')} AS min_frechet, arg_min(q, f) AS vs FROM fd WHERE n >= 10 GROUP BY p", "runs", extra=_FR)[5:])
def frechet_min(spark, sf):
    pairs, n = _frechet(spark, sf)
    return rounded(fr.frechet_min(pairs, n), "p", "vs", min_frechet="min_frechet")


_JIT = {
    **PROJ,
    "ins": "SELECT p.run, p.kind, p.seq, p.steer, p.seq*0.15e0 + 0.05e0*p.steer AS t, row_number() OVER (PARTITION BY p.run ORDER BY p.seq) - 1 AS k FROM proj p, seg WHERE progress BETWEEN a AND b",
    "simr": "SELECT run, (steer - lag(steer) OVER (PARTITION BY run ORDER BY k))/0.1e0 AS rate FROM ins WHERE kind = 'sim' AND k % 3 = 0",
    "realg": "SELECT run, steer - lag(steer) OVER (PARTITION BY run ORDER BY k) AS dv, t - lag(t) OVER (PARTITION BY run ORDER BY k) AS dt FROM ins WHERE kind = 'real'",
    "rate": "SELECT run, rate FROM simr WHERE rate IS NOT NULL UNION ALL SELECT run, dv/dt FROM realg WHERE dt > 0.05e0 AND dt <= 0.25e0",
    "jit": "SELECT run, count(*) AS gaps, stddev_pop(rate) AS j, max(abs(rate)) AS mj FROM rate GROUP BY run",
}


def _jitter(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    sim = S.steering_jitter(proj.where("kind = 'sim'"), seg, dt=0.1)
    timed = proj.where("kind = 'real'").withColumn("t", F.expr("seq*0.15d + 0.05d*steer"))
    return sim.unionByName(S.steering_jitter(timed, seg, time="t"))


@query("steering_jitter", cte(f"SELECT run, gaps, {q('j')} AS jitter, {q('mj')} AS max_jitter FROM jit", "runs", extra=_JIT))
def steering_jitter(spark, sf):
    j = _jitter(spark, sf)
    return j.select("run", "gaps", r("jitter").alias("jitter"), r("max_jitter").alias("max_jitter"))


@query("rate_of_change", cte(f"""SELECT bag, seq, {q('dv/dt')} AS rate FROM (SELECT bag, seq,
   value - lag(value) OVER w AS dv, (t_us - lag(t_us) OVER w)/1e9 AS dt FROM series WINDOW w AS (PARTITION BY bag ORDER BY seq)) WHERE dt > 0.5e0 AND dt <= 60e0""", "series"))
def rate_of_change(spark, sf):
    out = S.rate_of_change(derived(spark, sf, "series"), ["bag"], "seq", "value", "t_us", min_gap=0.5, max_gap=60.0, ticks=1e9)
    return rounded(out, "bag", "seq", rate="rate")


_METHOD = "CASE WHEN run % 2 = 0 THEN 'gs' ELSE 'sim' END"


@query("method_averages", "WITH RECURSIVE " + cte(f"""SELECT a.method, a.runs, round(a.fr, 3) AS avg_frechet_m, round(a.o, 1) AS avg_out_pct, round(a.me, 3) AS avg_mean_excess_m,
   b.runs AS jitter_runs, round(b.j, 6) AS avg_jitter, round(b.mj, 6) AS max_jitter FROM
   (SELECT {_METHOD} AS method, count(*) AS runs, avg(f) AS fr, avg(rate*100) AS o, avg(me) AS me FROM vio JOIN (SELECT p, min(f) AS f FROM fd WHERE n >= 10 GROUP BY p) ON p = run GROUP BY 1) a
   JOIN (SELECT {_METHOD} AS method, count(*) AS runs, avg(j) AS j, max(mj) AS mj FROM jit WHERE run >= 3 GROUP BY 1) b ON a.method = b.method""",
   "runs", extra={**_VIO, **_JIT, **_FR})[5:])
def method_averages(spark, sf):
    method = F.expr(_METHOD)
    pairs, n = _frechet(spark, sf)
    closest = fr.frechet_min(pairs, n).select(F.col("p").alias("run"), F.col("min_frechet").alias("frechet"))
    qual = _violations(spark, sf).join(closest, "run").select(method.alias("method"), "frechet", (F.col("rate") * 100).alias("out_pct"), "mean_excess")
    jit = _jitter(spark, sf).where(F.col("run") >= 3).select(method.alias("method"), "jitter", "max_jitter")
    return S.method_averages(qual, jit)


_CM_SRC = "CASE WHEN run < 3 THEN 'real' ELSE 'sim' END AS method, CASE run % 3 WHEN 0 THEN 'sunny' WHEN 1 THEN 'cloudy' ELSE 'snowy' END AS condition"


@query("condition_matrix", cte("SELECT method, " + ", ".join(
    f"""coalesce(max(CASE WHEN condition = '{c}' THEN f END), '---') AS {c}_fail,
        coalesce(max(CASE WHEN condition = '{c}' THEN t END), '---') AS {c}_completion""" for c in S.CONDITIONS) + " FROM g GROUP BY method",
    "runs", extra={**_COMP,
        "all_": f"""SELECT {_CM_SRC}, c*100 AS pct FROM comp UNION ALL
          SELECT {_CM_SRC}, c*50 AS pct FROM comp WHERE run % 3 < 2""",
        "g": """SELECT method, condition, concat(CAST(sum(CASE WHEN pct < 95 THEN 1 ELSE 0 END) AS VARCHAR), '/', CAST(count(*) AS VARCHAR)) AS f,
          format('{:.0f} - {:.0f} - {:.0f}', avg(pct), max(pct), min(pct)) AS t FROM all_ GROUP BY method, condition"""}))
def condition_matrix(spark, sf):
    _, proj, seg = segment_parts(spark, sf)
    comp = S.completion(proj, seg)
    full = comp.selectExpr(*_split_two(_CM_SRC), "completion*100 as completion_pct")
    cut = comp.where("run % 3 < 2").selectExpr(*_split_two(_CM_SRC), "completion*50 as completion_pct")
    return S.condition_matrix(full.unionByName(cut))


def _split_two(text):
    a, b = text.split(", CASE", 1)
    return [a, "CASE" + b]


# --- odometry paths ---------------------------------------------------------------------------
_O = "(PARTITION BY bag ORDER BY idx)"
_STILL = "CASE WHEN idx % 9 = 1 THEN lag({0}) OVER (PARTITION BY bag ORDER BY idx) ELSE {0} END"
_OPATH = {"od": f"SELECT bag, idx, {_STILL.format('tx')} AS x, {_STILL.format('ty')} AS y FROM odom"}


def _odom_xy(spark, sf):
    """Odometry positions in which every ninth row stands still."""
    o = neighbours(derived(spark, sf, "odom").select("bag", "idx", "t_us", "tx", "ty"), ["bag"], "idx",
                   {"px": ("tx", -1), "py": ("ty", -1)})
    return o.selectExpr("bag", "idx", "t_us", "case when idx % 9 = 1 then px else tx end as x",
                        "case when idx % 9 = 1 then py else ty end as y")


@query("dedupe_consecutive", cte(f"""SELECT bag, idx FROM (SELECT *, lag(x) OVER {_O} AS px, lag(y) OVER {_O} AS py FROM od)
   WHERE px IS NULL OR sqrt((x-px)*(x-px) + (y-py)*(y-py)) > 1e-4""", "odom", extra=_OPATH))
def dedupe_consecutive(spark, sf):
    return P.dedupe_consecutive(_odom_xy(spark, sf), ["bag"], "idx").select("bag", "idx")


_FIN = "CASE WHEN frame_id % 7 = 0 THEN NULL WHEN frame_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE frame_id*0.5e0 END"


@query("finite_rows", cte(f"SELECT bag, frame_id FROM (SELECT bag, frame_id, {_FIN} AS x FROM camera) WHERE x IS NOT NULL AND NOT isnan(x)", "camera"))
def finite_rows(spark, sf):
    return P.finite_rows(derived(spark, sf, "camera").selectExpr("bag", "frame_id", f"{_FIN} as x"), "x").select("bag", "frame_id")


_TAN = {
    "t0": f"""SELECT *, lag(x) OVER {_O} AS px, lag(y) OVER {_O} AS py, lead(x) OVER {_O} AS nx, lead(y) OVER {_O} AS ny FROM od""",
    "t1": """SELECT *, (coalesce(nx, x) - coalesce(px, x))/CASE WHEN nx IS NOT NULL AND px IS NOT NULL THEN 2e0 ELSE 1e0 END AS gx,
      (coalesce(ny, y) - coalesce(py, y))/CASE WHEN nx IS NOT NULL AND px IS NOT NULL THEN 2e0 ELSE 1e0 END AS gy FROM t0""",
    "t2": "SELECT *, CASE WHEN sqrt(gx*gx + gy*gy) < 1e-8 THEN 1e0 ELSE sqrt(gx*gx + gy*gy) END AS nn FROM t1",
}


@query("path_tangent", cte(f"SELECT bag, idx, {q('gx/nn')} AS tx, {q('gy/nn')} AS ty FROM t2", "odom", extra={**_OPATH, **_TAN}))
def path_tangent(spark, sf):
    return rounded(P.path_tangent(_odom_xy(spark, sf), ["bag"], "idx"), "bag", "idx", tx="tx", ty="ty")


_KIN = {
    "k0": f"""SELECT bag, idx, x, y, max(idx) OVER (PARTITION BY bag) AS last FROM od""",
    "k1": """SELECT a.bag, a.idx, CASE WHEN a.idx = a.last THEN a.x - c.x ELSE b.x - a.x END AS dx,
      CASE WHEN a.idx = a.last THEN a.y - c.y ELSE b.y - a.y END AS dy FROM k0 a
      JOIN k0 b ON b.bag = a.bag AND b.idx = least(a.idx + 5, a.last) JOIN k0 c ON c.bag = a.bag AND c.idx = greatest(a.idx - 5, 0)""",
    "k2": """SELECT *, CASE WHEN NOT (abs(dx) < 0.001e0 AND abs(dy) < 0.001e0) THEN degrees(atan2(dy, dx)) - 360*floor(degrees(atan2(dy, dx))/360e0) END AS h FROM k1""",
    "k3": f"SELECT bag, idx, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY bag ORDER BY idx ROWS UNBOUNDED PRECEDING), 0e0) AS yaw FROM k2",
}


@query("kinematic_yaw", cte(f"SELECT bag, idx, {q('yaw', 5)} AS yaw_deg FROM k3", "odom", extra={**_OPATH, **_KIN}))
def kinematic_yaw(spark, sf):
    return rounded(P.kinematic_yaw(_odom_xy(spark, sf), ["bag"], "idx"), "bag", "idx", yaw_deg="yaw_deg", digits=5)


@query("yaw_agreement", cte(f"""SELECT bag, {q('avg(d)', 5)} AS mean_diff, {q('stddev_pop(d)', 5)} AS std_diff, {q('max(abs(d))', 5)} AS max_diff
   FROM (SELECT k.bag, (degrees(o.yaw) - k.yaw + 180) - 360*floor((degrees(o.yaw) - k.yaw + 180)/360e0) - 180 AS d
   FROM k3 k JOIN odom o ON o.bag = k.bag AND o.idx = k.idx) GROUP BY bag""", "odom", extra={**_OPATH, **_KIN}))
def yaw_agreement(spark, sf):
    from wheeltrace.operators.align import yaw_agreement as agree

    kin = P.kinematic_yaw(_odom_xy(spark, sf), ["bag"], "idx")
    both = kin.join(derived(spark, sf, "odom").select("bag", "idx", F.degrees("yaw").alias("odom_deg")), ["bag", "idx"])
    return rounded(agree(both, ["bag"], "odom_deg", "yaw_deg"), "bag", mean_diff="mean_diff", std_diff="std_diff", max_diff="max_diff", digits=5)


_FIT = {
    **_OPATH,
    "f1": f"SELECT *, lag(x) OVER {_O} AS px, lag(y) OVER {_O} AS py FROM od",
    "f2": f"SELECT bag, x, y, row_number() OVER {_O} - 1 AS p, count(*) OVER (PARTITION BY bag) AS n FROM f1 WHERE px IS NULL OR sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 1e-4",
    "f3": "SELECT bag, x, y, p FROM f2 WHERE p % greatest(1, n // 500) = 0",
    "f4": "SELECT *, lag(x) OVER (PARTITION BY bag ORDER BY p) AS px, lag(y) OVER (PARTITION BY bag ORDER BY p) AS py FROM f3",
    "f5": "SELECT bag, x, y, p, coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 0e0) AS ds FROM f4 WHERE px IS NULL OR sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 1e-4",
    "f6": "SELECT *, sum(ds) OVER (PARTITION BY bag ORDER BY p) AS s FROM f5",
    "f7": "SELECT bag, i AS idx, CASE WHEN i = 1999 THEN len ELSE i*(len/1999) END AS s FROM (SELECT bag, max(s) AS len, unnest(range(2000)) AS i FROM f6 GROUP BY bag)",
    "f8": """SELECT t.bag, t.idx, t.s, CASE WHEN b.s IS NULL THEN a.x ELSE a.x + (t.s-a.s)/(b.s-a.s)*(b.x-a.x) END AS x,
      CASE WHEN b.s IS NULL THEN a.y ELSE a.y + (t.s-a.s)/(b.s-a.s)*(b.y-a.y) END AS y FROM f7 t
      ASOF LEFT JOIN f6 a ON a.bag = t.bag AND t.s >= a.s ASOF LEFT JOIN f6 b ON b.bag = t.bag AND t.s < b.s""",
}
_FW = "(PARTITION BY bag ORDER BY idx)"
_FITT = {
    **_FIT,
    "g0": f"SELECT *, lag(x) OVER {_FW} AS px, lag(y) OVER {_FW} AS py, lead(x) OVER {_FW} AS nx, lead(y) OVER {_FW} AS ny FROM f8",
    "g1": """SELECT *, (coalesce(nx, x) - coalesce(px, x))/CASE WHEN nx IS NOT NULL AND px IS NOT NULL THEN 2e0 ELSE 1e0 END AS gx,
      (coalesce(ny, y) - coalesce(py, y))/CASE WHEN nx IS NOT NULL AND px IS NOT NULL THEN 2e0 ELSE 1e0 END AS gy FROM g0""",
    "fit": "SELECT bag, idx, s, x, y, gx/sqrt(gx*gx+gy*gy) AS tx, gy/sqrt(gx*gx+gy*gy) AS ty FROM g1",
}


def fitted(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "fit")
    if key not in _MEMO:
        _MEMO[key] = materialize(P.fit_path(_odom_xy(spark, sf), ["bag"], ["t_us", "idx"]), "fit")
    return _MEMO[key]


@query("fit_path", cte(f"SELECT bag, idx, {q('x', 4)} AS x, {q('y', 4)} AS y, {q('tx', 4)} AS tx, {q('ty', 4)} AS ty FROM fit", "odom", extra=_FITT))
def fit_path(spark, sf):
    return rounded(P.fit_path(_odom_xy(spark, sf), ["bag"], ["t_us", "idx"]), "bag", "idx", x="x", y="y", tx="tx", ty="ty", digits=4)


# parked cars spread beside the driven paths
_PARK = """SELECT cluster_id, cluster_id % 8 AS bag, 692900e0 + (cluster_id % 211)*0.9e0 AS x,
  5339000e0 + 20*sin((cluster_id % 211)*0.03e0) + ((cluster_id % 13) - 6)*1.7e0 AS y, (cluster_id % 17)*0.37e0 AS yaw FROM cars"""
_SIDE = {
    **_FITT,
    "park": _PARK,
    "pn": """SELECT c.cluster_id, min(struct_pack(d2 := (c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y), idx := f.idx)) AS m
      FROM park c JOIN fit f ON f.bag = c.bag GROUP BY c.cluster_id""",
    "sided": """SELECT c.cluster_id, f.idx AS path_idx, CASE WHEN f.tx*(c.y-f.y) - f.ty*(c.x-f.x) > 0 THEN 'left' ELSE 'right' END AS side,
      abs(((c.yaw + pi()) - 2*pi()*floor((c.yaw + pi())/(2*pi())) - pi()) - atan2(f.ty, f.tx)) AS d
      FROM park c JOIN pn ON pn.cluster_id = c.cluster_id JOIN fit f ON f.bag = c.bag AND f.idx = pn.m.idx""",
    "orient": "SELECT *, CASE WHEN d > pi() THEN 2*pi() - d ELSE d END AS w FROM sided",
}


def _parked(spark, sf):
    derived(spark, sf, "cars").createOrReplaceTempView("_wt_cars")
    return spark.sql(_PARK.replace("FROM cars", "FROM _wt_cars"))


@query("side_of_path", cte("SELECT cluster_id, path_idx, side FROM sided", "odom", "cars", extra=_SIDE))
def side_of_path(spark, sf):
    out = P.side_and_orientation(_parked(spark, sf), fitted(spark, sf), ["bag"], ["cluster_id"], yaw=None)
    return out.select("cluster_id", "path_idx", "side")


@query("orientation_to_path", cte("""SELECT cluster_id, CASE WHEN w < pi()/4 OR w > 3*pi()/4 THEN 'parallel' ELSE 'perpendicular' END AS orient FROM orient""",
                                  "odom", "cars", extra=_SIDE))
def orientation_to_path(spark, sf):
    out = P.side_and_orientation(_parked(spark, sf), fitted(spark, sf), ["bag"], ["cluster_id"])
    return out.select("cluster_id", "orient")


# --- polylines: one line per nation, vertices ordered by supplier -------------------------------
_LINES = {
    "vert": "SELECT nation, edge_id, CAST(row_number() OVER (PARTITION BY nation ORDER BY edge_id) - 1 AS BIGINT) AS pos, (lon0 - 11.58e0)*74000 + edge_id*3e0 AS x, (lat0 - 48.17e0)*111320 AS y FROM edges",
    "v1": "SELECT *, coalesce(sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)), 0e0) AS ds, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vert WINDOW w AS (PARTITION BY nation ORDER BY pos)",
    "v2": "SELECT *, sum(ds) OVER (PARTITION BY nation ORDER BY pos) AS d0 FROM v1",
    "segs": "SELECT nation, pos AS seg, x AS x0, y AS y0, x1, y1, d0, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS len FROM v2 WHERE x1 IS NOT NULL",
}


def _segments(spark, sf):
    from wheeltrace.operators.ordered import dense_number

    v = dense_number(derived(spark, sf, "edges").select("nation", "edge_id", "lon0", "lat0"), ["nation"], ["edge_id"])
    v = v.selectExpr("nation", "pos", "(lon0 - 11.58d)*74000 + edge_id*3d as x", "(lat0 - 48.17d)*111320 as y")
    return P.line_segments(materialize(v, "lines"), ["nation"], "pos")


@query("line_substring", cte(f"""SELECT nation, seg, {q('x0 + ua*(x1-x0)', 4)} AS ax, {q('y0 + ua*(y1-y0)', 4)} AS ay, {q('x0 + ub*(x1-x0)', 4)} AS bx, {q('y0 + ub*(y1-y0)', 4)} AS by
   FROM (SELECT *, (greatest(d0, 20e0) - d0)/len AS ua, (least(d0 + len, 400e0) - d0)/len AS ub FROM segs WHERE d0 + len >= 20e0 AND d0 <= 400e0 AND len > 0)""",
   "edges", extra=_LINES))
def line_substring(spark, sf):
    out = P.line_substring(_segments(spark, sf), F.lit(400.0), F.lit(20.0))
    return rounded(out, "nation", "seg", ax="ax", ay="ay", bx="bx", by="by", digits=4)


_PP = {
    **_LINES,
    "pts": "SELECT cluster_id, cluster_id % 25 AS nation, (lon - 11.58e0)*74000 + 31e0 AS px, (lat - 48.17e0)*111320 + 7e0 AS py FROM cars",
    "pj": """SELECT cluster_id, px, py, s.*, greatest(0e0, least(1e0, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/(len*len))) AS u FROM pts p JOIN segs s ON s.nation = p.nation""",
    "pk": """SELECT cluster_id, min(struct_pack(d2 := (px-x0-u*(x1-x0))*(px-x0-u*(x1-x0))+(py-y0-u*(y1-y0))*(py-y0-u*(y1-y0)), seg := seg, along := d0 + u*len)) AS m FROM pj GROUP BY cluster_id""",
}


@query("polyline_project", cte(f"SELECT cluster_id, {q('sqrt(m.d2)', 4)} AS dist, {q('m.along', 4)} AS along FROM pk", "edges", "cars", extra=_PP))
def polyline_project(spark, sf):
    pts = derived(spark, sf, "cars").selectExpr("cluster_id", "cluster_id % 25 as nation", "(lon - 11.58d)*74000 + 31d as px", "(lat - 48.17d)*111320 + 7d as py")
    out = P.polyline_project(pts, _segments(spark, sf), ["nation"], ["cluster_id"])
    return rounded(out.where("seg is not null"), "cluster_id", dist="dist", along="along", digits=4)
