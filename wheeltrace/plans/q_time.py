"""Queries: time synchronisation, angles, poses and map projections."""

from pyspark.sql import functions as F

from wheeltrace.functions import angles as A
from wheeltrace.functions import geodesy as G
from wheeltrace.operators import timesync as ts
from wheeltrace.operators.ordered import stride_sample
from wheeltrace.plans.derived import MICROS, cte, derived, table
from wheeltrace.plans.registry import q, query, r, rounded

OFFSET = (-880000.0, -5390000.0)


def _asof(left: str, tie: str) -> str:
    """prev p / next n of every row of ``left`` (c); ``tie`` says which side owns an equal time."""
    lo, hi = (">=", "<") if tie == "before" else (">", "<=")
    return (
        f"{left} c ASOF LEFT JOIN odom p ON c.bag = p.bag AND c.t_us {lo} p.t_us"
        f" ASOF LEFT JOIN odom n ON c.bag = n.bag AND c.t_us {hi} n.t_us"
    )


def _lerp(f: str) -> str:
    return (
        f"CASE WHEN p.t_us IS NULL THEN n.{f} WHEN n.t_us IS NULL OR n.t_us = p.t_us THEN p.{f} ELSE "
        f"p.{f} + (c.t_us - p.t_us) / CAST(n.t_us - p.t_us AS DOUBLE) * (n.{f} - p.{f}) END"
    )


_QUATS = ("qx", "qy", "qz", "qw")
_INTERP_RAW = "SELECT c.bag, c.frame_id, c.t_us, " + ", ".join(
    f"{_lerp(f)} AS {f}" for f in ("tx", "ty", "tz", *_QUATS)
) + f" FROM {_asof('camera', 'before')}"
_INTERP_N = "SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS nn FROM raw"
_YAW = "atan2(2*(qw*qz+qx*qy), 1-2*(qy*qy+qz*qz))"


@query(
    "interp_join",
    cte(
        "SELECT bag, frame_id, t_us, " + ", ".join(f"{q(f)} AS {f}" for f in ("tx", "ty", "tz"))
        + ", " + ", ".join(f"{q(f'{f}/nn', 8)} AS {f}" for f in _QUATS)
        + f", {q('atan2(2*(qw*qz+qx*qy)/(nn*nn), 1-2*(qy*qy+qz*qz)/(nn*nn))', 8)} AS yaw FROM unit",
        "odom", "camera", extra={"raw": _INTERP_RAW, "unit": _INTERP_N},
    ),
)
def interp_join(spark, sf):
    out = ts.interp_join(derived(spark, sf, "camera"), derived(spark, sf, "odom"), pose_tie="idx")
    return out.select(
        "bag", "frame_id", "t_us", *[r(c).alias(c) for c in ("tx", "ty", "tz")],
        *[r(c, 8).alias(c) for c in (*_QUATS, "yaw")],
    )


@query(
    "interp_join_yaw_naive",
    cte(
        "SELECT c.bag, c.frame_id, " + ", ".join(f"{q(_lerp(f))} AS {f}" for f in ("tx", "ty"))
        + f", {q(_lerp('yw'))} AS yaw FROM {_asof('lidar', 'before').replace('odom', 'odomw')}",
        "odom", "lidar",
        extra={"odomw": "SELECT *, yaw_raw - 2*pi()*floor((yaw_raw + pi())/(2*pi())) AS yw FROM odom"},
    ),
)
def interp_join_yaw_naive(spark, sf):
    poses = derived(spark, sf, "odom").withColumn("yaw", A.wrap_rad("yaw_raw"))
    out = ts.interp_join_yaw_naive(derived(spark, sf, "lidar"), poses, pose_tie="idx")
    return rounded(out, "bag", "frame_id", tx="tx", ty="ty", yaw="yaw")


@query(
    "nearest_pose_join",
    cte(
        "SELECT bag, frame_id, CASE WHEN use_prev THEN pt ELSE nt END AS pose_t, CASE WHEN use_prev THEN pi ELSE ni END AS idx FROM w",
        "odom", "lidar",
        extra={
            "w": "SELECT c.bag, c.frame_id, p.t_us AS pt, n.t_us AS nt, p.idx AS pi, n.idx AS ni,"
            " p.t_us IS NOT NULL AND (n.t_us IS NULL OR c.t_us - p.t_us < n.t_us - c.t_us) AS use_prev"
            f" FROM {_asof('lidar', 'after')}"
        },
    ),
)
def nearest_pose_join(spark, sf):
    out = ts.nearest_pose_join(
        derived(spark, sf, "lidar"), derived(spark, sf, "odom"), values=("idx",), pose_tie="idx"
    )
    return out.select("bag", "frame_id", "pose_t", "idx")


_NUMBERED = cte(
    "SELECT bag, event_id, frame_id FROM camera", "camera",
)


@query("number_frames", _NUMBERED)
def number_frames(spark, sf):
    ev = table(spark, sf, "events").where("event_type = 'click'").selectExpr(
        "cast(user_id % 8 as bigint) as bag", "cast(event_id as bigint) as event_id",
        f"{MICROS} as t_us",
    )
    return ts.number_frames(ev).select("bag", "event_id", "frame_id")


@query(
    "previous_link",
    cte("SELECT bag, frame_id, coalesce(lag(t_us) OVER (PARTITION BY bag ORDER BY frame_id), t_us) AS previous FROM camera", "camera"),
)
def previous_link(spark, sf):
    return ts.previous_link(derived(spark, sf, "camera"), ["bag"], "frame_id", "t_us").select("bag", "frame_id", "previous")


@query(
    "first_pose",
    cte(f"SELECT bag, t_us, {q('tx')} AS tx, {q('ty')} AS ty, {q('yaw')} AS yaw FROM odom WHERE idx = 0", "odom"),
)
def first_pose(spark, sf):
    out = ts.first_pose(derived(spark, sf, "odom"), ["bag"], ["idx"], ["t_us", "tx", "ty", "yaw"])
    return rounded(out, "bag", "t_us", tx="tx", ty="ty", yaw="yaw")


@query(
    "top_k_per_group",
    cte("SELECT bag, frame_id, CAST(frame_id + 1 AS BIGINT) AS rank FROM camera WHERE frame_id < 5", "camera"),
)
def top_k_per_group(spark, sf):
    out = ts.top_k_per_group(derived(spark, sf, "camera"), ["bag"], ["frame_id"], 5)
    return out.selectExpr("bag", "frame_id", "cast(rank as bigint) as rank")


@query(
    "stride_sample",
    cte("SELECT bag, t_us FROM camera WHERE frame_id % 5 = 0", "camera"),
)
def stride(spark, sf):
    cam = derived(spark, sf, "camera")
    return stride_sample(cam, ["bag"], ["t_us", "frame_id"], 5).select("bag", "t_us")


@query(
    "topic_summary",
    cte("SELECT bag, topic, 'msgs' || topic AS msgtype, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, min(min(t_us)) OVER (PARTITION BY bag) AS start_us,"
        " max(max(t_us)) OVER (PARTITION BY bag) AS end_us FROM messages GROUP BY bag, topic", "messages"),
)
def topic_summary(spark, sf):
    return ts.topic_summary(derived(spark, sf, "messages").withColumn("msgtype", F.concat(F.lit("msgs"), "topic")))


# --- angles and poses -------------------------------------------------------------------------
@query("quat_to_yaw", cte(f"SELECT bag, idx, {q(_YAW)} AS yaw FROM odom", "odom"))
def quat_to_yaw(spark, sf):
    return rounded(derived(spark, sf, "odom"), "bag", "idx", yaw=A.quat_to_yaw(*_QUATS))


@query(
    "quat_normalize",
    cte("SELECT bag, idx, " + ", ".join(
        f"{q(f'{c}/sqrt(qx*qx+qy*qy+(3*qz)*(3*qz)+qw*qw)')} AS {c}" for c in ("qx", "qy", "qw")) + " FROM odom", "odom"),
)
def quat_normalize(spark, sf):
    odom = derived(spark, sf, "odom")
    n = A.quat_normalize("qx", "qy", F.col("qz") * 3, "qw")
    return rounded(odom, "bag", "idx", qx=n[0], qy=n[1], qw=n[3])


# a rotation about z only, so the check can be written with one angle
@query(
    "pose_apply",
    cte(f"""SELECT bag, idx, {q('cos(yaw)*1.5e0 - sin(yaw)*0.5e0 + tx - 692900e0', 5)} AS x,
      {q('sin(yaw)*1.5e0 + cos(yaw)*0.5e0 + ty - 5339000e0', 5)} AS y, {q('0.25e0 + tz', 5)} AS z FROM odom""", "odom"),
)
def pose_apply(spark, sf):
    trans = (F.col("tx") - 692900.0, F.col("ty") - 5339000.0, F.col("tz"))
    p = A.apply_pose(_QUATS, trans, (F.lit(1.5), F.lit(0.5), F.lit(0.25)))
    return rounded(derived(spark, sf, "odom"), "bag", "idx", x=p[0], y=p[1], z=p[2], digits=5)


@query("wrap_deg", cte(f"SELECT bag, idx, {q('d - 360e0*floor((d + 180e0)/360e0)')} AS deg FROM w", "odom",
                       extra={"w": "SELECT bag, idx, yaw_raw*3e0*180e0/pi() AS d FROM odom"}))
def wrap_deg(spark, sf):
    return rounded(derived(spark, sf, "odom"), "bag", "idx", deg=A.wrap_deg(F.degrees(F.col("yaw_raw") * 3)))


@query("wrap_rad", cte(f"SELECT bag, idx, {q('y - 2*pi()*floor((y + pi())/(2*pi()))')} AS rad FROM w", "odom",
                       extra={"w": "SELECT bag, idx, yaw_raw*3e0 AS y FROM odom"}))
def wrap_rad(spark, sf):
    return rounded(derived(spark, sf, "odom"), "bag", "idx", rad=A.wrap_rad(F.col("yaw_raw") * 3))


@query(
    "heading",
    cte(f"""SELECT bag, idx, CASE WHEN NOT (abs(dx) < 0.001e0 AND abs(dy) < 0.001e0) THEN
      {q('degrees(atan2(dy, dx)) - 360*floor(degrees(atan2(dy, dx))/360e0)')} END AS deg FROM w""", "odom",
        extra={"w": """SELECT bag, idx, CASE WHEN idx % 10 = 0 THEN 0e0 ELSE 0.25e0 END AS dx,
          CASE WHEN idx % 10 = 0 THEN 0e0 ELSE ty - 5339000e0 END AS dy FROM odom"""}),
)
def heading(spark, sf):
    still = F.col("idx") % 10 == 0
    dx = F.when(still, F.lit(0.0)).otherwise(F.lit(0.25))
    dy = F.when(still, F.lit(0.0)).otherwise(F.col("ty") - 5339000.0)
    return rounded(derived(spark, sf, "odom"), "bag", "idx", deg=A.heading(F.lit(0.0), F.lit(0.0), dx, dy))


@query(
    "steer_scale",
    cte(f"""SELECT bag, seq, {q('greatest(least(value*12e0, 9e0), -9e0)')} AS clamped,
      {q('-(value*12e0)/(3*pi())')} AS applied FROM series""", "series"),
)
def steer_scale(spark, sf):
    clamped, applied = A.steer_scale(F.col("value") * 12, invert=True)
    return rounded(derived(spark, sf, "series"), "bag", "seq", clamped=clamped, applied=applied)


@query(
    "ypr_from_c2w",
    cte(f"""SELECT frame_id, {q('CASE WHEN abs(cp) > 1e-6 THEN atan2(-fx/cp, fy/cp) ELSE atan2(m5, m1) END')} AS yaw,
      {q('p')} AS pitch, {q('CASE WHEN abs(cp) > 1e-6 THEN atan2(-m9/cp, m10/cp) ELSE 0e0 END')} AS roll FROM w2""",
        "cameras",
        extra={
            "w": """SELECT frame_id, -CAST(list_extract(c2w, 3) AS DOUBLE) AS fx, -CAST(list_extract(c2w, 7) AS DOUBLE) AS fy,
              asin(greatest(least(-CAST(list_extract(c2w, 11) AS DOUBLE), 1e0), -1e0)) AS p,
              CAST(list_extract(c2w, 5) AS DOUBLE) AS m5, CAST(list_extract(c2w, 1) AS DOUBLE) AS m1,
              CAST(list_extract(c2w, 9) AS DOUBLE) AS m9, CAST(list_extract(c2w, 10) AS DOUBLE) AS m10 FROM cameras""",
            "w2": "SELECT *, cos(p) AS cp FROM w",
        }),
)
def ypr_from_c2w(spark, sf):
    y, p, ro = A.ypr_from_c2w("c2w")
    return rounded(derived(spark, sf, "cameras"), "frame_id", yaw=y, pitch=p, roll=ro)


@query(
    "c2w_from_ypr",
    cte(f"""SELECT bag, idx, {q('cos(yaw)*cos(0.1e0) - sin(yaw)*sin(0.2e0)*sin(0.1e0)')} AS m0,
      {q('cos(yaw)*sin(0.1e0) + sin(yaw)*sin(0.2e0)*cos(0.1e0)')} AS m1, {q('sin(yaw)*cos(0.2e0)')} AS m2,
      {q('tx')} AS m3, {q('cos(0.2e0)*cos(0.1e0)')} AS m9, {q('-sin(0.2e0)')} AS m10 FROM odom""", "odom"),
)
def c2w_from_ypr(spark, sf):
    m = A.c2w_from_ypr("tx", "ty", "tz", "yaw", F.lit(0.2), F.lit(0.1))
    odom = derived(spark, sf, "odom").select("bag", "idx", m.alias("m"))
    return rounded(odom, "bag", "idx", **{f"m{i}": F.col("m")[i] for i in (0, 1, 2, 3, 9, 10)})


SIM = {
    "scale": 0.02, "rotation": [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]],
    "translation": [1.5, -2.5, 0.75], "yaw_alignment": {"yaw_sign": -1, "yaw_offset_rad": 0.4},
}


@query(
    "similarity_apply",
    cte(f"""SELECT bag, idx, {q('0.02e0*(0.8e0*x - 0.6e0*y) + 1.5e0')} AS x, {q('0.02e0*(0.6e0*x + 0.8e0*y) - 2.5e0')} AS y,
      {q('0.02e0*tz + 0.75e0')} AS z, {q('0.4e0 - yaw')} AS yaw, {q('-yaw + atan2(0.6e0, 0.8e0) - pi()/2')} AS yaw_fallback
      FROM (SELECT *, tx - 692900e0 AS x, ty - 5339000e0 AS y FROM odom)""", "odom"),
)
def similarity_apply(spark, sf):
    p = A.similarity_apply(F.col("tx") - 692900.0, F.col("ty") - 5339000.0, "tz", SIM)
    plain = {k: v for k, v in SIM.items() if k != "yaw_alignment"}
    return rounded(derived(spark, sf, "odom"), "bag", "idx", x=p[0], y=p[1], z=p[2],
                   yaw=A.similarity_yaw("yaw", SIM), yaw_fallback=A.similarity_yaw("yaw", plain))


@query(
    "calibration_inverse",
    cte(f"""SELECT bag, idx, {q('692900e0 + cos(-0.05e0)*dx - sin(-0.05e0)*dy - 1.25e0', 5)} AS x,
      {q('5339000e0 + sin(-0.05e0)*dx + cos(-0.05e0)*dy + 0.75e0', 5)} AS y
      FROM (SELECT *, tx - 692900e0 AS dx, ty - 5339000e0 AS dy FROM odom)""", "odom"),
)
def calibration_inverse(spark, sf):
    x, y = A.calibration_inverse("tx", "ty", 1.25, -0.75, 0.05, 692900.0, 5339000.0)
    return rounded(derived(spark, sf, "odom"), "bag", "idx", x=x, y=y, digits=5)


@query(
    "rear_offset",
    cte("""SELECT bag, idx, v.variant, CASE WHEN v.rear = 1 THEN """ + q("tx - cos(a)*(-1.393e0)", 5) + " ELSE " + q("tx", 5) + """ END AS x,
      CASE WHEN v.rear = 1 THEN """ + q("ty - sin(a)*(-1.393e0)", 5) + " ELSE " + q("ty", 5) + """ END AS y FROM
      (SELECT *, unnest([yaw, yaw, yaw_raw, yaw_raw]) AS a, unnest([0, 1, 2, 3]) AS k FROM odom) o
      JOIN (SELECT * FROM (VALUES (0, 'kinematic', 0), (1, 'kinematic_rear', 1), (2, 'odom', 0), (3, 'odom_rear', 1)) t(k, variant, rear)) v ON v.k = o.k""", "odom"),
)
def rear_offset(spark, sf):
    from wheeltrace.operators.paths import pose_variants

    odom = derived(spark, sf, "odom").select(
        "bag", "idx", F.col("tx").alias("x"), F.col("ty").alias("y"),
        F.degrees("yaw").alias("kin"), F.degrees("yaw_raw").alias("odo"))
    out = pose_variants(odom, "x", "y", "kin", "odo", ["bag", "idx"])
    return rounded(out, "bag", "idx", "variant", x="x", y="y", digits=5)


# --- projections: the check evaluates the series term by term ------------------------------------
def tm_fwd(src, lat, lon, lon0, k0, x0, ox, oy, lat0=None):
    """CTE texts for a forward projection of ``src``; the result table is ``<src>_f``."""
    e = repr(G._E)
    ser = lambda a, b: " + ".join(
        f"({c!r})*{a}({2 * j}*xi)*{b}({2 * j}*eta)" for j, c in enumerate(G.ALPHA, 1))
    k = repr(k0 * G.RECTIFYING)
    m0 = "0e0"
    if lat0:
        m0 = "mx"
    steps = {
        f"{src}_a": f"SELECT *, tan(radians({lat})) AS tau, radians({lon} - ({lon0})) AS lam FROM {src}",
        f"{src}_b": f"SELECT *, sinh({e}*atanh({e}*tau/sqrt(1+tau*tau))) AS sig FROM {src}_a",
        f"{src}_c": f"SELECT *, tau*sqrt(1+sig*sig) - sig*sqrt(1+tau*tau) AS tp FROM {src}_b",
        f"{src}_d": f"SELECT *, atan2(tp, cos(lam)) AS xi, asinh(sin(lam)/sqrt(tp*tp + cos(lam)*cos(lam))) AS eta FROM {src}_c",
    }
    last = f"{src}_d"
    if lat0:
        steps[f"{src}_m"] = (
            f"SELECT *, tan(radians({lat0})) AS t0 FROM {src}_d")
        steps[f"{src}_n"] = f"SELECT *, sinh({e}*atanh({e}*t0/sqrt(1+t0*t0))) AS s0 FROM {src}_m"
        steps[f"{src}_o"] = f"SELECT *, atan(t0*sqrt(1+s0*s0) - s0*sqrt(1+t0*t0)) AS z0 FROM {src}_n"
        steps[f"{src}_p"] = (
            f"SELECT *, {k}*(z0 + " + " + ".join(f"({c!r})*sin({2 * j}*z0)" for j, c in enumerate(G.ALPHA, 1))
            + f") AS mx FROM {src}_o")
        last = f"{src}_p"
    steps[f"{src}_f"] = (
        f"SELECT *, {k}*(eta + {ser('cos', 'sinh')}) + {x0} AS {ox}, {k}*(xi + {ser('sin', 'cosh')}) - {m0} AS {oy} FROM {last}")
    return steps


def tm_inv(src, x, y, lon0, k0, x0, olat, olon):
    k = repr(k0 * G.RECTIFYING)
    ser = lambda a, b: " + ".join(
        f"({c!r})*{a}({2 * j}*xi)*{b}({2 * j}*eta)" for j, c in enumerate(G.BETA, 1))
    return {
        f"{src}_a": f"SELECT *, ({y})/{k} AS xi, ({x} - {x0})/{k} AS eta FROM {src}",
        f"{src}_b": f"SELECT *, xi - ({ser('sin', 'cosh')}) AS xp, eta - ({ser('cos', 'sinh')}) AS ep FROM {src}_a",
        f"{src}_c": f"SELECT *, asin(sin(xp)/cosh(ep)) AS chi, atan2(sinh(ep), cos(xp)) AS lam FROM {src}_b",
        f"{src}_f": f"SELECT *, degrees(chi + " + " + ".join(
            f"({c!r})*sin({2 * j}*chi)" for j, c in enumerate(G.DELTA, 1)) + f") AS {olat}, degrees(lam) + {lon0} AS {olon} FROM {src}_c",
    }


_W = tm_inv("u", "tx", "ty", "9e0", 0.9996, "500000e0", "lat", "lon")
_U = {"u": "SELECT bag, idx, yaw, tx, ty FROM odom"}
_P_SRC = {"g": "SELECT bag, idx, yaw, tx, ty, lat, lon FROM u_f"}
_P = tm_fwd("g", "lat", "lon", "0e0", 1.0, "0e0", "px", "py")


@query("utm_to_wgs84", cte(f"SELECT bag, idx, {q('lat', 9)} AS lat, {q('lon', 9)} AS lon FROM u_f", "odom", extra={**_U, **_W}))
def utm_to_wgs84(spark, sf):
    return rounded(G.utm_to_wgs84(derived(spark, sf, "odom"), "tx", "ty"), "bag", "idx", lat="lat", lon="lon", digits=9)


_E = {"e": "SELECT edge_id, lon0, lat0, lon1, lat1 FROM edges"}


@query("wgs84_to_utm", cte(f"SELECT edge_id, {q('ux', 4)} AS x, {q('uy', 4)} AS y FROM e_f", "edges",
                           extra={**_E, **tm_fwd("e", "lat0", "lon0", "9e0", 0.9996, "500000e0", "ux", "uy")}))
def wgs84_to_utm(spark, sf):
    return rounded(G.wgs84_to_utm(derived(spark, sf, "edges"), "lat0", "lon0"), "edge_id", x="utm_x", y="utm_y", digits=4)


@query("wgs84_to_tmerc", cte(f"SELECT edge_id, {q('ux', 4)} AS x, {q('uy', 4)} AS y FROM e_f", "edges",
                             extra={**_E, **tm_fwd("e", "lat0", "lon0", "0e0", 1.0, "0e0", "ux", "uy")}))
def wgs84_to_tmerc(spark, sf):
    return rounded(G.wgs84_to_tmerc(derived(spark, sf, "edges"), "lat0", "lon0"), "edge_id", x="px", y="py", digits=4)


@query("tmerc_to_wgs84", cte(f"SELECT bag, idx, {q('lat', 9)} AS lat, {q('lon', 9)} AS lon FROM u_f", "odom", extra={
    "u": "SELECT bag, idx, tx + 180000e0 AS px, ty + 40000e0 AS py FROM odom",
    **tm_inv("u", "px", "py", "0e0", 1.0, "0e0", "lat", "lon")}))
def tmerc_to_wgs84(spark, sf):
    src = derived(spark, sf, "odom").selectExpr("bag", "idx", "tx + 180000 as px", "ty + 40000 as py")
    return rounded(G.tmerc_to_wgs84(src, "px", "py"), "bag", "idx", lat="lat", lon="lon", digits=9)


@query("wgs84_to_mercator", cte(f"""SELECT edge_id, {q('6378137e0*radians(lon0)', 4)} AS x,
   {q('6378137e0*ln(tan(pi()/4 + radians(lat0)/2))', 4)} AS y FROM edges""", "edges"))
def wgs84_to_mercator(spark, sf):
    x, y = G.wgs84_to_mercator(F.col("lat0"), F.col("lon0"))
    return rounded(derived(spark, sf, "edges"), "edge_id", x=x, y=y, digits=4)


@query("mercator_to_wgs84", cte(f"""SELECT edge_id, {q('degrees(2*atan(exp(lat0*125000e0/6378137e0)) - pi()/2)', 9)} AS lat,
   {q('degrees(lon0*111000e0/6378137e0)', 9)} AS lon FROM edges""", "edges"))
def mercator_to_wgs84(spark, sf):
    lat, lon = G.mercator_to_wgs84(F.col("lon0") * 111000, F.col("lat0") * 125000)
    return rounded(derived(spark, sf, "edges"), "edge_id", lat=lat, lon=lon, digits=9)


@query("utm_to_sim", cte(f"SELECT bag, idx, {q('px - 880000e0', 4)} AS x, {q('-(py - 5390000e0)', 4)} AS y FROM g_f", "odom",
                         extra={**_U, **_W, **_P_SRC, **_P}))
def utm_to_sim(spark, sf):
    out = G.utm_to_sim(derived(spark, sf, "odom"), "tx", "ty", "x", "y", OFFSET)
    return rounded(out, "bag", "idx", x="x", y="y", digits=4)


_S = {"s": "SELECT run, seq, x - (-880000e0) AS px, -y - (-5390000e0) AS py FROM runs"}
_SI = tm_inv("s", "px", "py", "0e0", 1.0, "0e0", "lat", "lon")


@query("sim_to_utm", cte(f"SELECT run, seq, {q('ux', 4)} AS ux, {q('uy', 4)} AS uy FROM v_f", "runs", extra={
    **_S, **_SI, "v": "SELECT run, seq, lat, lon FROM s_f", **tm_fwd("v", "lat", "lon", "9e0", 0.9996, "500000e0", "ux", "uy")}))
def sim_to_utm(spark, sf):
    out = G.sim_to_utm(derived(spark, sf, "runs"), "x", "y", "ux", "uy", OFFSET)
    return rounded(out, "run", "seq", ux="ux", uy="uy", digits=4)


@query("sim_to_mercator", cte(f"""SELECT run, seq, {q('6378137e0*radians(lon)', 4)} AS mx,
   {q('6378137e0*ln(tan(pi()/4 + radians(lat)/2))', 4)} AS my FROM s_f""", "runs", extra={**_S, **_SI}))
def sim_to_mercator(spark, sf):
    out = G.sim_to_mercator(derived(spark, sf, "runs"), "x", "y", "mx", "my", OFFSET)
    return rounded(out, "run", "seq", mx="mx", my="my", digits=4)


_AX = {
    "h": "SELECT bag, idx, yaw, tx, ty FROM odom UNION ALL SELECT bag, -idx - 1, yaw, tx + 1, ty FROM odom",
    **tm_inv("h", "tx", "ty", "9e0", 0.9996, "500000e0", "lat", "lon"),
    "k": "SELECT bag, idx, yaw, lat, lon FROM h_f",
    **tm_fwd("k", "lat", "lon", "0e0", 1.0, "0e0", "px", "py"),
    "axis": "SELECT a.bag, a.idx, a.yaw, atan2(-(b.py - a.py), b.px - a.px) AS ax FROM k_f a JOIN k_f b ON a.bag = b.bag AND b.idx = -a.idx - 1 WHERE a.idx >= 0",
}


@query("yaw_to_sim", cte(f"""SELECT o.bag, o.idx, {q('d - 360*floor(d/360e0)', 4)} AS yaw_deg FROM
   (SELECT o.bag, o.idx, degrees(a.ax - o.yaw + pi()/2) AS d FROM odom o JOIN axis a ON a.bag = o.bag AND a.idx = 0) o""", "odom", extra=_AX))
def yaw_to_sim(spark, sf):
    odom = derived(spark, sf, "odom")
    start = ts.first_pose(odom, ["bag"], ["idx"], ["tx", "ty"])
    axis = G.axis_angle(start, "tx", "ty", "ax", OFFSET).select("bag", "ax")
    out = odom.join(axis, "bag")
    return rounded(out, "bag", "idx", yaw_deg=A.yaw_to_sim("ax", "yaw"), digits=4)


@query("enu_to_latlon", cte(f"""SELECT bag, idx, {q('48.17559486315574e0 + (ty - 5339000e0)/mlat', 9)} AS lat,
  {q('11.5951469668968e0 + (tx - 692900e0)/mlon', 9)} AS lon FROM (SELECT *,
  111132.92e0 - 559.82e0*cos(2*a) + 1.175e0*cos(4*a) AS mlat, 111412.84e0*cos(a) - 93.5e0*cos(3*a) AS mlon
  FROM (SELECT *, radians(48.17559486315574e0) AS a FROM odom))""", "odom"))
def enu_to_latlon(spark, sf):
    lat, lon = G.enu_to_latlon(F.col("tx") - 692900.0, F.col("ty") - 5339000.0, 48.17559486315574, 11.5951469668968)
    return rounded(derived(spark, sf, "odom"), "bag", "idx", lat=lat, lon=lon, digits=9)


@query("local_equirect", cte(f"""SELECT edge_id, {q('(lon1 - lon0)*40075000*cos(radians(lat0))/360')} AS dx,
  {q('(lat1 - lat0)*111320')} AS dy FROM edges""", "edges"))
def local_equirect(spark, sf):
    dx, dy = G.local_equirect(*[F.col(c) for c in ("lat0", "lon0", "lat1", "lon1")])
    return rounded(derived(spark, sf, "edges"), "edge_id", dx=dx, dy=dy)


_LH = tm_fwd("e", "lat1", "lon1", "lon0", 1.0, "0e0", "hx", "hy", lat0="lat0")


@query("local_tmerc_heading", cte(f"""SELECT edge_id, {q('d - 360*floor(d/360e0)')} AS deg, {q('rx', 4)} AS x, {q('-ry', 4)} AS y FROM
  (SELECT *, degrees(atan2(-hy, hx)) + 360 AS d, cos(radians(-8.69e0))*hx - sin(radians(-8.69e0))*hy AS rx,
   sin(radians(-8.69e0))*hx + cos(radians(-8.69e0))*hy AS ry FROM e_f)""", "edges", extra={**_E, **_LH}))
def local_tmerc_heading(spark, sf):
    names = ("lat0", "lon0", "lat1", "lon1")
    out = G.local_tmerc_heading(derived(spark, sf, "edges"), *names, "deg")
    out = G.local_tmerc_point(out, *names, "x", "y", rotation_deg=-8.69)
    return out.select("edge_id", r("deg").alias("deg"), r("x", 4).alias("x"), r("y", 4).alias("y"))


@query("grid_convergence", cte(f"""SELECT edge_id, {q('degrees(atan(tan(radians(lon0))*sin(radians(lat0))))')} AS deg FROM edges""", "edges"))
def grid_convergence(spark, sf):
    return rounded(derived(spark, sf, "edges"), "edge_id", deg=A.grid_convergence("lat0", "lon0"))
