"""Recording-like relations derived from the test tables.

Each relation exists twice: as a Spark DataFrame (written once per session and folder, the way a
recording table would be) and as a DuckDB common table expression for the equality check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.operators.ordered import dense_number
from wheeltrace.session import materialize

_CACHE: dict[tuple[str, str, str], DataFrame] = {}

# microseconds of a zone-less timestamp, independent of the session time zone
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_POSE = """
  692900e0 + 0.5e0*idx AS tx, 5339000e0 + 20*sin(idx/60.0e0) AS ty, 550e0 AS tz,
  0e0 AS qx, 0e0 AS qy, sin(yaw/2) AS qz, cos(yaw/2) AS qw, yaw, yaw + 3.0e0*sin(idx/15e0) AS yaw_raw
"""
_YAW = "atan2(20 * cos(idx/60.0e0)/60.0e0, 0.5e0)"
_EDGES = """SELECT CAST(s_suppkey AS BIGINT) AS edge_id, 11.58e0 + (s_suppkey % 10)*0.002e0 AS lon0,
    48.17e0 + floor(s_suppkey/10e0)*0.001e0 AS lat0, 11.5815e0 + (s_suppkey % 10)*0.002e0 AS lon1,
    48.17e0 + floor(s_suppkey/10e0)*0.001e0 + 0.0004e0*(s_nationkey % 3) AS lat1,
    CASE WHEN s_suppkey % 3 = 0 THEN 'yes' WHEN s_suppkey % 3 = 1 THEN 'Parallel' ELSE 'no' END
      AS parking_left, CAST(s_nationkey AS BIGINT) AS nation FROM supplier"""
_CARS = """SELECT CAST(c_custkey AS BIGINT) AS cluster_id, 11.58e0 + (c_custkey % 97)*0.0002e0 AS lon,
    48.17e0 + (c_custkey % 89)*0.0001e0 AS lat,
    CASE c_nationkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS side,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'perpendicular' ELSE 'parallel' END AS orient FROM customer"""
_PIXELS = """SELECT CAST(l_orderkey % 50 AS BIGINT) AS frame, CAST(l_orderkey AS BIGINT) AS l_orderkey,
    CAST(l_linenumber AS INT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS gt,
    CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS INT) % 3
      ELSE (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) END AS pred FROM lineitem"""
_CAMERAS = "SELECT CAST(vec_id AS BIGINT) AS frame_id, CAST(label AS BIGINT) AS split, embedding AS c2w FROM embeddings"
_DET_COLS = """(obj % 20)*7e0 + (l_discount-0.05e0)*10e0*(CASE WHEN obj % 37 = 0 THEN 8 ELSE 1 END) AS x,
  floor(obj/20e0)*7e0 + (l_tax-0.04e0)*10e0 AS y, 0e0 AS z, 4.5e0 AS len, 1.8e0 AS wid, 1.5e0 AS hgt,
  (l_partkey % 7)*0.3e0 AS yaw, 0.3e0 + 0.6e0*(l_quantity/50e0) AS score,
  CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS label, CAST(l_tax AS DOUBLE) AS tax,
  CAST(obj AS BIGINT) AS obj"""
_DET_BASE = """SELECT CAST(l_suppkey % 8 AS BIGINT) AS run, CAST(l_orderkey % 40 AS BIGINT) AS frame,
    l_partkey % 300 AS obj, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount,
    CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem"""
_RUN_COLS = """seq, seq*0.35e0 + 0.02e0*(o_orderkey % 7) AS x,
    (0.2e0 + 0.1e0*run) * ((o_orderkey % 101)/100e0) AS lat,
    CAST(o_orderkey % 41 AS DOUBLE)/20e0 - 1e0 AS steer"""
_LINE = """CASE WHEN event_id % 50 = 0 THEN '# comment'
  WHEN event_id % 50 = 1 THEN concat(CAST(event_id AS VARCHAR(20)), ', oops')
  WHEN event_id % 2 = 0 THEN concat_ws(', ', CAST(event_id AS VARCHAR(20)), CAST(user_id AS VARCHAR(20)), '1.5','2.5','0.25','f.png')
  ELSE concat_ws(', ', CAST(event_id AS VARCHAR(20)), CAST(user_id AS VARCHAR(20)), '1.5','2.5','0','0','0','0','1','0.75','f.png')
  END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, where):
    return table(spark, sf_dir, "events").where(where).selectExpr(
        "cast(user_id % 8 as bigint) as bag", "cast(event_id as bigint) as event_id", "ts",
        f"{MICROS} as t_us", "cast(value as double) as value",
    )


def _numbered_events(spark, sf_dir, where, name):
    return dense_number(_events(spark, sf_dir, where), ["bag"], ["t_us", "event_id"], name)


def _odom(spark, sf_dir):
    df = _numbered_events(spark, sf_dir, "event_type in ('view','error')", "idx")
    return df.withColumn("yaw", F.expr(_YAW)).selectExpr("bag", "t_us", "idx", *_split(_POSE))


def _split(cols: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in cols:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey % 6 as bigint) as run", "cast(o_orderkey as bigint) as o_orderkey"
    )
    p = dense_number(o, ["run"], ["o_orderkey"], "seq").selectExpr("run", *_split(_RUN_COLS))
    return p.selectExpr(
        "run", "CASE WHEN run < 3 THEN 'real' ELSE 'sim' END AS kind", "seq", "x",
        "15*sin(x/80e0) + lat AS y", "steer",
    )


def _detections(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem")
    li.createOrReplaceTempView("_wt_lineitem")
    base = spark.sql(_DET_BASE.replace("FROM lineitem", "FROM _wt_lineitem"))
    return dense_number(base, ["run", "frame"], order, "det_idx", drop=["l_orderkey", "l_extendedprice"]).selectExpr(
        "run", "frame", "det_idx", *_split(_DET_COLS)
    )


def _sql_over(sql, src):
    def build(spark, sf_dir):
        table(spark, sf_dir, src).createOrReplaceTempView(f"_wt_{src}")
        return spark.sql(sql.replace(f"FROM {src}", f"FROM _wt_{src}"))

    return build


_BUILD = {
    "odom": _odom,
    "camera": lambda s, d: _numbered_events(s, d, "event_type = 'click'", "frame_id").select("bag", "frame_id", "t_us"),
    "lidar": lambda s, d: _numbered_events(s, d, "event_type = 'signup'", "frame_id").select("bag", "frame_id", "t_us"),
    "series": lambda s, d: _numbered_events(s, d, "event_type = 'purchase'", "seq").selectExpr(
        "bag", "seq", "t_us", "(value - 50e0)/50e0 AS value"),
    "runs": _runs,
    "detections": _detections,
    "pixels": _sql_over(_PIXELS, "lineitem"),
    "edges": _sql_over(_EDGES, "supplier"),
    "cars": _sql_over(_CARS, "customer"),
    "cameras": _sql_over(_CAMERAS, "embeddings"),
    "messages": _sql_over(
        "SELECT CAST(user_id % 8 AS BIGINT) AS bag, concat('/', event_type) AS topic,"
        f" {MICROS} AS t_us FROM events", "events"),
    "pose_lines": _sql_over(
        f"SELECT CAST(event_id AS BIGINT) AS line_no, {_LINE} AS value FROM events", "events"),
}
# Relations that need a sort are written once; plain projections stay lazy scans.
_WRITTEN = {"odom", "camera", "lidar", "series", "runs", "detections"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in _WRITTEN:
        return _BUILD[name](spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        _CACHE[key] = materialize(_BUILD[name](spark, sf_dir), name)
    return _CACHE[key]


def _events_cte(where, num, cols):
    return (
        f"SELECT CAST(user_id % 8 AS BIGINT) AS bag, CAST(event_id AS BIGINT) AS event_id, epoch_us(ts) AS t_us,"
        f" CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS BIGINT) AS {num}{cols}"
        f" FROM events WHERE {where}"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "odom0": ([], _events_cte("event_type IN ('view','error')", "idx", "")),
    "odom1": (["odom0"], f"SELECT *, {_YAW} AS yaw FROM odom0"),
    "odom": (["odom1"], f"SELECT bag, t_us, idx, {_POSE} FROM odom1"),
    "camera": ([], _events_cte("event_type = 'click'", "frame_id", "")),
    "lidar": ([], _events_cte("event_type = 'signup'", "frame_id", "")),
    "series": ([], _events_cte("event_type = 'purchase'", "seq", ", (value - 50e0)/50e0 AS value")),
    "runs0": ([], "SELECT CAST(o_custkey % 6 AS BIGINT) AS run, o_orderkey, CAST(row_number() OVER"
              " (PARTITION BY o_custkey % 6 ORDER BY o_orderkey) - 1 AS BIGINT) AS seq FROM orders"),
    "runs1": (["runs0"], f"SELECT run, {_RUN_COLS} FROM runs0"),
    "runs": (["runs1"], "SELECT run, CASE WHEN run < 3 THEN 'real' ELSE 'sim' END AS kind, seq, x,"
             " 15*sin(x/80e0) + lat AS y, steer FROM runs1"),
    "det0": ([], _DET_BASE.replace(" FROM lineitem", ", CAST(row_number() OVER (PARTITION BY l_suppkey % 8,"
             " l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT)"
             " AS det_idx FROM lineitem")),
    "detections": (["det0"], f"SELECT run, frame, det_idx, {_DET_COLS} FROM det0"),
    "pixels": ([], _PIXELS),
    "edges": ([], _EDGES),
    "cars": ([], _CARS),
    "cameras": ([], _CAMERAS),
    "messages": ([], "SELECT CAST(user_id % 8 AS BIGINT) AS bag, concat('/', event_type) AS topic, epoch_us(ts) AS t_us FROM events"),
    "pose_lines": ([], f"SELECT CAST(event_id AS BIGINT) AS line_no, {_LINE} AS value FROM events"),
}


def cte(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text with the named derived relations (and ``extra`` ones) in front."""
    seen: dict[str, str] = {}

    def add(n):
        deps, text = CTES[n]
        for d in deps:
            add(d)
        seen.setdefault(n, text)

    for n in names:
        add(n)
    seen.update(extra or {})
    heads = ", ".join(f"{n} AS ({t})" for n, t in seen.items())
    return f"WITH {heads} {sql}" if heads else sql
