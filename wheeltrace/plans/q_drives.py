"""Queries: scoring of the drives of several routes in one job; methods share run numbers."""

from pyspark.sql import functions as F

from wheeltrace.operators.ordered import dense_number
from wheeltrace.plans import flows
from wheeltrace.plans.derived import _split, cte, table
from wheeltrace.plans.q_path import _INF
from wheeltrace.plans.registry import q, query, r
from wheeltrace.session import materialize

_MEMO: dict = {}

# twelve drives out of the orders: two routes with two real drives and two simulated ones of each of two methods
_COLS = """slot, CAST(floor(slot/6e0) AS BIGINT) AS route, CAST(slot % 2 AS BIGINT) AS run, CASE WHEN slot % 6 < 2 THEN 'real' ELSE 'sim' END AS kind,
    CASE WHEN slot % 6 < 2 THEN NULL WHEN slot % 6 < 4 THEN 'gs' ELSE 'nerf' END AS method, seq, seq*0.35e0 + 0.02e0*(o_orderkey % 7) AS x,
    (0.2e0 + 0.1e0*(slot % 6)) * ((o_orderkey % 101)/100e0) AS lat, CAST(o_orderkey % 41 AS DOUBLE)/20e0 - 1e0 AS steer"""
_Y = "1000*route + 15*sin(x/(80e0 + 25*route)) + lat"


def drives(spark, sf):
    """Real and simulated drives of all routes."""
    o = table(spark, sf, "orders").selectExpr("cast(o_custkey % 12 as bigint) as slot", "cast(o_orderkey as bigint) as o_orderkey")
    d = dense_number(o, ["slot"], ["o_orderkey"], "seq").selectExpr(*_split(_COLS))
    return d.selectExpr("route", "run", "kind", "method", "seq", "x", f"{_Y} as y", "steer")


def scored(spark, sf):
    """The result tables of all routes, computed once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        d = materialize(drives(spark, sf), "drives")
        real = d.where("kind = 'real'").select("route", "run", "seq", "x", "y")
        sim = d.where("kind = 'sim'").select("route", "run", "method", "seq", "x", "y", "steer")
        _MEMO[key] = flows.score_drives(real, sim, keys=["route"])
    return _MEMO[key]


_W = "(PARTITION BY slot ORDER BY seq)"
_SEG = {
    "dr0": "SELECT CAST(o_custkey % 12 AS BIGINT) AS slot, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderkey) - 1 AS BIGINT) AS seq FROM orders",
    "dr1": f"SELECT {_COLS} FROM dr0",
    "dr": f"SELECT *, {_Y} AS y FROM dr1",
    "step": f"SELECT *, coalesce(sqrt((x - lag(x) OVER {_W})*(x - lag(x) OVER {_W}) + (y - lag(y) OVER {_W})*(y - lag(y) OVER {_W})), 0e0) AS ds FROM dr WHERE kind = 'real'",
    "arc": f"SELECT *, sum(ds) OVER {_W} AS s FROM step",
    "best": "SELECT route, run, slot, len FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY len DESC, run) AS k FROM (SELECT route, run, slot, max(s) AS len FROM arc GROUP BY route, run, slot)) WHERE k = 1",
    "cnt": "SELECT *, greatest(CAST(floor(len/0.5e0) AS BIGINT) + 1, 2) AS n FROM best",
    "stat": "SELECT route, slot, idx, CASE WHEN idx = n - 1 THEN len ELSE idx*(len/(n - 1)) END AS s FROM (SELECT *, unnest(range(n)) AS idx FROM cnt)",
    "path": """SELECT t.route, t.idx, t.s, CASE WHEN b.s IS NULL THEN a.x ELSE a.x + (t.s - a.s)/(b.s - a.s)*(b.x - a.x) END AS x,
      CASE WHEN b.s IS NULL THEN a.y ELSE a.y + (t.s - a.s)/(b.s - a.s)*(b.y - a.y) END AS y
      FROM stat t ASOF LEFT JOIN arc a ON a.slot = t.slot AND t.s >= a.s ASOF LEFT JOIN arc b ON b.slot = t.slot AND t.s < b.s""",
    "ref": """SELECT *, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS tx, coalesce(lead(y) OVER w - y, y - lag(y) OVER w) AS ty FROM path
      WINDOW w AS (PARTITION BY route ORDER BY idx)""",
    "near": "SELECT d.slot, d.seq, min(struct_pack(d2 := (d.x - p.x)*(d.x - p.x) + (d.y - p.y)*(d.y - p.y), idx := p.idx)) AS m FROM dr d JOIN path p ON p.route = d.route GROUP BY d.slot, d.seq",
    "proj": f"""SELECT d.*, p.s, max(p.s) OVER (PARTITION BY d.slot ORDER BY d.seq) AS progress,
      CASE WHEN sqrt(p.tx*p.tx + p.ty*p.ty) > 1e-9 THEN (p.tx*(d.y - p.y) - p.ty*(d.x - p.x))/sqrt(p.tx*p.tx + p.ty*p.ty) ELSE sqrt(n.m.d2) END AS offset_m
      FROM dr d JOIN near n ON n.slot = d.slot AND n.seq = d.seq JOIN ref p ON p.route = d.route AND p.idx = n.m.idx""",
    "ends": "SELECT route, slot, run, kind, method, arg_min(progress, seq) AS p0, arg_max(progress, seq) AS p1 FROM proj GROUP BY ALL",
    "seg": "SELECT route, max(p0) AS a, min(p1) AS b FROM ends WHERE kind = 'real' GROUP BY route",
}
_COMP = {**_SEG, "comp": """SELECT e.*, greatest(0e0, least(1e0, (p1 - a)/(b - a))) AS c, p0 > a + 5 AS late FROM ends e JOIN seg USING (route) WHERE kind = 'sim'"""}
_QUAL = {
    **_COMP,
    "good": "SELECT p.*, a, b FROM proj p JOIN seg USING (route) WHERE kind = 'real' OR slot IN (SELECT slot FROM comp WHERE c >= 0.95e0)",
    "cv": "SELECT route, slot, run, kind, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys, count(*) AS n FROM good WHERE progress BETWEEN a AND b GROUP BY ALL",
    "pq": "SELECT a.slot AS p, b.slot AS q, b.run AS vs, a.xs AS px, a.ys AS py, b.xs AS qx, b.ys AS qy, a.n, b.n AS m FROM cv a JOIN cv b ON a.kind = 'sim' AND b.kind = 'real' AND a.route = b.route",
    "dp(p, q, d, l1, l2) USING KEY (p, q)": f"""SELECT p, q, CAST(0 AS BIGINT), list_concat([{_INF}, (px[1]-qx[1])*(px[1]-qx[1]) + (py[1]-qy[1])*(py[1]-qy[1])], list_transform(range(n-1), lambda i: {_INF})),
      list_transform(range(n+1), lambda i: {_INF}) FROM pq UNION ALL
      SELECT w.p, w.q, w.d + 1, list_prepend({_INF}, list_transform(range(t.n), lambda i: CASE WHEN w.d + 1 - i >= 0 AND w.d + 1 - i < t.m
        THEN greatest((t.px[i+1] - t.qx[w.d+2-i])*(t.px[i+1] - t.qx[w.d+2-i]) + (t.py[i+1] - t.qy[w.d+2-i])*(t.py[i+1] - t.qy[w.d+2-i]), least(w.l1[i+1], w.l1[i+2], w.l2[i+1])) ELSE {_INF} END)), w.l1
      FROM dp w JOIN pq t ON t.p = w.p AND t.q = w.q WHERE w.d + 1 <= t.n + t.m - 2""",
    "fm": "SELECT p AS slot, min(f) AS f, arg_min(vs, struct_pack(f := f, vs := vs)) AS vs FROM (SELECT d.p, t.vs, sqrt(d.l1[len(d.l1)]) AS f FROM dp d JOIN pq t ON t.p = d.p AND t.q = d.q WHERE t.n >= 10) GROUP BY p",
    "clean": "SELECT * FROM (SELECT *, lag(progress) OVER (PARTITION BY slot ORDER BY seq) AS pp FROM good) WHERE progress - coalesce(pp, -1e0) > 0",
    "span": "SELECT route, slot, kind, min(progress) AS lo, max(progress) AS hi FROM clean GROUP BY ALL",
    "sta": "SELECT route, k AS station, a + k*0.5e0 AS at FROM (SELECT route, a, unnest(range(CAST(ceil((b - a)/0.5e0) AS BIGINT))) AS k FROM seg)",
    "lat": """SELECT w.*, CASE WHEN d.progress IS NULL THEN c.offset_m ELSE c.offset_m + (w.at - c.progress)/(d.progress - c.progress)*(d.offset_m - c.offset_m) END AS offset_m
      FROM (SELECT s.route, s.slot, s.kind, t.station, t.at FROM span s JOIN sta t ON t.route = s.route AND t.at BETWEEN s.lo AND s.hi) w
      ASOF LEFT JOIN clean c ON c.slot = w.slot AND w.at >= c.progress ASOF LEFT JOIN clean d ON d.slot = w.slot AND w.at < d.progress""",
    "cor": "SELECT route, station, min(offset_m) AS lo, max(offset_m) AS hi FROM lat WHERE kind = 'real' GROUP BY route, station",
    "ev": """SELECT l.slot, l.offset_m < c.lo OR l.offset_m > c.hi AS outside, CASE WHEN l.offset_m < c.lo THEN c.lo - l.offset_m WHEN l.offset_m > c.hi THEN l.offset_m - c.hi ELSE 0e0 END AS ex
      FROM lat l JOIN cor c ON c.route = l.route AND c.station = l.station WHERE l.kind = 'sim'""",
    "vio": "SELECT slot, avg(CASE WHEN outside THEN 1e0 ELSE 0e0 END)*100 AS out_pct, avg(ex) AS me, coalesce(avg(CASE WHEN outside THEN ex END), 0e0) AS meo FROM ev GROUP BY slot HAVING count(*) >= 10",
    "qual": "SELECT DISTINCT e.route, e.method, e.run, f.f, f.vs, v.out_pct, v.me, v.meo FROM ends e JOIN fm f ON f.slot = e.slot JOIN vio v ON v.slot = e.slot",
    "ins": "SELECT route, method, run, slot, steer, row_number() OVER (PARTITION BY slot ORDER BY seq) - 1 AS k FROM good WHERE kind = 'sim' AND progress BETWEEN a AND b",
    "jit": """SELECT route, method, run, stddev_pop(rate) AS j, max(abs(rate)) AS mj FROM (SELECT *, (steer - lag(steer) OVER (PARTITION BY slot ORDER BY k))/0.1e0 AS rate FROM ins WHERE k % 3 = 0)
      WHERE rate IS NOT NULL GROUP BY route, method, run""",
}


def _recursive(sql):
    return "WITH RECURSIVE " + sql[5:]


@query("route_segments", cte(f"""SELECT seg.route, best.run AS reference_run, {q('len', 4)} AS reference_length_m, {q('a', 4)} AS start_m, {q('b', 4)} AS end_m, {q('b - a', 4)} AS length_m
   FROM seg JOIN best USING (route)""", extra=_SEG))
def route_segments(spark, sf):
    s = scored(spark, sf)["segments"]
    return s.select("route", "reference_run", *[r(c, 4).alias(c) for c in ("reference_length_m", "start_m", "end_m", "length_m")])


@query("route_completion", cte(f"SELECT route, method, run, {q('c')} AS completion, c >= 0.95e0 AS success, late AS starts_late FROM comp", extra=_COMP))
def route_completion(spark, sf):
    return scored(spark, sf)["completion"].select("route", "method", "run", r("completion").alias("completion"), "success", "starts_late")


@query("route_quality", _recursive(cte(f"""SELECT route, method, run, {q('f')} AS frechet, vs AS min_frechet_vs, {q('out_pct', 4)} AS out_pct, {q('me', 5)} AS mean_excess, {q('meo', 5)} AS mean_excess_out FROM qual""", extra=_QUAL)))
def route_quality(spark, sf):
    d = scored(spark, sf)["quality"]
    return d.select("route", "method", "run", r("frechet").alias("frechet"), "min_frechet_vs", r("out_pct", 4).alias("out_pct"), r("mean_excess", 5).alias("mean_excess"), r("mean_excess_out", 5).alias("mean_excess_out"))


@query("route_jitter", _recursive(cte(f"SELECT route, method, run, {q('j')} AS jitter, {q('mj')} AS max_jitter FROM jit", extra=_QUAL)))
def route_jitter(spark, sf):
    return scored(spark, sf)["jitter"].select("route", "method", "run", r("jitter").alias("jitter"), r("max_jitter").alias("max_jitter"))


@query("route_averages", _recursive(cte("""SELECT a.route, a.method, a.runs, round(a.f, 3) AS avg_frechet_m, round(a.o, 1) AS avg_out_pct, round(a.me, 3) AS avg_mean_excess_m, round(b.j, 6) AS avg_jitter, round(b.mj, 6) AS max_jitter
   FROM (SELECT route, method, count(*) AS runs, avg(f) AS f, avg(out_pct) AS o, avg(me) AS me FROM qual GROUP BY route, method) a
   JOIN (SELECT route, method, avg(j) AS j, max(mj) AS mj FROM jit GROUP BY route, method) b USING (route, method)""", extra=_QUAL)))
def route_averages(spark, sf):
    return scored(spark, sf)["averages"].select("route", "method", "runs", "avg_frechet_m", "avg_out_pct", "avg_mean_excess_m", "avg_jitter", "max_jitter")
